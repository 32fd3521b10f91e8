"""The analytic commands as functions: scan, lint, list, audit, explain, status, cache statistics."""

from __future__ import annotations

import datetime as dt

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.functions import structures
from larkspur.operators import drift, findings, linescan, loadouts, manifests, reports, resolution, routing, servers, similarity, suites, usage
from larkspur.sources import configs, targets, trees
from larkspur.sources import harnesses as tables


@dataclass
class Settings:
    """Budgets and thresholds; the defaults are the documented ones."""

    catalog_tokens: int = 6000
    body_tokens: int = 20000
    near_duplicate: float = 0.85
    description_overlap: float = 0.6
    generic_min_distinct_tokens: int = 2
    routing_margin: float = 0.1
    unused_days: int = 90


@dataclass
class World:
    """The tables that checks read. Those a scan did not fill are None, and their checks do nothing."""

    contributors: DataFrame
    instances: DataFrame
    loads: DataFrame
    harnesses: DataFrame
    bundled: DataFrame
    broken_links: DataFrame | None = None
    servers: DataFrame | None = None
    config_errors: DataFrame | None = None
    tools: DataFrame | None = None
    acks: DataFrame | None = None
    queries: DataFrame | None = None
    lock: DataFrame | None = None
    unreadable: DataFrame | None = None
    executables: DataFrame | None = None
    connect_failures: DataFrame | None = None
    settings: Settings = field(default_factory=Settings)
    _kept: dict[str, DataFrame] = field(default_factory=dict)

    def kept(self, name: str, plan: Callable[[], DataFrame]) -> DataFrame:
        """A table that several checks read is made once for each scan."""
        if name not in self._kept:
            self._kept[name] = plan().persist(StorageLevel.DISK_ONLY)
        return self._kept[name]

    def release(self) -> None:
        for df in self._kept.values():
            df.unpersist()
        self._kept.clear()

    @property
    def marked(self) -> DataFrame:
        return self.kept("marked", lambda: resolution.mark_shadows(self.loads, self.harnesses))

    @property
    def skills(self) -> DataFrame:
        return self.contributors.where("kind = 'skill' and is_skill_md")

    @property
    def lines(self) -> DataFrame:
        return self.kept("lines", lambda: linescan.source_lines(trees.scan_texts(self.contributors, self.bundled)))

    @property
    def commands(self) -> DataFrame:
        return self.kept("commands", lambda: linescan.commands(self.contributors.select("id", "name", F.element_at(F.split("id", "/"), -1).alias("relpath"), "text")))

    @property
    def effective(self) -> DataFrame:
        return resolution.effective(self.marked)


Check = Callable[[World], DataFrame]


def _spec(w: World) -> DataFrame:
    return similarity.front_matter_checks(w.skills.withColumn("description", F.col("routing_text")))


def _broken(w: World) -> DataFrame:
    none = F.array().cast("array<string>")
    return findings.finding(w.broken_links, "broken-symlink", "error", F.array("path"), none, F.array("harness"), F.col("path"), F.array("harness", "path"))


def unreadable(rows: DataFrame) -> DataFrame:
    """Findings for files that could not be read (harness, path)."""
    none = F.array().cast("array<string>")
    return findings.finding(rows, "unreadable-skill", "warning", F.array("path"), none, F.array("harness"), F.col("path"), F.array("harness", "path"))


def _lock(w: World) -> DataFrame:
    """Only skills that a lockfile names have their folders read again."""
    locked = w.skills.join(w.lock.select("name").distinct(), "name", "left_semi")
    return drift.lockfile_drift(w.lock, locked.join(trees.tree_hashes(locked), "id", "left"))


def _routing(w: World) -> DataFrame:
    ranked = routing.rank(w.queries, w.effective, w.contributors, w.settings.routing_margin)
    return routing.query_routing(w.queries, ranked, w.harnesses)


#: Each check: the tables it needs beside the skills, and its plan.
CHECKS: dict[str, tuple[tuple[str, ...], Check]] = {
    "budget-catalog-tokens": ((), lambda w: resolution.budget_catalog(w.effective, w.settings.catalog_tokens)),
    "budget-body-tokens": ((), lambda w: resolution.budget_body(w.contributors, w.settings.body_tokens)),
    "exact-duplicate": ((), lambda w: resolution.exact_duplicate(w.contributors, w.marked)),
    "near-duplicate": ((), lambda w: similarity.near_duplicate(w.contributors, w.settings.near_duplicate)),
    "name-shadow": ((), lambda w: resolution.name_shadow(w.marked)),
    "double-load": ((), lambda w: resolution.double_load(w.marked)),
    "diverged-copies": ((), lambda w: resolution.diverged_copies(w.contributors, w.marked)),
    "broken-symlink": (("broken_links",), _broken),
    "unreadable-skill": (("unreadable",), lambda w: unreadable(w.unreadable)),
    "lockfile-drift": (("lock",), _lock),
    "spec": ((), _spec),
    "missing-activation": ((), lambda w: similarity.missing_activation(w.skills)),
    "generic-description": ((), lambda w: similarity.generic_description(w.skills, w.settings.generic_min_distinct_tokens)),
    "opposing-imperatives": ((), lambda w: similarity.opposing_imperatives(w.skills)),
    "description-overlap": ((), lambda w: similarity.description_overlap(w.skills, w.settings.description_overlap, w.settings.near_duplicate)),
    "query-routing": (("queries",), _routing),
    "injection-unicode": ((), lambda w: linescan.injection_unicode(w.lines)),
    "injection-encoded-blob": ((), lambda w: linescan.injection_encoded_blob(w.lines)),
    "injection-override": ((), lambda w: linescan.injection_override(w.lines)),
    "injection-remote-fetch": ((), lambda w: linescan.injection_remote_fetch(w.lines)),
    "injection-egress": ((), lambda w: linescan.injection_egress(w.lines)),
    "injection-credential-read": ((), lambda w: linescan.injection_credential_read(w.lines)),
    "injection-mandatory-script": ((), lambda w: linescan.injection_mandatory_script(w.lines, w.bundled)),
    "injection-shell-unreviewed": (("acks",), lambda w: linescan.shell_unreviewed(w.commands, w.acks)),
    "injection-shell-dangerous": ((), lambda w: linescan.shell_dangerous(w.commands)),
    "mcp-config-invalid": (("config_errors",), lambda w: servers.config_invalid(w.config_errors)),
    "mcp-secret-in-config": (("servers",), lambda w: servers.secret_in_config(w.servers)),
    "mcp-unpinned-server": (("servers",), lambda w: servers.unpinned_server(w.servers)),
    "mcp-insecure-url": (("servers",), lambda w: servers.insecure_url(w.servers)),
    "mcp-dead-server": (("servers", "executables"), lambda w: servers.dead_server(w.servers, w.executables)),
    "mcp-connect-failed": (("connect_failures",), lambda w: servers.connect_failed(w.connect_failures)),
    "mcp-shadowed-server": (("servers",), lambda w: servers.shadowed_server(w.servers)),
    "mcp-diverged-server": (("servers",), lambda w: servers.diverged_server(w.servers, w.harnesses)),
    "mcp-tool-collision": (("servers", "tools"), lambda w: servers.tool_collision(w.tools, w.servers)),
    "mcp-tools-unreviewed": (("servers", "tools", "acks"), lambda w: servers.tools_unreviewed(w.tools, w.servers, w.acks)),
    "mcp-tool-poisoning": (("servers", "tools"), lambda w: linescan.tool_poisoning(w.tools, w.servers)),
}


def open_world(spark: SparkSession, project: str, home: str, server_specs: list[tuple] | None = None, settings: Settings | None = None, harnesses: list[dict] | None = None, global_only: bool = False) -> World:
    """Walks the roots of some harnesses (those with a marker, if none are given), reads skills, plugins, server settings,
    the lockfile and which commands exist."""
    used = tables.detected(project, home, global_only) if harnesses is None else harnesses
    plugins = configs.installed_plugins(home, project)
    instances = trees.discover(spark, project, home, used, plugins, global_only).cache()
    lock = configs.lockfile(configs.texts(spark, [f"{project}/skills-lock.json"]))
    read = suites.assign(suites.lock_provenance(trees.contributors(instances), lock), suites.plugin_registry(spark, home))
    skills = read.withColumn("seq", F.xxhash64("id")).cache()
    broken = [trees.broken_links(spark, h["id"], [tables.specs_at(s, project, home) for s in [*([] if global_only else h["project"]), *h["user"]]]) for h in used]
    raw = configs.server_configs(spark, tables.server_specs(project, home, used, global_only) if server_specs is None else server_specs, project)
    found = servers.parse_servers(raw)
    return World(
        contributors=skills, instances=instances, loads=trees.loads(instances, skills.drop("kind")), harnesses=tables.harness_table(spark, used), bundled=trees.bundled_files(skills.where("is_skill_md")).cache(),
        broken_links=findings.union_all(broken) if broken else None, unreadable=trees.unreadable(instances, skills), lock=lock if lock.take(1) else None, servers=found, config_errors=servers.config_errors(raw),
        executables=configs.executables(spark, found), settings=settings or Settings(),
    )


def scan(world: World, checks: list[str] | None = None) -> DataFrame:
    """Findings of all (or some) checks whose tables are there, merged by fingerprint."""
    run = [plan(world) for name, (needs, plan) in CHECKS.items() if (checks is None or name in checks) and all(getattr(world, n) is not None for n in needs)]
    found = findings.merge(findings.union_all(run))
    return found if world.acks is None else findings.active(found, world.acks)


def lint_plugin(documents: DataFrame, cc_documents: DataFrame, mcp_documents: DataFrame, marketplaces: DataFrame, listing: DataFrame, files: DataFrame) -> DataFrame:
    """All manifest checks over plugins and marketplaces."""
    return findings.merge(findings.union_all([
        manifests.plugin_manifest_invalid(documents), manifests.plugin_name_invalid(documents), manifests.plugin_unknown_field(documents), manifests.plugin_schema_unknown(documents), manifests.plugin_skill_undiscoverable(documents, listing),
        manifests.plugin_path_escape(documents, listing), manifests.plugin_extension_hygiene(documents, listing, files), manifests.cc_manifest_invalid(cc_documents), manifests.cc_unknown_field(cc_documents), manifests.cc_component_missing(cc_documents, listing),
        manifests.cc_manifest_mismatch(documents, cc_documents), manifests.mcp_spec_invalid(mcp_documents, listing), manifests.mcp_spec_placeholder(mcp_documents), manifests.marketplace_invalid(marketplaces), manifests.marketplace_unpinned(marketplaces),
        manifests.marketplace_command(marketplaces), manifests.marketplace_entry_missing(marketplaces, listing),
    ]))


def audit(invocations: DataFrame, since: str | None = None, project: str | None = None, now: dt.datetime | None = None) -> dict[str, DataFrame]:
    """since: Nd or an ISO date. Tables in the order in which they are read."""
    cutoff = None if since is None else structures.since(since, now or dt.datetime.now(dt.timezone.utc)).isoformat()
    own = usage.in_scope(invocations, cutoff, project, None if project is None else project.replace("/", "-").replace(".", "-"))
    return {"by_name": usage.ranked(usage.labelled(usage.usage_by_name(own))), "coverage": usage.coverage(own), "windows": usage.unlike_windows(own), "rollup": usage.ranked(usage.labelled(usage.rollup(own)), overall=True)}


def explain(spark: SparkSession, world: World, query: str) -> DataFrame:
    """Where one query would route, harnesses of one ranking together."""
    asked = spark.createDataFrame([(0, query, None)], "query_id bigint, query string, expect string")
    return routing.group_rankings(routing.rank(asked, world.effective, world.contributors, world.settings.routing_margin))


def verdict_statistics(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("verdict", "model").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


def normalised_selector(name: str = "name") -> F.Column:
    return T.slug(name)


def lint(spark: SparkSession, path: str, forced: str | None = None, settings: Settings | None = None) -> DataFrame:
    """Findings about one plugin, skill, marketplace or file of server settings, without harnesses."""
    target = targets.classify(path, forced)
    root = target.path if target.path.is_dir() else target.path.parent
    found: list[DataFrame] = []
    docs = lambda *names: configs.texts(spark, [str(root / n) for n in names]).select(F.lit(str(root)).alias("root"), "text")
    listing = spark.createDataFrame(targets.plugin_listing(root), "root string, relpath string, is_dir boolean, is_symlink boolean, resolved string")
    skills: list[str] = []
    if target.kind == "skill":
        skills = [str(target.path if target.path.is_file() else target.path / "SKILL.md")]
    elif target.kind == "plugin":
        manifest = root / (targets.PLUGIN if target.flavor == "agent-plugins" else targets.CLIENT_PLUGIN)
        raw = configs._json(manifest)
        if target.flavor == "agent-plugins":
            skills = [str(p) for p in sorted((root / "skills").glob("*/SKILL.md"))]
        else:
            skills = [str(p) for p in targets.client_plugin_skills(root, raw if isinstance(raw, dict) else {})]
        none = docs()
        own, client = (docs(targets.PLUGIN), docs(targets.CLIENT_PLUGIN)) if target.flavor == "agent-plugins" else (none, docs(targets.CLIENT_PLUGIN))
        texts = configs.texts(spark, [str(p) for p in root.rglob("*.json") if p.is_file()]).select(F.lit(str(root)).alias("root"), F.substring("path", len(str(root)) + 2, 1 << 20).alias("relpath"), F.octet_length("text").cast("bigint").alias("size"), F.col("text").alias("content"))
        found.append(lint_plugin(own, client, docs("mcp.json"), docs(), listing, texts))
    elif target.kind == "marketplace":
        own = docs(target.path.name if target.path.is_file() else targets.MARKETPLACE)
        found += [manifests.marketplace_invalid(own), manifests.marketplace_unpinned(own), manifests.marketplace_command(own), manifests.marketplace_entry_missing(own, listing)]
    elif target.flavor == "agent-plugins":
        own = docs(target.path.name)
        found += [manifests.mcp_spec_invalid(own, listing), manifests.mcp_spec_placeholder(own)]
    else:
        raw = configs.server_configs(spark, [(str(target.path), "mcp-json", "", "project")])
        held = servers.parse_servers(raw)
        found += [servers.config_invalid(servers.config_errors(raw)), servers.secret_in_config(held), servers.unpinned_server(held), servers.insecure_url(held), servers.dead_server(held, configs.executables(spark, held))]
    if skills:
        rows = trees.prepare(spark).createDataFrame([("", "project", "skill", k, p, str(p), False, None) for k, p in enumerate(skills)], trees.INSTANCE)
        own = trees.contributors(rows).withColumn("seq", F.xxhash64("id"))
        world = World(own, rows, trees.loads(rows, own.drop("kind")), tables.harness_table(spark, []), trees.bundled_files(own), settings=settings or Settings())
        names = [n for n, (needs, _) in CHECKS.items() if not needs and n not in ("double-load", "name-shadow", "budget-catalog-tokens", "diverged-copies", "exact-duplicate")]
        found.append(scan(world, names))
    return reports.without_harnesses(findings.merge(findings.union_all(found)))


def publishable(spark: SparkSession, path: str, fail_on: str = "warning") -> tuple[bool, DataFrame]:
    """Whether a folder may be published, and the findings that hold it back."""
    held = findings.blocking(lint(spark, path), fail_on)
    return not held.take(1), held


def listed(world: World) -> DataFrame:
    """What each harness loads, in the order of a report."""
    own = world.marked.join(world.contributors.select("id", "suite"), "id", "left")
    return reports.harness_rows(own, world.servers)


def show(world: World, ref: str) -> DataFrame:
    """The finding that a short id names."""
    found = scan(world)
    asked = found.sparkSession.createDataFrame([(ref,)], "ref string")
    return found.join(findings.resolve_refs(found, asked).select("fingerprint"), "fingerprint", "left_semi")


def loadout_status(world: World, entries: DataFrame, pins: DataFrame, loadout: str) -> DataFrame:
    """selector, state of every published entry, skills and servers alike."""
    skills = drift.classify_entries(entries.where("kind = 'skill'"), world.skills, pins, loadout).select("selector", "state")
    if world.servers is None:
        return skills
    return skills.unionByName(loadouts.server_states(entries.where("kind = 'mcp'"), world.servers).select("selector", "state"))
