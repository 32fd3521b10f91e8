"""Static flags on lines of skills, scripts, prose, commands and tool text, with the first three hits as evidence.

source_lines: id, name, relpath, kind (skillmd, script, prose), lineno, line, body_start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import lexicons as X
from larkspur.functions import text as T

from .findings import finding


def source_lines(texts: DataFrame) -> DataFrame:
    """texts (id, name, relpath, kind or null, text) as lines; a kind is told from the file name and its first bytes."""
    extension = F.lower(F.regexp_extract("relpath", r"(\.[^./]*)$", 1))
    kind = F.coalesce("kind", F.when(extension.isin(X.SCRIPT_EXTENSIONS) | F.col("text").startswith("#!"), "script").otherwise("prose"))
    lines = texts.select("id", "name", "relpath", kind.alias("kind"), T.split_lines(F.coalesce("text", F.lit(""))).alias("lines"))
    started = lines.withColumn("body_start", F.when(F.col("kind") == "skillmd", T.body_start(F.col("lines"))).otherwise(1))
    return started.select("id", "name", "relpath", "kind", "body_start", F.posexplode("lines").alias("lineno", "line")).withColumn("lineno", F.col("lineno") + 1)


def evidence(hits: DataFrame) -> DataFrame:
    """id, name, n, first (three hits as relpath:line: snippet) of hits (id, name, relpath, lineno, line).

    The rank limit is applied before the shuffle too, so a source of very many hits sends three rows from each task.
    """
    at = F.struct("relpath", "lineno", T.clipped(F.trim("line"), 100).alias("snippet"))
    place = Window.partitionBy("id", "name").orderBy("relpath", "lineno", "line")
    least = hits.select("id", "name", "relpath", "lineno", "line").withColumn("k", F.row_number().over(place)).where("k <= 3")
    first = least.groupBy("id", "name").agg(F.array_sort(F.collect_list(at)).alias("first"))
    return hits.groupBy("id", "name").agg(F.count("*").alias("n")).join(first, ["id", "name"])


def _flag(lines: DataFrame, check_id: str, rule: Column, kinds: tuple[str, ...], severity: Column | str = "warning") -> DataFrame:
    hits = lines.where(F.col("kind").isin(*kinds) & rule)
    return _emit(hits, check_id, severity)


def _emit(hits: DataFrame, check_id: str, severity: Column | str, extra: Column | None = None) -> DataFrame:
    shown = F.transform("first", lambda h: F.concat(h["relpath"], F.lit(":"), h["lineno"].cast("string"), F.lit(": "), h["snippet"]))
    detail = F.concat(F.array_join(shown, "\n"), F.when(F.col("n") > 3, F.concat(F.lit("\n(and "), F.col("n") - 3, F.lit(" more)"))).otherwise(""))
    name = F.col("name") if extra is None else extra
    return finding(evidence(hits), check_id, severity, F.array("id"), F.array("name"), F.array().cast("array<string>"), detail, F.array(T.sha(F.array_join(shown, "\n"))), name)


ALL, PROSE, SCRIPT = ("skillmd", "script", "prose"), ("skillmd", "prose"), ("script",)


def injection_unicode(lines: DataFrame) -> DataFrame:
    scanned = F.when((F.col("lineno") == 1) & F.col("line").startswith("\ufeff"), F.expr("substring(line, 2)")).otherwise(F.col("line"))
    return _flag(lines, "injection-unicode", X.suspect_characters(scanned), ALL, "error")


def injection_encoded_blob(lines: DataFrame) -> DataFrame:
    return _flag(lines, "injection-encoded-blob", X.encoded_blob(F.col("line")), ALL)


def injection_override(lines: DataFrame) -> DataFrame:
    return _flag(lines, "injection-override", X.override(F.col("line")), PROSE)


def injection_remote_fetch(lines: DataFrame) -> DataFrame:
    return _flag(lines, "injection-remote-fetch", X.remote_fetch(F.col("line")), PROSE)


def injection_egress(lines: DataFrame) -> DataFrame:
    return _flag(lines, "injection-egress", X.egress(F.col("line")), SCRIPT)


def injection_credential_read(lines: DataFrame) -> DataFrame:
    """An error where a credential store is read, a warning where only an environment file is."""
    store, env = X.credential_store(F.col("line")), X.env_file(F.col("line"))
    hits = lines.where(F.col("kind").isin(*SCRIPT) & (store | env))
    stored = hits.where(store).select("id").distinct()
    return _emit(hits.join(stored, "id", "left_semi"), "injection-credential-read", "error").unionByName(_emit(hits.join(stored, "id", "left_anti"), "injection-credential-read", "warning"))


def injection_mandatory_script(lines: DataFrame, bundled: DataFrame) -> DataFrame:
    """Body lines that demand a run and then name one of the skill's own files (bundled: id, relpath)."""
    names = bundled.select("id", F.explode(F.array("relpath", F.element_at(F.split("relpath", "/"), -1))).alias("file")).where("length(file) >= 3").distinct()
    framed = lines.where((F.col("kind") == "skillmd") & (F.col("lineno") >= F.col("body_start")) & X.found(F.col("line"), X.MANDATORY, True))
    rest = F.lit(None).cast("string")
    for p in reversed(X.MANDATORY):  # what follows the first framing that matches
        rest = F.when(F.col("line").rlike("(?Usi)" + p), F.regexp_extract("line", f"(?Usi){p}(.*)$", p.count("(") - p.count("(?") + 1)).otherwise(rest)
    met = framed.withColumn("rest", rest).join(names, "id").where(F.regexp_like("rest", F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.col("file"), F.lit(r"\E(?!\w)"))))
    return _emit(met.select(*lines.columns).distinct(), "injection-mandatory-script", "warning")


def commands(texts: DataFrame) -> DataFrame:
    """id, name, relpath, lineno, command of the shell commands embedded in skill texts (id, name, relpath, text)."""
    return texts.select("id", "name", "relpath", F.explode(T.extract_commands(F.coalesce("text", F.lit("")))).alias("c")).select("id", "name", "relpath", "c.lineno", F.col("c.command").alias("command"))


def shell_unreviewed(cmds: DataFrame, acks: DataFrame) -> DataFrame:
    """A note for each skill with commands; a warning if it was acknowledged with another set of commands.

    acks: check_id, name, fingerprint. A prior acknowledgement that another skill of the name explains does not count.
    """
    own = cmds.groupBy("id", "name").agg(F.array_sort(F.collect_list("command")).alias("cs"), F.count("*").alias("n"))
    fp = T.fingerprint("injection-shell-unreviewed", F.transform("cs", T.sha), F.col("name"))
    keyed = own.withColumn("fp", fp)
    prior = acks.where("check_id = 'injection-shell-unreviewed'").groupBy("name").agg(F.collect_set("fingerprint").alias("prior"))
    others = keyed.select("name", F.col("id").alias("other"), F.col("fp").alias("other_fp"))
    explained = keyed.join(prior, "name").join(others, "name").where("id <> other and array_contains(prior, other_fp)").select("id").distinct().withColumn("explained", F.lit(True))
    judged = keyed.join(prior, "name", "left").join(explained, "id", "left")
    changed = F.col("prior").isNotNull() & ~F.array_contains("prior", F.col("fp")) & F.col("explained").isNull()
    severity = F.when(F.coalesce(changed, F.lit(False)), "warning").otherwise("note")
    return finding(judged, "injection-shell-unreviewed", severity, F.array("id"), F.array("name"), F.array().cast("array<string>"), F.array_join("cs", "\n"), F.transform("cs", T.sha), F.col("name"))


def command_changes(approved: DataFrame, current: DataFrame) -> DataFrame:
    """Multiset difference of (id, command): sign - or +."""
    gone = approved.select("id", "command").exceptAll(current.select("id", "command")).withColumn("sign", F.lit("-"))
    return gone.unionByName(current.select("id", "command").exceptAll(approved.select("id", "command")).withColumn("sign", F.lit("+")))


def shell_dangerous(cmds: DataFrame) -> DataFrame:
    """Commands that read credentials, pipe to a shell, talk to the network or hold blobs; one finding each category."""
    c = F.col("command")
    store = X.credential_store(c) | X.reads_env_secret(c)
    piped = X.pipe_to_shell(c)
    clean = X.drop(c, X.LOCAL_URL)
    only_local = X.found(c, "https?://") & ~X.found(clean, "https?://")
    talks = ~piped & X.egress(clean) & ~only_local
    hits = cmds.withColumn("line", c)
    extra = lambda name: F.concat_ws("|", "name", F.lit(name))
    reads = hits.where(store | X.env_file(c))
    stored = hits.where(store).select("id").distinct()
    return (
        _emit(reads.join(stored, "id", "left_semi"), "injection-shell-dangerous", "error", extra("credential-read"))
        .unionByName(_emit(reads.join(stored, "id", "left_anti"), "injection-shell-dangerous", "warning", extra("credential-read")))
        .unionByName(_emit(hits.where(piped), "injection-shell-dangerous", "error", extra("pipe-to-shell")))
        .unionByName(_emit(hits.where(talks), "injection-shell-dangerous", "warning", extra("egress")))
        .unionByName(_emit(hits.where(X.encoded_blob(c)), "injection-shell-dangerous", "warning", extra("encoded-blob")))
    )


CATEGORIES = (("unicode", "error"), ("credential-read", "error"), ("override", "warning"), ("encoded-blob", "warning"), ("remote-fetch", "warning"), ("cross-tool", "warning"))


def tool_hits(tools: DataFrame) -> DataFrame:
    """server, tool, category, line of tool text (config_hash, tool, description, schema_text) that a category flags."""
    segments = F.concat(F.array(F.coalesce("tool", F.lit("")), F.coalesce("description", F.lit(""))), F.coalesce("schema_text", F.array().cast("array<string>")))
    lines = tools.select("config_hash", "tool", F.explode(F.flatten(F.transform(segments, T.split_lines))).alias("line")).where("trim(line) <> ''")
    line = F.col("line")
    rules = {"unicode": X.suspect_characters(line), "credential-read": X.credential_store(line), "override": X.override(line), "encoded-blob": X.encoded_blob(line), "remote-fetch": X.remote_fetch(line), "cross-tool": X.cross_tool(line)}
    flagged = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return lines.withColumn("category", F.explode(flagged))


def tool_poisoning(tools: DataFrame, servers: DataFrame) -> DataFrame:
    known = servers.groupBy("config_hash").agg(F.min_by("name", "seq").alias("server"), F.array_sort(F.collect_set("harness")).alias("harnesses"), F.array_sort(F.collect_set("source")).alias("sources"))
    hits = tool_hits(tools).groupBy("config_hash", "category").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("tool")).alias("hit_tools")).join(known, "config_hash")
    severity = F.when(F.col("category").isin("unicode", "credential-read"), "error").otherwise("warning")
    detail = F.concat_ws(" ", "category", F.col("n").cast("string"))
    return finding(hits, "mcp-tool-poisoning", severity, F.col("sources"), F.array("server"), F.col("harnesses"), detail, F.concat(F.array("server", "category"), F.col("hit_tools")))
