"""Manifest rules over JSON documents held as variants. Each rule yields a stable reason; failing reasons are exploded.

documents: root, text (and what a check names besides). listing: root, relpath, is_dir, is_symlink, resolved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import lexicons as X
from larkspur.functions import text as T

from .findings import finding

# What the formats allow.
SCHEMA = "https://agent-plugins.org/schemas/1.0.0/plugin.schema.json"
KNOWN = ["$schema", "name", "version", "description", "author", "homepage", "repository", "license", "keywords", "extensions"]
CC_KNOWN = [
    "$schema", "name", "version", "displayName", "description", "author", "homepage", "repository", "license", "keywords", "metadata", "defaultEnabled", "userConfig", "channels", "dependencies", "settings",
    "skills", "commands", "agents", "workflows", "hooks", "mcpServers", "lspServers", "outputStyles", "themes", "monitors", "experimental",
]
PATHS = ["skills", "commands", "agents", "workflows", "outputStyles", "themes", "monitors"]
INLINE = ["hooks", "mcpServers", "lspServers"]
SOURCES = {"github": ["repo"], "url": ["url"], "git-subdir": ["url", "path"], "npm": ["package"], "archive": ["url"], "command": ["command"]}
KEBAB = r"^[a-z0-9]+(-[a-z0-9]+)*$"
NAMESPACE = r"^[a-z0-9]([a-z0-9-]*[a-z0-9])?(\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)+$"
PLACEHOLDER = r"\$\{(PLUGIN_ROOT|PLUGIN_DATA)\}"
CWD = r"^(\./|\$\{PLUGIN_ROOT\}(/|$)|\$\{PLUGIN_DATA\}(/|$))"
TRANSPORTS = ["stdio", "streamable-http", "sse"]
LOOPBACK = ["localhost", "127.0.0.1", "::1", "[::1]"]


def parsed(documents: DataFrame) -> DataFrame:
    return documents.withColumn("v", F.expr("try_parse_json(text)"))


def get(path: str, of: str = "v") -> Column:
    return F.expr(f"variant_get({of}, '{path}', 'variant')")


def kind(c: Column) -> Column:
    """object, array, string, number, boolean, null (JSON null) or SQL null where there is nothing."""
    name = F.schema_of_variant(c)
    return F.when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").when(name == "STRING", "string").when(name == "BOOLEAN", "boolean").when(name == "VOID", "null").when(name.isNotNull(), "number")


def string(path: str, of: str = "v") -> Column:
    """The string there, null if it is anything else."""
    return F.when(kind(get(path, of)) == "string", F.expr(f"try_variant_get({of}, '{path}', 'string')"))


def given(path: str, of: str = "v") -> Column:
    return F.coalesce(kind(get(path, of)), F.lit("null")) != "null"


def strings_only(path: str, of: str = "v", shape: str = "array") -> Column:
    """Whether there is a list (or object) of strings only."""
    name = F.schema_of_variant(get(path, of))
    whole = F.when(name.startswith("ARRAY"), name.isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.contains(F.coalesce(F.to_json(get(path, of)), F.lit("")), F.lit("null"))) if shape == "array" else F.when(name.startswith("OBJECT"), ~name.rlike(r": (?!STRING[,>])"))
    return F.coalesce(whole, F.lit(False))


def explode_rules(df: DataFrame, rules: list[tuple[Column | str, str, Column]]) -> DataFrame:
    """One row for each rule (reason, severity, condition) that holds."""
    held = [F.when(F.coalesce(cond, F.lit(False)), F.struct((F.lit(r) if isinstance(r, str) else r).alias("reason"), F.lit(sev).alias("severity"))) for r, sev, cond in rules]
    return df.withColumn("f", F.explode(F.array_compact(F.array(*held)))).withColumn("reason", F.col("f.reason")).withColumn("severity", F.col("f.severity")).drop("f")


def _found(df: DataFrame, check_id: str, name: Column | None = None) -> DataFrame:
    names = F.array().cast("array<string>") if name is None else F.array(name)
    return finding(df, check_id, F.col("severity"), F.array("root"), names, F.array().cast("array<string>"), F.col("reason"), F.array(T.sha(F.col("text"))), F.col("reason"))


# ---- server manifests of plugins ----


def _entries(documents: DataFrame) -> DataFrame:
    whole = parsed(documents).where("v is not null")
    block = F.expr("try_variant_get(v, '$.mcpServers', 'map<string,variant>')")
    return whole.select("root", "text", F.explode(block).alias("name", "e")).where(kind(F.col("e")) == "object")


def mcp_spec_invalid(documents: DataFrame, listing: DataFrame) -> DataFrame:
    whole = parsed(documents).where("v is not null")
    top = explode_rules(whole, [("missing-schema", "error", string("$.$schema").isNull()), ("servers-not-object", "error", F.coalesce(kind(get("$.mcpServers")), F.lit("null")) != "object")])
    kept = listing.select("root", F.col("relpath").alias("rel")).distinct()
    e = _entries(documents).withColumn("command", string("$.command", "e")).withColumn("rel", F.when(F.col("command").startswith("./"), F.expr("substring(command, 3)")))
    e = e.join(kept.withColumn("there", F.lit(True)), ["root", "rel"], "left").withColumn("type", string("$.type", "e")).withColumn("url", string("$.url", "e"))
    known = F.coalesce(F.col("type").isin(TRANSPORTS), F.lit(False))
    stdio, web = known & (F.col("type") == "stdio"), known & (F.col("type") != "stdio")
    command, url = F.col("command"), F.col("url")
    spaced = command.rlike(r"(?U)\s")
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    user = F.when(F.contains(authority, F.lit("@")), F.regexp_extract(authority, r"^(.*)@", 1)).otherwise("")
    bare = F.regexp_replace(authority, r"^.*@", "")
    host = F.lower(F.when(bare.startswith("["), F.regexp_extract(bare, r"^\[([^\]]*)\]", 1)).otherwise(F.split_part(bare, F.lit(":"), F.lit(1))))
    absolute = scheme.isin("http", "https")
    has_url = F.coalesce(url, F.lit("")) != ""
    rules = explode_rules(
        e,
        [
            ("args-invalid", "error", given("$.args", "e") & ~strings_only("$.args", "e")), ("env-invalid", "error", given("$.env", "e") & ~strings_only("$.env", "e", "object")), ("headers-invalid", "error", given("$.headers", "e") & ~strings_only("$.headers", "e", "object")),
            ("bad-transport", "error", ~known), ("command-missing", "error", stdio & (F.coalesce(command, F.lit("")) == "")), ("command-multi-token", "error", stdio & spaced), ("command-rel-missing", "error", stdio & ~spaced & command.startswith("./") & F.col("there").isNull()),
            ("command-bare-slash", "error", stdio & ~spaced & ~command.startswith("./") & F.contains(command, F.lit("/")) & ~command.rlike(PLACEHOLDER)), ("url-missing", "error", web & ~has_url), ("url-scheme", "error", web & has_url & ~absolute),
            ("url-userinfo", "error", web & absolute & ~user.isin("", ":")), ("url-fragment", "error", web & absolute & url.rlike("#.")), ("url-plain-http", "error", web & (scheme == "http") & ~host.isin(LOOPBACK)),
        ],
    )
    return _found(top, "mcp-spec-invalid", F.lit("mcp.json")).unionByName(_found(rules, "mcp-spec-invalid", F.col("name")))


def mcp_spec_placeholder(documents: DataFrame) -> DataFrame:
    e = _entries(documents)
    maps = {c: F.coalesce(F.expr(f"try_variant_get(e, '$.{c}', 'map<string,variant>')"), F.expr("map()").cast("map<string,variant>")) for c in ("env", "headers")}
    fixed = explode_rules(e, [
        ("placeholder-command", "error", string("$.command", "e").rlike(PLACEHOLDER)),
        ("cwd-form", "error", (string("$.type", "e") == "stdio") & string("$.cwd", "e").isNotNull() & ~string("$.cwd", "e").rlike(CWD)),
    ])
    keys = e.select("root", "text", "name", F.explode(F.map_keys(maps["env"])).alias("k"))
    reserved = F.col("k").isin("PLUGIN_ROOT", "PLUGIN_DATA")
    env = explode_rules(keys, [(F.concat(F.lit("env-reserved:"), "k"), "error", reserved), (F.concat(F.lit("env-key-placeholder:"), "k"), "error", ~reserved & F.col("k").rlike(PLACEHOLDER))])
    pairs = e.select("root", "text", "name", F.explode(maps["headers"]).alias("k", "h"))
    headers = explode_rules(pairs, [(F.concat(F.lit("header-placeholder:"), "k"), "warning", (kind(F.col("h")) == "string") & F.expr("try_variant_get(h, '$', 'string')").rlike(PLACEHOLDER))])
    columns = ["root", "text", "name", "reason", "severity"]
    return _found(fixed.select(columns).unionByName(env.select(columns)).unionByName(headers.select(columns)), "mcp-spec-placeholder", F.col("name"))


# ---- plugin manifests ----


def valid_plugin_name(c: Column) -> Column:
    return c.rlike(r"^[a-z0-9.-]{1,64}$") & ~c.rlike(r"^[.-]|[.-]$|[.-]{2}")


def plugin_manifest_invalid(documents: DataFrame) -> DataFrame:
    ok = F.col("v").isNotNull()
    rules = [("parse-error", "error", ~ok), ("$schema", "error", ok & string("$.$schema").isNull()), ("name", "error", ok & string("$.name").isNull())]
    rules += [(f, "error", ok & given(f"$.{f}") & string(f"$.{f}").isNull()) for f in ("version", "description", "homepage", "repository", "license")]
    rules += [("keywords", "error", ok & given("$.keywords") & ~strings_only("$.keywords")), ("author", "error", ok & given("$.author") & (kind(get("$.author")) != "object"))]
    return _found(explode_rules(parsed(documents), rules), "plugin-manifest-invalid")


def plugin_name_invalid(documents: DataFrame) -> DataFrame:
    own = parsed(documents).withColumn("reason", string("$.name")).where(F.col("reason").isNotNull() & ~valid_plugin_name(F.col("reason"))).withColumn("severity", F.lit("error"))
    return _found(own, "plugin-name-invalid")


def _unknown(documents: DataFrame, known: list[str], check_id: str, extra: list[tuple[str, str, Column]]) -> DataFrame:
    whole = parsed(documents).where("v is not null")
    keys = F.array_except(F.map_keys(F.expr("try_variant_get(v, '$', 'map<string,variant>')")), T.words_in(known))
    own = whole.select("root", "text", "v", F.explode(keys).alias("reason")).withColumn("severity", F.lit("warning"))
    out = own.drop("v")
    if extra:
        out = out.unionByName(explode_rules(whole, extra).select("root", "text", "reason", "severity"))
    return _found(out, check_id)


def plugin_unknown_field(documents: DataFrame) -> DataFrame:
    return _unknown(documents, KNOWN, "plugin-manifest-unknown-field", [("extensions", "warning", F.expr("variant_get(v, '$.extensions', 'variant')").isNotNull() & (kind(get("$.extensions")) != "object"))])


def plugin_schema_unknown(documents: DataFrame) -> DataFrame:
    own = parsed(documents).withColumn("reason", string("$.$schema")).where(F.col("reason") != SCHEMA).withColumn("severity", F.lit("warning"))
    return _found(own, "plugin-schema-unknown")


def plugin_skill_undiscoverable(documents: DataFrame, listing: DataFrame) -> DataFrame:
    """Folders below skills without a skill file anywhere in them, and skill files nested too deep."""
    files = listing.join(documents.select("root", "text").distinct(), "root")
    children = files.where(F.col("is_dir") & F.col("relpath").rlike("^skills/[^/]+$"))
    deep = files.where(~F.col("is_dir") & F.col("relpath").rlike("^skills/(.*/)?SKILL\\.md$"))
    held = deep.select("root", F.regexp_extract("relpath", "^(skills/[^/]+)/", 1).alias("relpath")).distinct()
    empty = children.join(held, ["root", "relpath"], "left_anti").select("root", "text", F.col("relpath").alias("reason"))
    nested = deep.where(~F.col("relpath").rlike("^skills/[^/]+/SKILL\\.md$")).select("root", "text", F.col("relpath").alias("reason"))
    return _found(empty.unionByName(nested).withColumn("severity", F.lit("warning")), "plugin-skill-undiscoverable")


def plugin_path_escape(documents: DataFrame, listing: DataFrame) -> DataFrame:
    links = listing.where(F.col("is_symlink") & (F.col("resolved") != F.col("root")) & ~F.col("resolved").startswith(F.concat("root", F.lit("/"))))
    own = links.join(documents.select("root", "text").distinct(), "root").select("root", "text", F.col("relpath").alias("reason"), F.lit("error").alias("severity"))
    return _found(own, "plugin-path-escape")


def secret_keys(text: Column) -> Column:
    """Keys anywhere in a JSON text whose string values look like secrets."""
    pairs = F.regexp_extract_all(text, F.lit(r'"((?:[^"\\]|\\.)*)"\s*:\s*"((?:[^"\\]|\\.)*)"'), F.lit(0))
    key = lambda p: F.regexp_extract(p, r'^"((?:[^"\\]|\\.)*)"', 1)
    value = lambda p: F.regexp_extract(p, r':\s*"((?:[^"\\]|\\.)*)"$', 1)
    return F.array_sort(F.array_distinct(F.transform(F.filter(pairs, lambda p: X.looks_secret(key(p), value(p))), key)))


def plugin_extension_hygiene(documents: DataFrame, listing: DataFrame, files: DataFrame) -> DataFrame:
    """Top-level folders with a dot that are no namespace, or hold portable parts; secrets in their JSON up to 256 KiB.

    files: root, relpath, size, content (text of JSON files).
    """
    own = documents.select("root", "text").distinct()
    tops = listing.where(F.col("is_dir") & ~F.contains("relpath", F.lit("/")) & F.contains("relpath", F.lit(".")) & ~F.col("relpath").startswith(".") & (F.col("relpath") != "skills")).select("root", F.col("relpath").alias("top"))
    portable = listing.where(~F.col("is_dir") & F.col("relpath").rlike(r"^[^/]+/(mcp\.json|skills/[^/]+/SKILL\.md)$")).select("root", F.split_part("relpath", F.lit("/"), F.lit(1)).alias("top")).distinct().withColumn("portable", F.lit(True))
    folders = tops.join(own, "root").join(portable, ["root", "top"], "left")
    valid = F.col("top").rlike(NAMESPACE)
    bad = explode_rules(folders, [(F.col("top"), "warning", ~valid), (F.concat("top", F.lit(":shadow")), "warning", valid & F.col("portable"))]).select("root", "text", "reason", "severity")
    inside = files.where((F.col("size") <= 256 * 1024) & F.col("relpath").endswith(".json")).withColumn("top", F.split_part("relpath", F.lit("/"), F.lit(1))).join(tops, ["root", "top"], "left_semi")
    held = inside.where(F.expr("try_parse_json(content)").isNotNull()).withColumn("keys", secret_keys(F.col("content"))).where(F.size("keys") > 0)
    secrets = held.join(own, "root").select("root", "text", F.concat_ws(":", "relpath", F.array_join("keys", ",")).alias("reason"), F.lit("warning").alias("severity"))
    return _found(bad.unionByName(secrets), "plugin-extension-hygiene")


# ---- manifests of one client's plugins and marketplaces ----


def cc_manifest_invalid(documents: DataFrame) -> DataFrame:
    ok, name = F.col("v").isNotNull(), string("$.name")
    rules = [("parse-error", "error", ~ok), ("missing-name", "error", ok & (F.coalesce(name, F.lit("")) == "")), ("name-not-kebab", "error", ok & (name != "") & ~name.rlike(KEBAB))]
    for fields, kinds in ((PATHS, ["string", "array"]), (INLINE, ["string", "array", "object"])):
        rules += [(f"pointer-type:{f}", "error", ok & given(f"$.{f}") & ~kind(get(f"$.{f}")).isin(kinds)) for f in fields]
    return _found(explode_rules(parsed(documents), rules), "cc-manifest-invalid")


def cc_unknown_field(documents: DataFrame) -> DataFrame:
    return _unknown(documents, CC_KNOWN, "cc-manifest-unknown-field", [])


def _field(name: str):  # noqa: ANN202
    return lambda p: F.struct(F.lit(name).alias("field"), p.alias("path"))


def cc_component_missing(documents: DataFrame, listing: DataFrame) -> DataFrame:
    whole = parsed(documents).where("v is not null")
    one = lambda f: F.when(kind(get(f"$.{f}")) == "string", F.array(string(f"$.{f}"))).when(kind(get(f"$.{f}")) == "array", F.expr(f"try_variant_get(v, '$.{f}', 'array<string>')"))
    pairs = [F.transform(F.coalesce(one(f), F.array().cast("array<string>")), _field(f)) for f in PATHS + INLINE]
    named = whole.select("root", "text", F.explode(F.concat(*pairs)).alias("p")).select("root", "text", "p.field", "p.path").where("path is not null")
    clean = F.regexp_replace(F.regexp_replace("path", r"^(\./)+", ""), "/+$", "")
    there = listing.select("root", F.col("relpath").alias("clean")).distinct()
    gone = named.withColumn("clean", clean).where("clean <> ''").join(there, ["root", "clean"], "left_anti")
    return _found(gone.withColumn("reason", F.concat_ws(":", F.lit("missing"), "field", "path")).withColumn("severity", F.lit("error")), "cc-component-missing")


def cc_manifest_mismatch(documents: DataFrame, cc_documents: DataFrame) -> DataFrame:
    a = parsed(documents).where("v is not null").select("root", F.col("text").alias("t1"), *[string(f"$.{f}").alias(f"{f}1") for f in ("name", "version")])
    b = parsed(cc_documents).where("v is not null").select("root", F.col("text").alias("t2"), *[string(f"$.{f}").alias(f"{f}2") for f in ("name", "version")])
    both = a.join(b, "root").withColumn("text", F.concat("t1", F.lit("\x00"), "t2"))
    return _found(explode_rules(both, [(f"mismatch:{f}", "warning", F.col(f"{f}1") != F.col(f"{f}2")) for f in ("name", "version")]), "cc-manifest-mismatch")


def _plugins(documents: DataFrame) -> DataFrame:
    """Entries of marketplaces: root, text, i, e, ename, stype."""
    whole = parsed(documents).where("v is not null")
    entries = whole.select("root", "text", "v", F.posexplode(F.expr("try_variant_get(v, '$.plugins', 'array<variant>')")).alias("i", "e"))
    name = string("$.name", "e")
    ename = F.when(F.coalesce(name, F.lit("")) != "", T.one_line(name, 80)).otherwise(F.concat(F.lit("entry "), F.col("i").cast("string")))
    return entries.withColumn("ename", ename).withColumn("stype", string("$.source.source", "e"))


def marketplace_invalid(documents: DataFrame) -> DataFrame:
    ok, name = F.col("v").isNotNull(), string("$.name")
    top = explode_rules(parsed(documents), [
        ("parse-error", "error", ~ok), ("missing-name", "error", ok & (F.coalesce(name, F.lit("")) == "")), ("name-not-kebab", "error", ok & (name != "") & ~name.rlike(KEBAB)),
        ("missing-owner", "error", ok & (F.coalesce(string("$.owner.name"), F.lit("")) == "")), ("missing-plugins", "error", ok & (F.coalesce(kind(get("$.plugins")), F.lit("null")) != "array")),
    ])
    e = _plugins(documents)
    is_object = kind(F.col("e")) == "object"
    shape = F.coalesce(kind(get("$.source", "e")), F.lit("null"))
    own, stype, ename, at = string("$.name", "e"), F.col("stype"), F.col("ename"), F.col("i").cast("string")
    rules: list[tuple[Column | str, str, Column]] = [
        (F.concat(F.lit("entry-shape:"), at), "error", ~is_object), (F.concat(F.lit("entry-missing-name:"), at), "error", is_object & (F.coalesce(own, F.lit("")) == "")),
        (F.concat(F.lit("entry-name-not-kebab:"), own), "error", is_object & (own != "") & ~own.rlike(KEBAB)), (F.concat(F.lit("entry-missing-source:"), ename), "error", is_object & (shape == "null")),
        (F.concat(F.lit("unknown-source-type:"), ename), "warning", is_object & (shape == "object") & ~F.coalesce(stype.isin(list(SOURCES)), F.lit(False))), (F.concat(F.lit("source-shape:"), ename), "error", is_object & ~shape.isin("null", "object", "string")),
    ]
    for s, fields in SOURCES.items():
        rules += [(F.concat(F.lit("source-missing:"), ename, F.lit(f":{f}")), "error", is_object & (stype == s) & (F.coalesce(string(f"$.source.{f}", "e"), F.lit("")) == "")) for f in fields]
    columns = ["root", "text", "reason", "severity"]
    return _found(top.select(columns).unionByName(explode_rules(e, rules).select(columns)), "marketplace-invalid")


def marketplace_unpinned(documents: DataFrame) -> DataFrame:
    e = _plugins(documents).where(kind(get("$.source", "e")) == "object")
    stype, ename = F.col("stype"), F.col("ename")
    git = F.coalesce(stype.isin("github", "url", "git-subdir"), F.lit(False))
    sha = F.coalesce(string("$.source.sha", "e").rlike("^[0-9a-f]{40}$"), F.lit(False))
    ref = string("$.source.ref", "e").isNotNull()
    tls = [F.coalesce(string(f"$.source.{f}", "e").startswith("http://"), F.lit(False)) for f in ("url", "repo", "registry")]
    reason = lambda slug: F.concat(F.lit(f"{slug}:"), ename)
    rules = [(reason("insecure-url"), "warning", tls[0] | tls[1] | tls[2]), (reason("ref-only"), "note", git & ~sha & ref), (reason("unpinned"), "warning", git & ~sha & ~ref), (reason("npm-unpinned"), "warning", (stype == "npm") & string("$.source.version", "e").isNull()), (reason("archive-unpinned"), "warning", (stype == "archive") & string("$.source.sha256", "e").isNull())]
    return _found(explode_rules(e, rules), "marketplace-unpinned-source")


def marketplace_command(documents: DataFrame) -> DataFrame:
    e = _plugins(documents).where("stype = 'command'")
    return _found(e.withColumn("reason", F.concat(F.lit("command:"), "ename")).withColumn("severity", F.lit("warning")), "marketplace-command-source")


def marketplace_entry_missing(documents: DataFrame, listing: DataFrame) -> DataFrame:
    e = _plugins(documents).withColumn("src", string("$.source", "e")).where("src is not null")
    base = F.coalesce(F.concat(string("$.metadata.pluginRoot", "v"), F.lit("/")), F.lit(""))
    clean = F.regexp_replace(F.regexp_replace(F.concat(base, "src"), r"(^|/)(\./)+", "$1"), "/+$", "")
    folders = listing.where("is_dir").select("root", F.col("relpath").alias("clean")).distinct()
    gone = e.withColumn("clean", clean).where("clean <> '' and clean <> '.'").join(folders, ["root", "clean"], "left_anti")
    return _found(gone.withColumn("reason", F.concat(F.lit("missing:"), "ename", F.lit(":"), "src")).withColumn("severity", F.lit("error")), "marketplace-entry-missing")
