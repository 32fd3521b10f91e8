"""Tool-server configurations: parsing, secrets, pins, scopes, divergence, tool sets and their drift.

servers: seq, name, harness, scope, in_project, source, transport, command, args, url, env_names, suspect_env, config_hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import lexicons as X
from larkspur.functions import text as T

from .findings import finding
from .resolution import scope_winner

RUNNERS = ["npx", "uvx", "bunx", "pnpm"]
LOCAL_HOSTS = ["localhost", "127.0.0.1", "[::1]", "0.0.0.0"]


def json_string(c: Column) -> Column:
    """An ASCII JSON string literal or null: UTF-16 units beyond printable ASCII as \\uXXXX."""
    units = F.regexp_extract_all(F.hex(F.encode(c, "UTF-16BE")), F.lit("[0-9A-F]{4}"), F.lit(0))

    def one(u: Column) -> Column:
        short = F.when(u == "0022", F.lit('\\"')).when(u == "005C", F.lit("\\\\"))
        for code, letter in (("000A", "n"), ("000D", "r"), ("0009", "t"), ("0008", "b"), ("000C", "f")):
            short = short.when(u == code, F.lit("\\" + letter))
        return short.when((u >= "0020") & (u <= "007E"), F.char(F.conv(u, 16, 10).cast("int"))).otherwise(F.concat(F.lit("\\u"), F.lower(u)))

    return F.coalesce(F.concat(F.lit('"'), F.array_join(F.transform(units, one), ""), F.lit('"')), F.lit("null"))


def json_list(c: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(c, json_string), ", "), F.lit("]"))


def config_hash(name: Column, transport: Column, command: Column, args: Column, url: Column, env_names: Column) -> Column:
    """sha256 of the sorted-key JSON of an entry; environment values never enter it."""
    parts = {"args": json_list(args), "command": json_string(command), "env_names": json_list(env_names), "name": json_string(name), "transport": json_string(transport), "url": json_string(url)}
    body = F.concat_ws(", ", *[F.concat(F.lit(f'"{k}": '), v) for k, v in parts.items()])
    return F.sha2(F.concat(F.lit("{"), body, F.lit("}")).cast("binary"), 256)


def parse_servers(configs: DataFrame) -> DataFrame:
    """Server rows of configs (seq, harness, scope, in_project, source, text as JSON with mcpServers or servers)."""
    entries = configs.withColumn("v", F.expr("try_parse_json(text)")).where("v is not null")
    block = F.expr("coalesce(variant_get(v, '$.mcpServers', 'map<string,variant>'), variant_get(v, '$.servers', 'map<string,variant>'))")
    each = entries.select("seq", "harness", "scope", "in_project", "source", F.explode(block).alias("name", "e")).where("schema_of_variant(e) like 'OBJECT%'")
    url = F.expr("coalesce(try_variant_get(e, '$.url', 'string'), try_variant_get(e, '$.serverUrl', 'string'))")
    env = F.coalesce(F.expr("try_variant_get(e, '$.env', 'map<string,string>')"), F.expr("map()").cast("map<string,string>"))
    shaped = each.select(
        "seq", "name", "harness", "scope", "in_project", "source", F.when(F.coalesce(url, F.lit("")) != "", "http").otherwise("stdio").alias("transport"), F.expr("try_variant_get(e, '$.command', 'string')").alias("command"),
        F.coalesce(F.expr("try_variant_get(e, '$.args', 'array<string>')"), F.array().cast("array<string>")).alias("args"), url.alias("url"), F.array_sort(F.map_keys(env)).alias("env_names"),
        F.array_sort(F.map_keys(F.map_filter(env, X.looks_secret))).alias("suspect_env"),
    )
    return shaped.withColumn("config_hash", config_hash(*[F.col(c) for c in ("name", "transport", "command", "args", "url", "env_names")]))


def config_errors(configs: DataFrame) -> DataFrame:
    return configs.where(F.expr("try_parse_json(text)").isNull()).select("harness", F.col("source").alias("path"), F.lit("not JSON").alias("message"), "in_project")


def _server(df: DataFrame, check_id: str, severity: Column | str, detail: Column, parts: Column | None = None) -> DataFrame:
    return finding(df, check_id, severity, F.array("source"), F.array("name"), F.array("harness"), detail, F.array("name", "config_hash") if parts is None else parts)


def config_invalid(errors: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    return finding(errors, "mcp-config-invalid", "error", F.array("path"), none, F.array("harness"), F.col("message"), F.array("harness", "path"))


def secret_in_config(servers: DataFrame) -> DataFrame:
    held = servers.where(F.size("suspect_env") > 0)
    return _server(held, "mcp-secret-in-config", F.when(F.col("in_project"), "error").otherwise("warning"), F.array_join("suspect_env", ", "), F.concat(F.array("name", "source"), "suspect_env"))


def package_of(args: Column) -> Column:
    """The package a runner installs: a --package= or -p value first, else the first plain argument."""
    named = F.filter(F.transform(args, lambda a, i: F.when(a.startswith("--package="), F.regexp_replace(a, "^--package=", "")).when(a.isin("--package", "-p") & (i + 1 < F.size(args)), F.get(args, i + 1))), lambda x: x.isNotNull())
    plain = F.filter(args, lambda a: ~a.startswith("-") & ~a.isin("dlx", "exec"))
    return F.coalesce(F.get(named, F.lit(0)), F.get(plain, F.lit(0)))


def pinned(package: Column) -> Column:
    base, version = F.regexp_extract(package, "^(.*)@([^@]*)$", 1), F.regexp_extract(package, "^(.*)@([^@]*)$", 2)
    return ((base != "") & ~version.isin("", "latest")) | F.contains(package, F.lit("=="))


def unpinned_server(servers: DataFrame) -> DataFrame:
    run = servers.where(F.element_at(F.split("command", "/"), -1).isin(RUNNERS)).withColumn("package", package_of(F.col("args")))
    return _server(run.where(F.col("package").isNotNull() & ~pinned(F.col("package"))), "mcp-unpinned-server", "warning", F.col("package"))


def url_host(url: Column) -> Column:
    hostport = F.split_part(F.regexp_replace(url, "^http://", ""), F.lit("/"), F.lit(1))
    return F.when(hostport.rlike(r"^\[.*\]"), F.regexp_extract(hostport, r"^(\[[^\]]*\])", 1)).otherwise(F.split_part(hostport, F.lit(":"), F.lit(1)))


def insecure_url(servers: DataFrame) -> DataFrame:
    return _server(servers.where(F.col("url").startswith("http://") & ~url_host(F.col("url")).isin(LOCAL_HOSTS)), "mcp-insecure-url", "warning", F.col("url"))


def dead_server(servers: DataFrame, executables: DataFrame) -> DataFrame:
    """stdio servers whose command is neither an existing absolute path nor on the path; executables: command."""
    judged = servers.where((F.col("transport") == "stdio") & (F.col("command") != "") & (F.col("command").startswith("/") | ~F.contains("command", F.lit("/"))))
    return _server(judged.join(executables, "command", "left_anti"), "mcp-dead-server", "error", F.col("command"))


def shadowed_server(servers: DataFrame) -> DataFrame:
    groups = servers.groupBy("harness", "name").agg(F.count_distinct("scope").alias("scopes"), F.count_distinct("config_hash").alias("kinds"), F.min_by("source", "seq").alias("source"), F.array_sort(F.collect_set("config_hash")).alias("hashes"))
    return finding(groups.where("scopes = 2 and kinds > 1"), "mcp-shadowed-server", "warning", F.array("source"), F.array("name"), F.array("harness"), F.col("kinds"), F.concat(F.array("name", "harness"), "hashes"))


def diverged_server(servers: DataFrame, harnesses: DataFrame) -> DataFrame:
    """Names whose winning entries differ between harnesses, with the fields that do."""
    best = scope_winner(servers, harnesses)
    fields = {"command": "command", "args": "args", "url": "url", "env_names": "env_names"}
    groups = best.groupBy("name").agg(
        F.count_distinct("config_hash").alias("kinds"), F.count_distinct("harness").alias("hs"), F.array_sort(F.collect_set("harness")).alias("harnesses"), F.array_sort(F.collect_set("source")).alias("sources"), F.array_sort(F.collect_set("config_hash")).alias("hashes"),
        *[F.count_distinct(F.coalesce(F.to_json(F.struct(c)), F.lit(""))).alias(f"n_{k}") for k, c in fields.items()],
    ).where("kinds > 1 and hs > 1")
    differing = F.array_compact(F.array(*[F.when(F.col(f"n_{k}") > 1, F.lit(k)) for k in fields]))
    detail = F.when(F.size(differing) > 0, F.array_join(differing, ", ")).otherwise("config")
    return finding(groups, "mcp-diverged-server", "warning", F.col("sources"), F.array("name"), F.col("harnesses"), detail, F.concat(F.array("name"), "hashes"))


def connect_failed(failures: DataFrame) -> DataFrame:
    return finding(failures, "mcp-connect-failed", "warning", F.array(F.concat_ws(":", F.lit("mcp"), "harness", "name")), F.array("name"), F.array("harness"), F.col("message"), F.array("harness", "name", "message"))


def current_tools(tools: DataFrame, servers: DataFrame) -> DataFrame:
    """Tools of configurations that still exist."""
    return tools.join(servers.select("config_hash").distinct(), "config_hash", "left_semi")


def tool_collision(tools: DataFrame, servers: DataFrame) -> DataFrame:
    loaded = tools.select("config_hash", "tool").distinct().join(servers.select("config_hash", "harness").distinct(), "config_hash")
    clash = loaded.groupBy("tool", "harness").agg(F.count_distinct("config_hash").alias("n"), F.collect_set("config_hash").alias("cs")).where("n > 1")
    per = clash.groupBy("tool").agg(F.array_sort(F.collect_list("harness")).alias("harnesses"))
    every = tools.groupBy("tool").agg(F.array_sort(F.collect_set(F.concat_ws(":", "config_hash", "tool"))).alias("ids"))
    return finding(per.join(every, "tool"), "mcp-tool-collision", "warning", F.col("ids"), F.array("tool"), F.col("harnesses"), F.col("tool"), F.concat(F.array("tool"), "harnesses"))


def diff_tools(approved: DataFrame, current: DataFrame) -> DataFrame:
    """config_hash, tool, change (added, removed, description, schema) between two tool sets."""
    a, b = approved.alias("a"), current.alias("b")
    both = a.join(b, (F.col("a.config_hash") == F.col("b.config_hash")) & (F.col("a.tool") == F.col("b.tool")), "full_outer")
    change = (
        F.when(F.col("a.tool").isNull(), "added").when(F.col("b.tool").isNull(), "removed").when(~F.col("a.description").eqNullSafe(F.col("b.description")), "description").when(~F.col("a.schema_text").eqNullSafe(F.col("b.schema_text")), "schema")
    )
    return both.select(F.coalesce("a.config_hash", "b.config_hash").alias("config_hash"), F.coalesce("a.tool", "b.tool").alias("tool"), change.alias("change")).where("change is not null")


def tools_unreviewed(tools: DataFrame, servers: DataFrame, acks: DataFrame) -> DataFrame:
    """A note for each tool set; a warning if it changed since it was acknowledged, a note again if only schema text
    was not yet part of what was acknowledged. acks: check_id, name, fingerprint."""
    known = servers.groupBy("config_hash").agg(F.min_by("name", "seq").alias("server"), F.array_sort(F.collect_set("harness")).alias("harnesses"), F.array_sort(F.collect_set("source")).alias("sources"))
    full = F.concat_ws("\n", "tool", "description", F.array_join(F.coalesce("schema_text", F.array().cast("array<string>")), "\n"))
    sets = tools.groupBy("config_hash").agg(F.array_sort(F.collect_list(full)).alias("full"), F.array_sort(F.collect_list(F.concat_ws("\n", "tool", "description"))).alias("plain"), F.count("*").alias("n")).join(known, "config_hash")
    base = F.array("server", "config_hash")
    keyed = sets.withColumn("fp", T.fingerprint("mcp-tools-unreviewed", F.concat(base, "full"))).withColumn("old", T.fingerprint("mcp-tools-unreviewed", F.concat(base, "plain")))
    prior = acks.where("check_id = 'mcp-tools-unreviewed'").groupBy(F.col("name").alias("server")).agg(F.collect_set("fingerprint").alias("prior"))
    judged = keyed.join(prior, "server", "left")
    changed = F.coalesce(F.col("prior").isNotNull() & ~F.array_contains("prior", F.col("fp")), F.lit(False))
    extended = F.coalesce(F.array_contains("prior", F.col("old")), F.lit(False))
    severity = F.when(changed & ~extended, "warning").otherwise("note")
    detail = F.concat_ws(" ", F.when(changed & extended, "extended").when(changed, "changed").otherwise("new"), F.col("n").cast("string"))
    return finding(judged, "mcp-tools-unreviewed", severity, F.col("sources"), F.array("server"), F.col("harnesses"), detail, F.concat(base, "full"))
