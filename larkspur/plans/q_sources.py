"""Queries that read what clients and packages write: traces, archives, lockfiles, paths, names, schemas; and findings by reference."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import structures as X
from larkspur.functions import text as T
from larkspur.operators import drift as D
from larkspur.operators import findings as FN
from larkspur.operators import resolution as R
from larkspur.operators import servers as V
from larkspur.plans import engine
from larkspur.sources import archives, configs, traces

from . import adapters as A
from .registry import query

# ---- traces: every conversation written as each client would write it, and read back ----

#: The event each turn becomes: its number of seconds after a fixed time is its turn.
STAMP = "2024-01-01T00:"
TURNS = """t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
asked AS (SELECT conv_id, k, max(CASE WHEN role = 'user' THEN k END) OVER (PARTITION BY conv_id ORDER BY k) AS q FROM t), tools AS (SELECT t.*, u.text AS query FROM t LEFT JOIN asked USING (conv_id, k) LEFT JOIN t u ON u.conv_id = t.conv_id AND u.k = asked.q WHERE t.role = 'assistant')"""


def _stamp(k: Column) -> Column:
    return F.concat(F.lit(STAMP), F.lpad(F.floor((k % 3600) / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0"), F.lit("Z"))


def _written(spark: SparkSession, d: str, line: Column, head: Column | None = None) -> DataFrame:
    """path, text: a file for each conversation, a line for each turn."""
    from pyspark.sql import Window

    own = A.table(spark, d, "conversations").withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).withColumn("said", F.coalesce("text", F.lit("")))
    files = own.withColumn("json", line).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "json"))), lambda x: x["json"]).alias("lines"))
    first = files.withColumn("lines", F.concat(F.array(head), "lines")) if head is not None else files
    return first.select(F.concat(F.lit("/s/c"), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("path"), F.array_join("lines", "\n").alias("text"))


def _told(df: DataFrame) -> DataFrame:
    return df.select("harness", "session_id", "project", "kind", "name", F.coalesce("server", F.lit("")).alias("server"), F.sha2(F.coalesce("query", F.lit("")).cast("binary"), 256).alias("query"), F.unix_timestamp("ts").alias("at"), "source_line")


def _expected(harness: str, project: str, line: str, tool: str = "'t' || CAST(k % 3 AS VARCHAR)", server: str = "'srv'", kind: str = "'mcp_tool'") -> str:
    return f"SELECT '{harness}' AS harness, 'c' || CAST(conv_id AS VARCHAR) AS session_id, {project} AS project, {kind} AS kind, {tool} AS name, {server} AS server, sha256(coalesce(query, '')) AS query, CAST(1704067200 + k % 3600 AS BIGINT) AS at, CAST({line} AS INTEGER) AS source_line FROM tools"


@query("WITH " + TURNS + " " + _expected("claude-code", "'/w'", "k", server="'srv'"))
def trace_claude_code(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    user = F.to_json(F.struct(F.lit("user").alias("type"), _stamp(k).alias("timestamp"), F.lit("/w").alias("cwd"), F.struct(F.col("said").alias("content")).alias("message")))
    call = F.struct(F.lit("tool_use").alias("type"), F.concat(F.lit("mcp__srv__t"), (k % 3).cast("string")).alias("name"))
    tool = F.to_json(F.struct(F.lit("assistant").alias("type"), _stamp(k).alias("timestamp"), F.lit("/w").alias("cwd"), F.struct(F.array(call).alias("content")).alias("message")))
    return _told(traces.claude_code(_written(spark, d, F.when(F.col("role") == "user", user).when(F.col("role") == "assistant", tool).otherwise("not json"))))


@query("WITH " + TURNS + " " + _expected("codex", "'/w'", "k + 1", "'sk' || CAST(k % 3 AS VARCHAR)", "''", "'skill'"))
def trace_codex(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    user = F.to_json(F.struct(F.lit("event_msg").alias("type"), _stamp(k).alias("timestamp"), F.struct(F.lit("user_message").alias("type"), F.col("said").alias("message")).alias("payload")))
    read = F.concat(F.lit('{"cmd": "cat /a/sk'), (k % 3).cast("string"), F.lit('/SKILL.md"}'))
    tool = F.to_json(F.struct(F.lit("response_item").alias("type"), _stamp(k).alias("timestamp"), F.struct(F.lit("function_call").alias("type"), read.alias("arguments")).alias("payload")))
    head = F.lit(json.dumps({"type": "session_meta", "timestamp": STAMP + "00:00Z", "payload": {"cwd": "/w"}}))
    return _told(traces.codex(_written(spark, d, F.when(F.col("role") == "user", user).when(F.col("role") == "assistant", tool).otherwise("[1]"), head)))


@query("WITH " + TURNS + " " + _expected("pi", "'/w'", "k + 1"))
def trace_pi(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    message = lambda role, block: F.to_json(F.struct(F.lit("message").alias("type"), _stamp(k).alias("timestamp"), F.struct(F.lit(role).alias("role"), F.array(block).alias("content")).alias("message")))
    user = message("user", F.struct(F.lit("text").alias("type"), F.col("said").alias("text")))
    tool = message("assistant", F.struct(F.lit("toolCall").alias("type"), F.concat(F.lit("mcp__srv__t"), (k % 3).cast("string")).alias("name")))
    head = F.lit(json.dumps({"type": "session", "cwd": "/w"}))
    return _told(traces.pi(_written(spark, d, F.when(F.col("role") == "user", user).when(F.col("role") == "assistant", tool).otherwise("{"), head)))


@query("WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) SELECT 'copilot' AS harness, 'c' || CAST(conv_id AS VARCHAR) AS session_id, '/w/a b+c' AS project, 'mcp_tool' AS kind, 't_' || CAST(k % 3 AS VARCHAR) AS name, 'srv' AS server, sha256(text) AS query, CAST(1704067200 + k AS BIGINT) AS at FROM t")
def trace_copilot(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    own = A.table(spark, d, "conversations").withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    part = F.struct(F.lit("toolInvocationSerialized").alias("kind"), F.concat(F.lit("mcp_srv_t_"), (F.col("k") % 3).cast("string")).alias("toolId"))
    asked = F.struct(F.struct(F.coalesce("text", F.lit("")).alias("text")).alias("message"), (F.lit(1704067200000) + F.col("k") * 1000).alias("timestamp"), F.array(part).alias("response"))
    files = own.groupBy("conv_id").agg(F.collect_list(asked).alias("requests"))
    text = F.to_json(F.struct(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("sessionId"), "requests"))
    paths = files.select(F.concat(F.lit("/ws"), F.col("conv_id").cast("string"), F.lit("/chatSessions/x.json")).alias("path"), text.alias("text"))
    places = files.select(F.concat(F.lit("/ws"), F.col("conv_id").cast("string"), F.lit("/workspace.json")).alias("path"), F.lit('{"folder": "file:///w/a%20b+c"}').alias("text"))
    return _told(traces.copilot(paths, places)).drop("source_line")


@query("SELECT CAST(user_id % 4 AS VARCHAR) AS harness, count(*) FILTER (event_id % 7 = 0 AND event_id % 3 > 0) AS n FROM events GROUP BY 1")
def trace_unrecognised(spark: SparkSession, d: str) -> DataFrame:
    e = A.table(spark, d, "events")
    return traces.unrecognised(e.select((F.col("user_id") % 4).cast("string").alias("harness"), (F.col("event_id") % 3).alias("size"), F.when(F.col("event_id") % 7 == 0, 0).otherwise(1).alias("recognized")))


@query("SELECT CAST(event_id AS VARCHAR) AS path FROM events WHERE event_id % 2 = 0 OR event_id % 5 = 0")
def trace_stale(spark: SparkSession, d: str) -> DataFrame:
    """Files whose extract is of another adapter, or of another size."""
    files = A.table(spark, d, "events").select(F.col("event_id").cast("string").alias("path"), F.col("ts").cast("string").alias("mtime"), F.col("user_id").alias("size"))
    k = F.col("path").cast("bigint")
    cache = files.select("path", "mtime", F.when(k % 5 == 0, -1).otherwise(F.col("size")).alias("size"), F.when(k % 2 == 0, 1).otherwise(2).alias("adapter_version"))
    return traces.stale(files, cache, 2).select("path")


# ---- archives, lockfiles, trees ----

@query("SELECT source || '.tgz' AS archive, 'd' || CAST(doc_id % 5 AS VARCHAR) || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, sha256(coalesce(text, '')) AS hash FROM documents WHERE source IN (SELECT source FROM documents GROUP BY 1 HAVING count(*) <= 200 AND sum(octet_length(encode(coalesce(text, '')))) <= 20971520)")
def archives_expanded(spark: SparkSession, d: str) -> DataFrame:
    """All documents packed by source and read back; an archive beyond the limits gives no files."""

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf.path, "content": [archives.pack({f["path"]: (f["text"] or "").encode() for f in files}) for files in pdf.files]})

    docs = A.table(spark, d, "documents")
    name = F.concat(F.lit("d"), (F.col("doc_id") % 5).cast("string"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    small = docs.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("size"))
    # of what is beyond the limits only a marker is packed, which is beyond them too: a path that leaves the archive
    files = F.when((F.col("n") <= archives.MOST_FILES) & (F.col("size") <= archives.MOST_BYTES), F.struct(name.alias("path"), "text")).otherwise(F.struct(F.lit("../x").alias("path"), F.lit("").alias("text")))
    grouped = docs.join(small, "source").groupBy(F.concat("source", F.lit(".tgz")).alias("path")).agg(F.collect_set(files).alias("files"))
    tars = grouped.mapInPandas(packed, "path string, content binary")
    return archives.expand(tars).where("error is null").select("archive", "path", F.sha2("content", 256).alias("hash"))


@query("SELECT 'k' || CAST(s_suppkey AS VARCHAR) AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'o/r' END AS source, CASE s_suppkey % 5 WHEN 0 THEN 'aa' WHEN 1 THEN 'bb' WHEN 2 THEN 'cc' WHEN 3 THEN 'dd' END AS expected, CASE WHEN s_suppkey % 3 = 0 THEN 'skills/x' END AS folder FROM supplier")
def lock_entries(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    entry = F.to_json(F.struct(
        F.when(k % 2 == 0, "o/r").alias("source"), F.when(k % 5 == 0, "sha256:aa").alias("computedHash"), F.when(k % 5 == 1, "sha256-bb").alias("hash"), F.when(k % 5 == 2, "cc").alias("integrity"),
        F.when(k % 5 == 3, "dd").alias("sha256"), F.when(k % 3 == 0, "skills/x/SKILL.md").alias("skillPath"),
    ))
    text = F.concat(F.when(k % 2 == 0, '{"skills": ').otherwise(""), F.lit('{"k'), k.cast("string"), F.lit('": '), entry, F.lit(', "odd": 5}'), F.when(k % 2 == 0, "}").otherwise(""))
    return configs.lockfile(A.table(spark, d, "supplier").select(text.alias("text")))


@query("SELECT source AS id, sha256(string_agg('d' || CAST(doc_id % 3 AS VARCHAR) || '/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || coalesce(text, ''), '' ORDER BY doc_id % 3, doc_id)) AS tree_hash FROM documents GROUP BY 1")
def tree_hashes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    docs = A.table(spark, d, "documents").select(F.col("source").alias("id"), F.concat(F.lit("d"), (k % 3).cast("string"), F.lit("/"), F.lpad(k.cast("string"), 9, "0")).alias("relpath"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    left_out = A.table(spark, d, "documents").select(F.col("source").alias("id"), F.concat(F.lit("node_modules/"), k.cast("string")).alias("relpath"), F.lit(b"no").alias("content"))
    return X.tree_hash(docs.unionByName(left_out))


# ---- names, paths, schemas ----

PLACES = "p AS (SELECT page_id, 'n' || CAST(page_id % 7 AS VARCHAR) AS name, CASE page_id % 4 WHEN 0 THEN '/work/p/s/' WHEN 1 THEN '/home/u/s/' WHEN 2 THEN '/work/pother/' ELSE '/opt/' END || CAST(page_id AS VARCHAR) AS path FROM pages), q AS (SELECT *, CASE page_id % 4 WHEN 0 THEN './' || substr(path, 9) WHEN 1 THEN '~/' || substr(path, 9) ELSE path END AS portable FROM p)"


@query("WITH " + PLACES + " SELECT page_id, portable, sha256(name || chr(10) || portable) AS key, replace(path, '/', '-') AS folder, path LIKE '/%' AS machine_local FROM q")
def place_keys(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    top = F.when(k % 4 == 0, "/work/p/s/").when(k % 4 == 1, "/home/u/s/").when(k % 4 == 2, "/work/pother/").otherwise("/opt/")
    own = A.table(spark, d, "pages").select("page_id", F.concat(F.lit("n"), (k % 7).cast("string")).alias("name"), F.concat(top, k.cast("string")).alias("path"))
    portable = X.portable_path("path", "/work/p", "/home/u/")
    return own.select("page_id", portable.alias("portable"), X.baseline_key(F.col("name"), portable).alias("key"), X.folder_name("path").alias("folder"), X.machine_local(F.col("path")).alias("machine_local"))


@query("""WITH c AS (SELECT c_custkey AS k FROM customer) SELECT k, CASE k % 6 WHEN 0 THEN 'o/r' || CAST(k AS VARCHAR) WHEN 1 THEN 'o/r' || CAST(k AS VARCHAR) WHEN 2 THEN 'o/r' WHEN 3 THEN NULL WHEN 4 THEN 'o.x/r_1' ELSE NULL END AS repository,
CASE k % 6 WHEN 0 THEN 'https-github.com-o-r' || CAST(k AS VARCHAR) || '.git' WHEN 1 THEN 'github-o-r' || CAST(k AS VARCHAR) WHEN 2 THEN 'o-r-sub-dir' WHEN 3 THEN 'just-words' WHEN 4 THEN 'o.x-r_1-v2' ELSE 'skill' END AS selector FROM c""")
def names_parsed(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_custkey").cast("string")
    text = F.when(k % 6 == 0, F.concat(F.lit("https://github.com/o/r"), n, F.lit(".git"))).when(k % 6 == 1, F.concat(F.lit(" github:o/r"), n)).when(k % 6 == 2, "o/r/sub/dir").when(k % 6 == 3, "Just  Words").when(k % 6 == 4, "o.x/r_1@v2").otherwise("__--")
    return A.table(spark, d, "customer").select(k.alias("k"), X.repository(text).alias("repository"), X.selector_name(text).alias("selector"))


@query("WITH d AS (SELECT doc_id, coalesce(source, '') AS s FROM documents) SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN s || chr(92) || 'u200b' || chr(92) || 'u0007.' WHEN 1 THEN s || chr(92) || 'u202e' || chr(92) || 'u2028' || chr(9) || 'é' ELSE s END AS shown FROM d")
def printable_texts(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("doc_id"), F.coalesce("source", F.lit(""))
    text = F.when(k % 3 == 0, F.concat(s, F.lit("​\u0007."))).when(k % 3 == 1, F.concat(s, F.lit("‮ \té"))).otherwise(s)
    return A.table(spark, d, "documents").select("doc_id", X.printable(text).alias("shown"))


SCHEMA = "WITH " + A.TOOLS


@query(SCHEMA + """ SELECT config_hash, tool, 'a|inner ' || tool || '|b|' || description || '|' || tool AS words,
  '{"a":[2,{"p":"é","q":1}],"tool":"' || tool || '"}' AS canonical FROM tools""")
def schema_words(spark: SparkSession, d: str) -> DataFrame:
    t = A.tools(spark, d)
    q = lambda c: F.to_json(F.struct(F.col(c).alias("v")))
    text = F.concat(F.lit('{"title": "'), "tool", F.lit('", "properties": {"b": {"enum": ["no"], "default": {"title": "no"}, "z": ['), F.regexp_replace(F.regexp_replace(q("description"), r'^\{"v":', '{"description":'), r"$", ""), F.lit(']}, "a": {"items": {"description": "inner '), "tool", F.lit('"}}}}'))
    odd = F.concat(F.lit('{"tool": "'), "tool", F.lit('", "runtime_hash": "x", "a": [2, {"q": 1, "p": "\\u00e9"}]}'))
    return t.select("config_hash", "tool", F.array_join(X.schema_strings(text), "|").alias("words"), X.canonical_json(odd).alias("canonical"))


@query("WITH " + A.SERVERS + " SELECT name, command AS value FROM servers WHERE command LIKE '/%'")
def portability_notes(spark: SparkSession, d: str) -> DataFrame:
    return X.portability_notes(A.servers(spark, d))


@query("SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN 'metadata is not an object' WHEN 1 THEN 'unknown transport' WHEN 2 THEN 'command is not a string' WHEN 3 THEN 'args is not a list of strings' WHEN 4 THEN 'http entry has no url' END AS problem FROM part")
def metadata_problems(spark: SparkSession, d: str) -> DataFrame:
    texts = ["[1]", '{"transport": "smoke"}', '{"transport": "stdio", "command": 5}', '{"transport": "stdio", "command": "x", "args": ["a", 1]}', '{"transport": "http"}', '{"transport": "stdio", "command": "x", "args": ["a"], "env_names": []}']
    pick = F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return A.table(spark, d, "part").select(F.col("p_partkey").alias("k"), X.metadata_problem(pick).alias("problem"))


@query("WITH " + A.CONTRIBUTORS + ", m AS (SELECT name, id, seq % 5 AS mtime FROM contributors), w AS (SELECT *, min(mtime) OVER (PARTITION BY name) AS lo, max(mtime) OVER (PARTITION BY name) AS hi, row_number() OVER (PARTITION BY name ORDER BY mtime DESC, id) AS k FROM m) SELECT name, id, CASE WHEN lo = hi THEN 'copy' WHEN k = 1 THEN 'newest' ELSE 'older' END AS label FROM w")
def age_labels(spark: SparkSession, d: str) -> DataFrame:
    return X.age_labels(A.contributors(spark, d).select("name", "id", (F.col("seq") % 5).alias("mtime")))


# ---- findings by reference ----

FOUND = "WITH " + A.CONTRIBUTORS + ", f AS (SELECT id, name, scope, sha256(id) AS hex, CASE seq % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' ELSE 'note' END AS severity FROM contributors)"


def _found(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("seq") % 3
    return A.contributors(spark, d).select(F.lit("c").alias("check_id"), F.when(k == 0, "error").when(k == 1, "warning").otherwise("note").alias("severity"), F.array("id").alias("contributors"), F.array("name").alias("contributor_names"), T.sha(F.col("id")).alias("fingerprint"), "id")


@query(FOUND + " SELECT id, severity FROM f WHERE severity <> 'note'")
def findings_blocking(spark: SparkSession, d: str) -> DataFrame:
    return FN.blocking(_found(spark, d)).select("id", "severity")


@query(FOUND + ", r AS (SELECT DISTINCT substr(hex, 1, 4) AS ref FROM f UNION SELECT DISTINCT substr(hex, 1, 7) FROM f UNION SELECT 'zz' UNION SELECT 'ffff' || 'ffffffff') SELECT ref, any_value('sha256:' || hex) AS fingerprint FROM r JOIN f ON starts_with(hex, ref) WHERE length(ref) >= 4 GROUP BY 1 HAVING count(*) = 1")
def findings_by_ref(spark: SparkSession, d: str) -> DataFrame:
    found = _found(spark, d)
    hexes = found.select(F.split_part("fingerprint", F.lit(":"), F.lit(2)).alias("h"))
    refs = hexes.select(F.substring("h", 1, 4).alias("ref")).unionByName(hexes.select(F.substring("h", 1, 7).alias("ref"))).unionByName(A.values(spark, [("zz",), ("ffffffffffff",)], "ref string")).distinct()
    return FN.resolve_refs(found, refs)


@query(FOUND + " SELECT 'sha256:' || hex AS fingerprint, scope FROM f")
def findings_scope(spark: SparkSession, d: str) -> DataFrame:
    return FN.ack_scope(_found(spark, d), A.contributors(spark, d))


@query(FOUND + " SELECT 'sha256:' || hex AS fingerprint, CASE WHEN id < '000000500' THEN '2024-01-02' ELSE '2024-05-05' END AS first_seen FROM f")
def findings_seen(spark: SparkSession, d: str) -> DataFrame:
    found = _found(spark, d)
    seen = found.where("id < '000000500'").select("fingerprint", F.lit("2024-01-02").alias("first_seen")).unionByName(A.values(spark, [("sha256:gone", "2023-01-01")], "fingerprint string, first_seen string"))
    return FN.mark_seen(found, seen, "2024-05-05")


@query(FOUND + ", g AS (SELECT name, count(*) AS n, min('sha256:' || hex) AS fp FROM f GROUP BY 1) SELECT name, fp AS fingerprint FROM g")
def findings_targets(spark: SparkSession, d: str) -> DataFrame:
    """Each name asked for as such: the finding of exactly that name, of several the least."""
    found = _found(spark, d)
    wanted = found.select("check_id", F.col("contributor_names").alias("names")).distinct()
    return FN.match_targets(found, wanted).select(F.col("names")[0].alias("name"), "fingerprint")


@query("WITH " + A.CONTRIBUTORS + """, c AS (SELECT name, list(id ORDER BY id) AS ids, count(*) AS n FROM contributors GROUP BY 1 HAVING count(*) BETWEEN 2 AND 40), m AS (SELECT name AS fp, unnest(ids) AS id FROM c),
p AS (SELECT a.fp, a.id AS a, b.id AS b FROM m a JOIN m b ON a.fp = b.fp AND a.id < b.id), j AS (SELECT fp, bool_and(length(fp) % 2 = 0 OR a < '000000100') AS alike FROM p GROUP BY 1), h AS (SELECT DISTINCT fp FROM m WHERE substr(id, 9, 1) = '7' AND fp LIKE '%1%')
SELECT c.name AS fingerprint, CASE WHEN j.alike AND h.fp IS NULL THEN 'note' ELSE 'warning' END AS severity, CAST(n * (n - 1) / 2 AS BIGINT) AS pairs FROM c JOIN j ON j.fp = c.name LEFT JOIN h ON h.fp = c.name""")
def verdicts_applied(spark: SparkSession, d: str) -> DataFrame:
    own = A.contributors(spark, d).groupBy("name").agg(F.array_sort(F.collect_list("id")).alias("ids")).where("size(ids) between 2 and 40")
    found = own.select(F.lit("description-overlap").alias("check_id"), F.lit("warning").alias("severity"), F.col("name").alias("fingerprint"), F.col("ids").alias("contributor_names"))
    pairs = D.flagged_pairs(found)
    said = pairs.where("length(fingerprint) % 2 = 0 or a < '000000100'").select("a", "b", F.lit("distinct").alias("verdict"))
    injected = pairs.select("fingerprint", F.explode(F.array("a", "b")).alias("name")).where("substring(name, 9, 1) = '7' and fingerprint like '%1%'")
    counts = pairs.groupBy("fingerprint").agg(F.count("*").alias("pairs"))
    return D.apply_verdicts(found, pairs, said, injected).join(counts, "fingerprint").select("fingerprint", "severity", "pairs")


@query("SELECT CASE WHEN quality = 1 THEN 'distinct' ELSE 'collision' END AS verdict, 'm' || CAST(doc_id % 3 AS VARCHAR) AS model, count(*) AS n, min(CAST(doc_id % 28 AS VARCHAR)) AS first, max(CAST(doc_id % 28 AS VARCHAR)) AS last FROM labels GROUP BY 1, 2")
def verdict_statistics(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    rows = A.table(spark, d, "labels").select(F.when(F.col("quality") == 1, "distinct").otherwise("collision").alias("verdict"), F.concat(F.lit("m"), (k % 3).cast("string")).alias("model"), (k % 28).cast("string").alias("date"))
    return engine.verdict_statistics(rows)


@query("SELECT k, sha256('{\"args\": [\"' || CAST(k AS VARCHAR) || '\", \"' || chr(92) || 'u00e9' || chr(92) || 'n' || chr(92) || 'ud83d' || chr(92) || 'ude00\"], \"command\": null, \"env_names\": [], \"name\": \"n' || chr(92) || chr(92) || chr(92) || '\"' || CAST(k AS VARCHAR) || '\", \"transport\": \"http\", \"url\": \"http://' || chr(92) || 'u00fc.x\"}') AS hash FROM (SELECT p_partkey AS k FROM part)")
def server_hash_ascii(spark: SparkSession, d: str) -> DataFrame:
    """Identities of servers whose entries hold quotes, line breaks and characters beyond ASCII."""
    n = F.col("p_partkey").cast("string")
    none = F.lit(None).cast("string")
    made = V.config_hash(F.concat(F.lit('n\\"'), n), F.lit("http"), none, F.array(n, F.lit("é\n😀")), F.lit("http://ü.x"), F.array().cast("array<string>"))
    return A.table(spark, d, "part").select(F.col("p_partkey").alias("k"), made.alias("hash"))


@query("WITH " + A.MARKED + ", c AS (SELECT harness, name, count(DISTINCT content_hash) AS n FROM marked WHERE shadowed_by IS NULL AND kind = 'skill' GROUP BY 1, 2) SELECT harness, count(*) AS names, CAST(sum(n) AS BIGINT) AS contents FROM c GROUP BY 1")
def effective_names(spark: SparkSession, d: str) -> DataFrame:
    own = R.effective(R.mark_shadows(A.loads(spark, d), A.harnesses(spark))).where("kind = 'skill'")
    return own.groupBy("harness", "name").agg(F.count_distinct("content_hash").alias("n")).groupBy("harness").agg(F.count("*").alias("names"), F.sum("n").alias("contents"))
