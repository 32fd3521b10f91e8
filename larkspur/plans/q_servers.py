"""Queries over server configurations and tool sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import lexicons as X
from larkspur.operators import resolution as R
from larkspur.operators import servers as S

from . import adapters as A
from .registry import flat, query

W = "WITH " + A.SERVERS
ROW = "SELECT '{}' AS check_id, {} AS severity, source AS contributors, name AS contributor_names, harness AS harnesses, {} AS detail FROM servers WHERE {}"


@query(W + ROW.format("mcp-secret-in-config", "CASE WHEN in_project THEN 'error' ELSE 'warning' END", "array_to_string(suspect_env, ', ')", "len(suspect_env) > 0"))
def check_secret_in_config(spark: SparkSession, d: str) -> DataFrame:
    return flat(S.secret_in_config(A.servers(spark, d)))


@query(W + ROW.format("mcp-unpinned-server", "'warning'", "CASE seq % 3 WHEN 0 THEN 'pkg' ELSE 'tool@latest' END", "command IN ('/opt/bin/npx', 'uvx') AND seq % 3 <> 1"))
def check_unpinned_server(spark: SparkSession, d: str) -> DataFrame:
    return flat(S.unpinned_server(A.servers(spark, d)))


@query(W + ROW.format("mcp-insecure-url", "'warning'", "url", "starts_with(url, 'http://') AND NOT contains(url, 'localhost') AND NOT contains(url, '::1')"))
def check_insecure_url(spark: SparkSession, d: str) -> DataFrame:
    return flat(S.insecure_url(A.servers(spark, d)))


@query(W + ROW.format("mcp-dead-server", "'error'", "command", "transport = 'stdio' AND command NOT IN ('node', '/opt/bin/npx')"))
def check_dead_server(spark: SparkSession, d: str) -> DataFrame:
    return flat(S.dead_server(A.servers(spark, d), A.values(spark, [("node",), ("/opt/bin/npx",)], "command string")))


@query(W + """SELECT 'mcp-shadowed-server' AS check_id, 'warning' AS severity, arg_min(source, seq) AS contributors, name AS contributor_names, harness AS harnesses, CAST(count(DISTINCT config_hash) AS VARCHAR) AS detail
FROM servers GROUP BY harness, name HAVING count(DISTINCT scope) = 2 AND count(DISTINCT config_hash) > 1""")
def check_shadowed_server(spark: SparkSession, d: str) -> DataFrame:
    return flat(S.shadowed_server(A.servers(spark, d)))


BEST = W + ", " + A.HARNESSES + ", best AS (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY harness, name ORDER BY scope = CASE WHEN search_order = 'global-first' THEN 'user' ELSE 'project' END DESC, seq) AS n FROM servers s LEFT JOIN harnesses h ON h.id = s.harness) WHERE n = 1)"


@query(BEST + "SELECT harness, name, seq, scope FROM best")
def server_winners(spark: SparkSession, d: str) -> DataFrame:
    return R.scope_winner(A.servers(spark, d), A.harnesses(spark)).select("harness", "name", "seq", "scope")


@query(BEST + """SELECT 'mcp-diverged-server' AS check_id, 'warning' AS severity, string_agg(DISTINCT source, ',' ORDER BY source) AS contributors, name AS contributor_names, string_agg(DISTINCT harness, ',' ORDER BY harness) AS harnesses,
  coalesce(nullif(concat_ws(', ', CASE WHEN count(DISTINCT coalesce(command, '')) > 1 THEN 'command' END, CASE WHEN count(DISTINCT args) > 1 THEN 'args' END, CASE WHEN count(DISTINCT coalesce(url, '')) > 1 THEN 'url' END, CASE WHEN count(DISTINCT env_names) > 1 THEN 'env_names' END), ''), 'config') AS detail
FROM best GROUP BY name HAVING count(DISTINCT config_hash) > 1 AND count(DISTINCT harness) > 1""")
def check_diverged_server(spark: SparkSession, d: str) -> DataFrame:
    return flat(S.diverged_server(A.servers(spark, d), A.harnesses(spark)))


@query("WITH " + A.TOOLS + """, l AS (SELECT DISTINCT tool, harness, config_hash FROM tools JOIN servers USING (config_hash)), c AS (SELECT tool, harness FROM l GROUP BY 1, 2 HAVING count(*) > 1)
SELECT 'mcp-tool-collision' AS check_id, 'warning' AS severity, (SELECT string_agg(DISTINCT config_hash || ':' || tool, ',' ORDER BY config_hash || ':' || tool) FROM tools t WHERE t.tool = c.tool) AS contributors, tool AS contributor_names, string_agg(harness, ',' ORDER BY harness) AS harnesses, tool AS detail FROM c GROUP BY tool""")
def check_tool_collision(spark: SparkSession, d: str) -> DataFrame:
    return flat(S.tool_collision(A.tools(spark, d), A.servers(spark, d)))


FAILED = [("a", "en", "timeout"), ("b", "fr", "refused")]


@query("SELECT 'mcp-connect-failed' AS check_id, 'warning' AS severity, 'mcp:' || harness || ':' || name AS contributors, name AS contributor_names, harness AS harnesses, message AS detail FROM " + A.sql_values(FAILED, "name, harness, message"))
def check_connect_failed(spark: SparkSession, d: str) -> DataFrame:
    return flat(S.connect_failed(A.values(spark, FAILED, "name string, harness string, message string")))


CHANGED = """, approved AS (SELECT config_hash, tool, CASE WHEN tool IN ('tool1', 'tool2') THEN 'old text' ELSE description END AS description, CASE WHEN tool = 'tool3' THEN ['other'] ELSE schema_text END AS schema_text FROM tools WHERE tool <> 'tool4'
  UNION ALL SELECT config_hash, 'dropped', 'x', []::VARCHAR[] FROM tools WHERE tool = 'tool5')"""


def _approved(spark: SparkSession, d: str) -> DataFrame:
    t = A.tools(spark, d)
    old = t.where("tool <> 'tool4'").withColumn("description", F.when(F.col("tool").isin("tool1", "tool2"), "old text").otherwise(F.col("description")))
    old = old.withColumn("schema_text", F.when(F.col("tool") == "tool3", F.array(F.lit("other"))).otherwise(F.col("schema_text")))
    return old.unionByName(t.where("tool = 'tool5'").select("config_hash", F.lit("dropped").alias("tool"), F.lit("x").alias("description"), F.array().cast("array<string>").alias("schema_text")))


@query("WITH " + A.TOOLS + CHANGED + """SELECT coalesce(a.config_hash, b.config_hash) AS config_hash, coalesce(a.tool, b.tool) AS tool, CASE WHEN a.tool IS NULL THEN 'added' WHEN b.tool IS NULL THEN 'removed' WHEN a.description <> b.description THEN 'description' ELSE 'schema' END AS change
FROM approved a FULL JOIN tools b ON a.config_hash = b.config_hash AND a.tool = b.tool WHERE a.tool IS NULL OR b.tool IS NULL OR a.description <> b.description OR a.schema_text <> b.schema_text""")
def tool_changes(spark: SparkSession, d: str) -> DataFrame:
    return S.diff_tools(_approved(spark, d), A.tools(spark, d))


@query("WITH " + A.TOOLS + """, s AS (SELECT config_hash, arg_min(name, seq) AS server, min(seq) AS k FROM servers GROUP BY 1)
SELECT server, config_hash, CASE WHEN server IN (SELECT server FROM s WHERE k % 3 = 1) THEN CASE WHEN k % 3 = 1 THEN 'changed' ELSE 'changed' END ELSE 'new' END AS state, (SELECT count(*) FROM tools t WHERE t.config_hash = s.config_hash) AS n FROM s""")
def check_tools_unreviewed(spark: SparkSession, d: str) -> DataFrame:
    s = A.servers(spark, d)
    first = s.groupBy("config_hash").agg(F.min_by("name", "seq").alias("name"), F.min("seq").alias("k"))
    acks = first.where("k % 3 = 1").select(F.lit("mcp-tools-unreviewed").alias("check_id"), "name", F.lit("sha256:old").alias("fingerprint")).distinct()
    found = S.tools_unreviewed(A.tools(spark, d), s, acks)
    parts = F.split("detail", " ")
    keyed = S.tools_unreviewed(A.tools(spark, d), s, acks.where("false")).select("fingerprint", F.col("contributor_names")[0].alias("server"))
    hashes = A.tools(spark, d).select("config_hash").distinct().join(first, "config_hash")
    # the finding's parts hold the configuration; joined back through the set's own fingerprint
    sets = _fingerprints(A.tools(spark, d), hashes)
    return found.join(keyed, "fingerprint").join(sets, "fingerprint").select("server", "config_hash", parts[0].alias("state"), parts[1].cast("bigint").alias("n"))


def _fingerprints(tools: DataFrame, names: DataFrame) -> DataFrame:
    from larkspur.functions import text as T

    full = F.concat_ws("\n", "tool", "description", F.array_join("schema_text", "\n"))
    sets = tools.groupBy("config_hash").agg(F.array_sort(F.collect_list(full)).alias("full")).join(names, "config_hash")
    return sets.select("config_hash", T.fingerprint("mcp-tools-unreviewed", F.concat(F.array("name", "config_hash"), "full")).alias("fingerprint"))


CONFIGS = [
    (1, "en", "user", False, "/a.json", '{"mcpServers": {"one": {"command": "npx", "args": ["-y", "p"], "env": {"API_KEY": "hunter2", "SAFE": "${X}", "B": "ghp_x"}}, "two": {"url": "https://x/y"}, "bad": 5}}'),
    (2, "fr", "project", True, "/b.json", '{"servers": {"three": {"serverUrl": "http://z", "args": []}}}'), (3, "fr", "project", True, "/c.json", "{broken"),
]
DDL = "seq bigint, harness string, scope string, in_project boolean, source string, text string"
PARSED = [("one", "en", "stdio", "npx", "-y,p", None, "API_KEY,B,SAFE", "API_KEY,B"), ("two", "en", "http", None, "", "https://x/y", "", ""), ("three", "fr", "http", None, "", "http://z", "", "")]


@query("SELECT * FROM " + A.sql_values(PARSED, "name, harness, transport, command, args, url, env_names, suspect_env"))
def server_parse(spark: SparkSession, d: str) -> DataFrame:
    s = S.parse_servers(A.values(spark, CONFIGS, DDL))
    return s.select("name", "harness", "transport", "command", F.array_join("args", ",").alias("args"), "url", F.array_join("env_names", ",").alias("env_names"), F.array_join("suspect_env", ",").alias("suspect_env"))


@query("SELECT 'mcp-config-invalid' AS check_id, 'error' AS severity, '/c.json' AS contributors, '' AS contributor_names, 'fr' AS harnesses, 'not JSON' AS detail")
def check_config_invalid(spark: SparkSession, d: str) -> DataFrame:
    return flat(S.config_invalid(S.config_errors(A.values(spark, CONFIGS, DDL))))


@query(W + """SELECT seq, sha256('{"args": [' || array_to_string(list_transform(args, lambda a: '"' || a || '"'), ', ') || '], "command": ' || coalesce('"' || command || '"', 'null') || ', "env_names": [' || array_to_string(list_transform(env_names, lambda a: '"' || a || '"'), ', ') || '], "name": "' || name || '", "transport": "' || transport || '", "url": ' || coalesce('"' || url || '"', 'null') || '}') AS config_hash FROM servers""")
def server_config_hash(spark: SparkSession, d: str) -> DataFrame:
    return A.servers(spark, d).select("seq", S.config_hash(*[F.col(c) for c in ("name", "transport", "command", "args", "url", "env_names")]).alias("config_hash"))


@query(r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z_]+ ?= ?"[^"]*"')) AS p FROM documents), v AS (SELECT doc_id, regexp_extract(p, '^([A-Za-z_]+)', 1) AS n, regexp_extract(p, '"([^"]*)"$', 1) AS v FROM w)
SELECT doc_id, count(*) AS secrets FROM v WHERE v <> '' AND NOT (starts_with(v, '${') AND ends_with(v, '}')) AND (regexp_matches(v, '^(sk-|sk_live_|pk_live_|ghp_|github_pat_|gho_|xoxb-|xoxp-|xapp-|AKIA|ASIA|glpat-|AIza|ntn_)') OR (NOT regexp_matches(n, '(SHA\d*|HASH|FINGERPRINT|PUBLIC|PUBKEY)', 'i')
  AND NOT regexp_matches(v, '^[a-zA-Z][a-zA-Z0-9+.-]*://') AND NOT regexp_matches(v, '^(/|~|\./)') AND (regexp_matches(n, '(KEY|TOKEN|SECRET|PASSWORD|CREDENTIALS?)$', 'i') OR (length(v) >= 32 AND NOT contains(v, ' ') AND regexp_matches(v, '[A-Za-z]') AND regexp_matches(v, '[0-9]'))))) GROUP BY 1""")
def secrets_in_text(spark: SparkSession, d: str) -> DataFrame:
    """Assignments in the documents whose name and value read as a secret."""
    pairs = F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit('[A-Za-z_]+ ?= ?"[^"]*"'), F.lit(0)))
    v = A.table(spark, d, "documents").select("doc_id", pairs.alias("p")).select("doc_id", F.regexp_extract("p", "^([A-Za-z_]+)", 1).alias("n"), F.regexp_extract("p", '"([^"]*)"$', 1).alias("v"))
    return v.where(X.looks_secret(F.col("n"), F.col("v"))).groupBy("doc_id").agg(F.count("*").alias("secrets"))
