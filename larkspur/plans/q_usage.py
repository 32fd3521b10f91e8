"""Queries over invocations, turns and acknowledgement events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.operators import findings as FN
from larkspur.operators import usage as U

from . import adapters as A
from .registry import query

TODAY = "2024-12-31"
W = "WITH " + A.INVOCATIONS
BY_NAME = W + """, u AS (
  SELECT harness, kind, name, server, count(*) FILTER (NOT sidechain) AS uses, count(*) FILTER (sidechain) AS sidechain_uses, count(DISTINCT session_id) AS sessions, max(ts) AS last_used, bool_or(detection <> 'explicit') AS heuristic
  FROM invocations GROUP BY ALL), c AS (
  SELECT harness, min(ts) AS first, max(ts) AS last, count(DISTINCT session_id) AS sessions, count(*) AS invocations, greatest((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400e6, 7.0) AS span_days FROM invocations GROUP BY 1)
"""


@query(BY_NAME + "SELECT * FROM u")
def usage_by_name(spark: SparkSession, d: str) -> DataFrame:
    return U.usage_by_name(A.invocations(spark, d))


@query(BY_NAME + "SELECT harness, first, last, sessions, invocations, round(span_days, 6) AS span_days FROM c")
def usage_coverage(spark: SparkSession, d: str) -> DataFrame:
    return U.coverage(A.invocations(spark, d)).withColumn("span_days", F.round("span_days", 6))


@query(BY_NAME + """SELECT kind, name, server, CAST(sum(uses) AS BIGINT) AS uses, CAST(sum(sidechain_uses) AS BIGINT) AS sidechain_uses, CAST(sum(u.sessions) AS BIGINT) AS sessions, max(last_used) AS last_used, bool_or(heuristic) AS heuristic,
  round(sum(uses / (span_days / 7.0)), 6) AS per_week FROM u JOIN c USING (harness) GROUP BY ALL""")
def usage_rollup(spark: SparkSession, d: str) -> DataFrame:
    return U.rollup(A.invocations(spark, d)).withColumn("per_week", F.round("per_week", 6))


@query(BY_NAME + "SELECT harness, kind, name, server, uses, round(uses * 100.0 / greatest(sum(uses) OVER (PARTITION BY harness), 1), 6) AS percent FROM u")
def usage_shares(spark: SparkSession, d: str) -> DataFrame:
    return U.shares(A.invocations(spark, d)).select("harness", *U.KEY, "uses", F.round("percent", 6).alias("percent"))


@query(W + "SELECT kind, name, server, harness, count(*) AS n, max(ts) AS last_used FROM invocations WHERE name = 'signup' OR server || ':' || name = 'signup' GROUP BY ALL")
def usage_drilldown(spark: SparkSession, d: str) -> DataFrame:
    return U.drilldown(A.invocations(spark, d), "signup")


@query(W + "SELECT seq, source_file, ts FROM invocations WHERE source_file = (SELECT source_file FROM invocations ORDER BY ts DESC, seq DESC LIMIT 1)")
def usage_last_session(spark: SparkSession, d: str) -> DataFrame:
    return U.last_session(A.invocations(spark, d)).select("seq", "source_file", "ts")


@query(W + "SELECT seq, harness, project FROM invocations WHERE ts >= TIMESTAMP '2024-01-10' AND project = 'p1'")
def usage_in_scope(spark: SparkSession, d: str) -> DataFrame:
    return U.in_scope(A.invocations(spark, d), "2024-01-10", "p1", "-x").select("seq", "harness", "project")


@query(W + f"SELECT harness FROM invocations GROUP BY 1 HAVING DATE '{TODAY}' - CAST(min(ts) AS DATE) >= 90")
def usage_covered_harnesses(spark: SparkSession, d: str) -> DataFrame:
    return U.covered_harnesses(A.invocations(spark, d), TODAY, 90)


def _installed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    inv = A.invocations(spark, d).withColumn("name", F.concat("name", F.lit("-"), (F.col("seq") % 7).cast("string")))
    own = A.contributors(spark, d).select("id", "kind", F.concat(F.element_at(F.array(*[F.lit(x) for x in ("signup", "error", "purchase", "idle")]), (F.col("seq") % 4 + 1).cast("int")), F.lit("-"), (F.col("seq") % 9).cast("string")).alias("name"), "suite", "system", "seq")
    load = own.select("id", (F.col("seq") % 5).cast("string").alias("harness"))
    pins = own.where("seq % 10 = 0").select(F.col("id").alias("path"), F.when(F.col("seq") % 20 == 0, "2024-12-01").when(F.col("seq") % 30 == 0, "bad").otherwise("2020-01-01").alias("installed_at"))
    return own, load, inv, pins


@query("WITH " + A.CONTRIBUTORS + ", " + A.INVOCATIONS + f""", own AS (SELECT id, kind, [ 'signup', 'error', 'purchase', 'idle'][seq % 4 + 1] || '-' || CAST(seq % 9 AS VARCHAR) AS name, system, seq FROM contributors),
cov AS (SELECT harness FROM invocations GROUP BY 1 HAVING DATE '{TODAY}' - CAST(min(ts) AS DATE) >= 90), used AS (SELECT DISTINCT name || '-' || CAST(seq % 7 AS VARCHAR) AS name FROM invocations WHERE kind <> 'mcp_tool')
SELECT kind, id, name, CAST(NULL AS VARCHAR) AS server FROM own WHERE NOT system AND CAST(seq % 5 AS VARCHAR) IN (SELECT harness FROM cov) AND NOT (seq % 20 = 0) AND name NOT IN (SELECT name FROM used)""")
def usage_unused(spark: SparkSession, d: str) -> DataFrame:
    own, load, inv, pins = _installed(spark, d)
    return U.unused(own.withColumn("suite", F.lit(None).cast("string")), load, inv, A.servers(spark, d), pins, TODAY)


TURNS = """WITH t AS (SELECT conv_id, turn, role, text FROM conversations)
SELECT conv_id, turn, role, (SELECT sha256(coalesce(b.text, '')) FROM t b WHERE b.conv_id = a.conv_id AND b.role = 'user' AND b.turn <= a.turn ORDER BY b.turn DESC LIMIT 1) AS asked FROM t a"""


@query(TURNS)
def trace_carried_query(spark: SparkSession, d: str) -> DataFrame:
    """The user's last words at each turn."""
    t = A.table(spark, d, "conversations")
    asked = F.when(F.col("role") == "user", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    return U.carry_forward(t, asked, "asked", ("conv_id",), ("turn",)).select("conv_id", "turn", "role", "asked")


@query("WITH " + A.ACK_EVENTS + " SELECT fingerprint, arg_max(action, server_sequence) AS action, max(server_sequence) AS server_sequence FROM ack_events GROUP BY 1")
def ack_fold(spark: SparkSession, d: str) -> DataFrame:
    return FN.fold_ack_events(A.ack_events(spark, d))


RENAMED = "CASE WHEN CAST(fingerprint AS BIGINT) % 4 = 0 THEN 'new-' ELSE '' END || fingerprint"


def _renamed(e: DataFrame) -> DataFrame:
    return e.withColumn("fingerprint", F.concat(F.when(F.col("fingerprint").cast("bigint") % 4 == 0, "new-").otherwise(""), "fingerprint"))


@query("WITH " + A.ACK_EVENTS + f""", base AS (SELECT DISTINCT fingerprint FROM ack_events), cur AS (SELECT DISTINCT {RENAMED} AS fingerprint FROM ack_events)
SELECT fingerprint, 'acknowledged' AS action FROM cur WHERE fingerprint NOT IN (SELECT fingerprint FROM base) UNION ALL SELECT fingerprint, 'reopened' FROM base WHERE fingerprint NOT IN (SELECT fingerprint FROM cur)""")
def ack_mint(spark: SparkSession, d: str) -> DataFrame:
    e = A.ack_events(spark, d)
    return FN.mint_events(e, _renamed(e))


@query("WITH " + A.ACK_EVENTS + " SELECT action, count(*) AS n FROM ack_events GROUP BY 1")
def ack_summary(spark: SparkSession, d: str) -> DataFrame:
    return A.ack_events(spark, d).groupBy("action").agg(F.count("*").alias("n"))


@query("WITH " + A.ACK_EVENTS + f""", old AS (SELECT fingerprint, min(server_sequence) AS server_sequence FROM ack_events GROUP BY 1), new AS (SELECT {RENAMED} AS fingerprint, max(server_sequence) AS server_sequence FROM ack_events GROUP BY 1)
SELECT * FROM old WHERE fingerprint NOT IN (SELECT fingerprint FROM new) UNION ALL SELECT * FROM new""")
def store_upsert(spark: SparkSession, d: str) -> DataFrame:
    e = A.ack_events(spark, d)
    old = e.groupBy("fingerprint").agg(F.min("server_sequence").alias("server_sequence"))
    return FN.upsert(old, _renamed(e).groupBy("fingerprint").agg(F.max("server_sequence").alias("server_sequence")), ["fingerprint"])


@query("WITH " + A.ACK_EVENTS + " SELECT fingerprint, count(*) AS n FROM ack_events WHERE fingerprint IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer) GROUP BY 1")
def store_prune(spark: SparkSession, d: str) -> DataFrame:
    live = A.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("fingerprint"))
    return FN.prune(A.ack_events(spark, d), live, ["fingerprint"]).groupBy("fingerprint").agg(F.count("*").alias("n"))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events) WHERE n <= 3")
def evidence_top3(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), "event_id")
    return A.table(spark, d, "events").withColumn("n", F.row_number().over(w)).where("n <= 3").select("user_id", "event_id")
