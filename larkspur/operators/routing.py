"""Which skill a query would route to, and whether the choice is contested."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import text as T

from .findings import finding

FLOOR, TOP, UNIGRAM, BIGRAM = 0.1, 5, 0.7, 0.3


def _weights(rows: DataFrame, key: str, text: str, k: int) -> DataFrame:
    tokens = T.content_tokens(text)
    each = rows.select(key, F.explode(tokens if k == 1 else T.grams(tokens, k)).alias("gram")).groupBy(key, "gram").agg(F.count("*").alias("tf"))
    norm = each.groupBy(key).agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm"))
    return each.join(norm, key).select(key, "gram", (F.col("tf") / F.col("norm")).alias("w"))


def scores(queries: DataFrame, targets: DataFrame) -> DataFrame:
    """query_id, id, score of every pair that shares a content token: an equi-join on grams, no cross join."""
    parts = []
    for k, share in ((1, UNIGRAM), (2, BIGRAM)):
        q, t = _weights(queries, "query_id", "query", k), _weights(targets, "id", "routing_text", k).withColumnRenamed("w", "wt")
        parts.append(q.join(t, "gram").groupBy("query_id", "id").agg(F.least(F.sum(F.col("w") * F.col("wt")), F.lit(1.0)).alias("c")).select("query_id", "id", (F.col("c") * share).alias("c")))
    return parts[0].unionByName(parts[1]).groupBy("query_id", "id").agg(F.round(F.sum("c"), 6).alias("score")).where("score > 0")


def rank(queries: DataFrame, effective: DataFrame, contributors: DataFrame, margin: float = 0.1) -> DataFrame:
    """harness, query_id, place, id, name, score, verdict: the five best of each harness; no rows below the floor."""
    targets = contributors.where("kind <> 'command'")
    scored = scores(queries, targets.select("id", "routing_text")).join(effective.select("harness", "id", "name"), "id")
    w = Window.partitionBy("harness", "query_id").orderBy(F.col("score").desc(), "name", "id")
    # first what can be shown or come next to it, so that every task keeps only its own best of each ranking
    best = scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= TOP + 1)
    top = best.withColumn("second", F.lead("score").over(w)).where(F.col("place") <= TOP)
    top = top.withColumn("best", F.first(F.struct("score", "second")).over(w))
    verdict = F.when(F.col("best.score") - F.col("best.second") < margin, "contested").otherwise("routes")
    return top.withColumn("verdict", verdict).where(F.col("best.score") >= FLOOR).select("harness", "query_id", "place", "id", "name", "score", "verdict")


def group_rankings(ranked: DataFrame) -> DataFrame:
    """Harnesses with one and the same ranking of a query share a row."""
    row = F.struct("place", "name", "score")
    each = ranked.groupBy("query_id", "harness", "verdict").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return each.groupBy("query_id", "verdict", F.to_json("rows").alias("ranking")).agg(F.array_sort(F.collect_list("harness")).alias("harnesses"))


def query_routing(queries: DataFrame, ranked: DataFrame, harnesses: DataFrame) -> DataFrame:
    """Findings for queries (query_id, query, expect) that are contested, go elsewhere, or find nothing."""
    first = ranked.where("place = 1").select("harness", "query_id", "name", "verdict", "score")
    every = queries.join(F.broadcast(harnesses.select(F.col("id").alias("harness"))))
    judged = every.join(first, ["harness", "query_id"], "left")
    problem = F.when(F.col("verdict").isNull(), "no match").when(F.col("expect").isNotNull() & (F.col("name") != F.col("expect")), "wrong target").when(F.col("verdict") == "contested", "contested")
    bad = judged.withColumn("problem", problem).where("problem is not null").groupBy("query_id", "query", "problem", F.coalesce("name", F.lit("")).alias("top")).agg(F.array_sort(F.collect_list("harness")).alias("harnesses"))
    return finding(bad, "query-routing", "warning", F.array().cast("array<string>"), F.array_compact(F.array(F.nullif("top", F.lit("")))), F.col("harnesses"), F.col("problem"), F.array(T.sha(F.col("query"))), F.concat_ws("|", "problem", "top"))
