"""Connected components by alternating star contractions; edges never leave the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import stored


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _contract(edges: DataFrame, smaller_only: bool) -> DataFrame:
    """Each node's neighbours (all, or the smaller ones and itself) are tied to the smallest of them."""
    both = edges if smaller_only else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    tied = both.join(least, "u")
    if smaller_only:
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        out = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = out.where("u <> v")
    return out.distinct() if smaller_only else out


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v), any order, no nulls. Returns (u, v): each node that is not the least of its component, and the least."""
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(now)
    while True:
        now = stored(_contract(_contract(now, False), True))
        fresh = _mark(now)
        if fresh == mark:
            return now
        mark = fresh
