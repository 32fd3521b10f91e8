"""The named queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        key = name or fn.__name__
        QUERIES[key] = fn
        if oracle:
            ORACLES[key] = oracle
        return fn

    return register


def flat(findings: DataFrame) -> DataFrame:
    """Findings with their lists as text, without the fingerprint."""
    return findings.select("check_id", "severity", *[F.array_join(c, ",").alias(c) for c in ("contributors", "contributor_names", "harnesses")], "detail")


# each module registers its queries when imported
from . import q_lines, q_loadouts, q_manifests, q_servers, q_skills, q_sources, q_usage  # noqa: E402, F401
