"""Where results go: findings as JSON lines, keyed stores rewritten as a whole, append-only records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators.findings import upsert


def write_findings(findings: DataFrame, path: str) -> None:
    """JSON lines with keys in order."""
    findings.select(*sorted(findings.columns)).write.mode("overwrite").json(path)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def merged(store: DataFrame | None, rows: DataFrame, keys: list[str]) -> DataFrame:
    """What a keyed store holds after rows replace its entries; to be written to a fresh place."""
    return rows if store is None else upsert(store, rows, keys)


def manifest_entries(contributors: DataFrame) -> DataFrame:
    """Publishable entries as JSON: selector, entry."""
    entry = F.struct(F.lit("skill").alias("kind"), "selector", "name", F.col("source_kind").alias("source_type"), "content_hash", (F.col("source_kind") == "unmanaged").alias("local_only"))
    return contributors.select("selector", F.to_json(entry).alias("entry"))
