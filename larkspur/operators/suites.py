"""Which plugin, lockfile or server a skill or tool came from."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.sources import trees


def plugin_registry(spark: SparkSession, home: str) -> DataFrame:
    """content_hash, plugin of every cached plugin skill; the first plugin in order of path owns a shared hash."""
    cache = Path(home) / ".claude/plugins/cache"
    rows = [(str(f), s.parent.parent.name, k) for k, s in enumerate(sorted(cache.glob("*/*/*/skills"))) if s.is_dir() for f in sorted(s.rglob("SKILL.md"))]
    cached = spark.createDataFrame(rows, "id string, plugin string, k int")
    return first_plugin(cached.join(trees.read_skills(cached).select("id", "content_hash"), "id").where("content_hash is not null"))


def first_plugin(cached: DataFrame) -> DataFrame:
    """cached: content_hash, plugin, k (order)."""
    return cached.groupBy("content_hash").agg(F.min_by("plugin", F.struct("k", "id")).alias("plugin"))


def lock_provenance(skills: DataFrame, lock: DataFrame) -> DataFrame:
    """Unmanaged and linked skills that a lockfile names (name, source, folder) are the lockfile's."""
    entry = lock.groupBy("name").agg(F.first("source").alias("lock_source"), F.first("folder").alias("lock_folder"), F.lit(True).alias("locked"))
    joined = skills.join(entry, "name", "left")
    takes = (F.col("kind") == "skill") & F.col("provenance").isin("unmanaged", "linked") & F.coalesce("locked", F.lit(False))
    return joined.select(
        *[c for c in skills.columns if c not in ("provenance", "source")], F.when(takes, "skills-lock").otherwise(F.col("provenance")).alias("provenance"),
        F.when(takes, F.col("lock_source")).otherwise(F.col("source")).alias("source"), F.when(takes, F.col("lock_folder")).alias("lock_folder"),
    )


def assign(skills: DataFrame, registry: DataFrame, servers: DataFrame | None = None) -> DataFrame:
    """skills with suite: a tool's server, a skill's plugin by content, else its lockfile's source. What a store scan
    has told already stays; all others are cleared."""
    joined = skills.join(registry, "content_hash", "left")
    own = F.when((F.col("provenance") == "plugin") & (F.coalesce("suite", F.lit("")) != ""), F.col("suite"))
    locked = F.when((F.col("provenance") == "skills-lock") & (F.col("source") != ""), F.col("source"))
    suite = F.when(F.col("kind") == "skill", F.coalesce(own, "plugin", locked)).when(F.col("kind") == "command", F.col("suite"))
    if servers is not None:
        named = servers.groupBy("config_hash").agg(F.max_by("name", "seq").alias("server"))
        joined = joined.withColumn("config_hash", F.split_part("id", F.lit(":"), F.lit(1))).join(named, "config_hash", "left").drop("config_hash")
        suite = F.when(F.col("kind") == "mcp_tool", F.col("server")).otherwise(suite)
    return joined.withColumn("suite", suite).select(*skills.columns)
