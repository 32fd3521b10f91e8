"""What reports show, as tables: rows of each harness, marks of what is not verified, counts, what was not scanned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions import text as T

from .findings import severity_rank

#: Checks that depend on which of two copies wins.
PRECEDENCE_CHECKS = ["name-shadow", "double-load"]
#: Notes that approve something, and so can be acknowledged.
APPROVALS = ["injection-shell-unreviewed", "mcp-tools-unreviewed"]


def unverified(findings: DataFrame, harnesses: DataFrame) -> DataFrame:
    """fingerprint, harness, marked: whether the facet that a finding rests on is not documented for the harness.

    harnesses: id, paths_verified, precedence_verified, servers_verified; an unknown harness has no mark."""
    facet = F.when(F.col("check_id").startswith("mcp-"), F.col("servers_verified")).when(F.col("check_id").isin(PRECEDENCE_CHECKS), F.col("precedence_verified")).otherwise(F.col("paths_verified"))
    each = findings.select("fingerprint", "check_id", F.explode("harnesses").alias("harness"))
    return each.join(F.broadcast(harnesses.withColumnRenamed("id", "harness")), "harness", "left").select("fingerprint", "harness", F.coalesce(~facet, F.lit(False)).alias("marked"))


def ackable(findings: DataFrame) -> DataFrame:
    """Findings that an acknowledgement makes sense for: all but notes, and the notes that approve something."""
    return findings.where((F.col("severity") != "note") | F.col("check_id").isin(APPROVALS))


def without_harnesses(findings: DataFrame) -> DataFrame:
    """A linted folder has no harness."""
    return findings.withColumn("harnesses", F.array().cast("array<string>"))


def not_scanned(bundled: DataFrame) -> DataFrame:
    """binary, oversize, skills: bundled files whose content is not scanned, and how many skills have some."""
    left = bundled.where("not is_text or oversize")
    return left.agg(F.count_if(~F.col("is_text")).alias("binary"), F.count_if(F.col("is_text") & F.col("oversize")).alias("oversize"), F.count_distinct("id").alias("skills"))


def harness_rows(loads: DataFrame, servers: DataFrame) -> DataFrame:
    """harness, kind, name, scope, suite, notes, catalog_tokens, body_tokens: what each harness loads, in order.

    loads: harness, id, path, kind, name, scope, suite, via_symlink, shadowed_by, tokens. A file reached by several
    unshadowed paths of one scope is one row that says so. Servers without tools here have a row of their own."""
    per = loads.groupBy("harness", "id").agg(F.count("*").alias("paths"), F.count_if("via_symlink").alias("links"), F.max(F.col("shadowed_by").isNotNull()).alias("lost"), F.count_distinct("scope").alias("scopes"), F.min("path").alias("first"))
    one = (F.col("kind") != "mcp_tool") & (F.col("paths") > 1) & ~F.col("lost") & (F.col("scopes") == 1)
    joined = loads.join(per, ["harness", "id"]).withColumn("one", one).where("not one or path = first")
    collapsed = F.concat(F.concat(F.col("paths"), F.lit(" paths")), F.when(F.col("links") > 0, F.concat(F.lit(", "), F.col("links"), F.lit(" symlink"), F.when(F.col("links") > 1, "s").otherwise(""))).otherwise(""))
    plain = F.array_join(F.array_compact(F.array(F.when(F.col("shadowed_by").isNotNull(), "shadowed"), F.when(F.col("via_symlink"), "symlink"))), ", ")
    own = joined.select("harness", "kind", "name", "scope", "suite", F.when(F.col("one"), collapsed).otherwise(plain).alias("notes"), "catalog_tokens", "body_tokens")
    met = loads.where("kind = 'mcp_tool'").select("harness", F.split_part("id", F.lit(":"), F.lit(1)).alias("config_hash")).distinct()
    idle = servers.join(met, ["harness", "config_hash"], "left_anti")
    none = F.lit(None).cast("bigint")
    rows = own.unionByName(idle.select("harness", F.lit("mcp_server").alias("kind"), "name", "scope", F.col("name").alias("suite"), F.lit("not connected").alias("notes"), none.alias("catalog_tokens"), none.alias("body_tokens")))
    return in_report_order(rows)


def in_report_order(rows: DataFrame) -> DataFrame:
    """By harness; skills, then commands and idle servers, then tools; within these by suite (none last) and name."""
    rank = F.when(F.col("kind") == "skill", 0).when(F.col("kind").isin("command", "mcp_server"), 1).otherwise(2)
    return rows.orderBy("harness", rank, F.col("suite").asc_nulls_last(), "name", "scope", "notes")


def idle_harnesses(harnesses: DataFrame, effective: DataFrame, servers: DataFrame) -> DataFrame:
    """Harnesses that load nothing and have no servers."""
    busy = effective.select("harness").unionByName(servers.select("harness")).distinct()
    return harnesses.select(F.col("id").alias("harness")).join(busy, "harness", "left_anti")


def summary(findings: DataFrame, seen: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """severity, total, unseen, acknowledged, gravest first."""
    flagged = findings.join(seen.select("fingerprint", F.lit(True).alias("s")).distinct(), "fingerprint", "left").join(acknowledged.select("fingerprint", F.lit(True).alias("k")).distinct(), "fingerprint", "left")
    counts = flagged.groupBy("severity").agg(F.count_if(F.col("k").isNull()).alias("total"), F.count_if(F.col("k").isNull() & F.col("s").isNull()).alias("unseen"), F.count_if(F.col("k").isNotNull()).alias("acknowledged"))
    return counts.orderBy(severity_rank("severity").desc())


def shown_first(rows: DataFrame, keys: list[str], order: list[str], text: str, most: int = 5) -> DataFrame:
    """keys, shown (the first `most` texts in order), more (how many were left out). The rank limit runs before the
    shuffle too."""
    from pyspark.sql import Window

    least = rows.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("k") <= most)
    first = least.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", F.col(text).alias("t")))), lambda x: x["t"]).alias("shown"))
    total = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return total.join(first, keys).select(*keys, "shown", F.greatest(F.col("n") - most, F.lit(0)).alias("more"))


def schema_difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """config_hash, tool, words: what only the new schema text says, in its order, then what only the old one said."""
    a, b = old.select("config_hash", "tool", F.col("schema_text").alias("before")), new.select("config_hash", "tool", F.col("schema_text").alias("after"))
    fresh = F.filter("after", lambda w: ~F.array_contains("before", w))
    gone = F.filter("before", lambda w: ~F.array_contains("after", w))
    return a.join(b, ["config_hash", "tool"]).select("config_hash", "tool", F.concat(fresh, gone).alias("words")).where(F.size("words") > 0)


def printable_details(findings: DataFrame) -> DataFrame:
    """Details with invisible characters spelled out, so that no scanned text can forge a report line."""
    from larkspur.functions.structures import printable

    return findings.withColumn("detail", printable(T.flat("detail")))
