"""The one result schema of all checks, and what is done with findings: merge, order, acknowledge, gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import text as T

COLUMNS = ("check_id", "severity", "contributors", "contributor_names", "harnesses", "detail", "fingerprint")


def finding(df: DataFrame, check_id: str, severity: Column | str, ids: Column, names: Column, harnesses: Column, detail: Column, parts: Column, extra: Column | None = None) -> DataFrame:
    level = F.lit(severity) if isinstance(severity, str) else severity
    as_list = lambda c: F.coalesce(c.cast("array<string>"), F.array().cast("array<string>"))
    return df.select(
        F.lit(check_id).alias("check_id"), level.alias("severity"), F.array_sort(as_list(ids)).alias("contributors"), F.array_sort(as_list(names)).alias("contributor_names"),
        F.array_sort(F.array_distinct(as_list(harnesses))).alias("harnesses"), detail.cast("string").alias("detail"), T.fingerprint(check_id, as_list(parts), extra).alias("fingerprint"),
    )


def merge(findings: DataFrame) -> DataFrame:
    """Findings of one fingerprint are one, with the harnesses of all."""
    rest = F.struct("check_id", "severity", "contributors", "contributor_names", "detail")
    grouped = findings.groupBy("fingerprint").agg(F.min(rest).alias("f"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("harnesses")))).alias("harnesses"))
    return grouped.select("f.check_id", "f.severity", "f.contributors", "f.contributor_names", "harnesses", "f.detail", "fingerprint")


def ordered(findings: DataFrame) -> DataFrame:
    """By severity as a word (error, note, warning), check and detail."""
    return findings.orderBy("severity", "check_id", "detail", "fingerprint")


def reported(findings: DataFrame, seen: DataFrame, system: DataFrame) -> DataFrame:
    """Unseen first, findings about none but system contributors last, then by check and detail."""
    known = findings.join(seen.select("fingerprint", F.lit(1).alias("s")).distinct(), "fingerprint", "left").withColumn("is_seen", F.col("s").isNotNull()).drop("s")
    own = known.select("fingerprint", F.explode("contributors").alias("id")).join(system.select("id", "system"), "id", "left")
    alone = own.groupBy("fingerprint").agg(F.bool_and(F.coalesce("system", F.lit(False))).alias("all_system"))
    return known.join(alone, "fingerprint", "left").withColumn("all_system", F.coalesce("all_system", F.lit(False))).orderBy("is_seen", "all_system", "check_id", "detail")


def active(findings: DataFrame, acks: DataFrame) -> DataFrame:
    return findings.join(acks.select("fingerprint"), "fingerprint", "left_anti")


def acknowledged(findings: DataFrame, acks: DataFrame) -> DataFrame:
    return findings.join(acks.select("fingerprint"), "fingerprint", "left_semi")


def severity_rank(c: Column | str) -> Column:
    c = T.col(c)
    return F.when(c == "error", 3).when(c == "warning", 2).when(c == "note", 1).otherwise(0)


def blocking(findings: DataFrame, fail_on: str = "warning") -> DataFrame:
    return findings.where(severity_rank("severity") >= severity_rank(F.lit(fail_on)))


def summary(findings: DataFrame, seen: DataFrame) -> DataFrame:
    """severity, total, unseen."""
    flagged = findings.join(seen.select("fingerprint", F.lit(1).alias("s")).distinct(), "fingerprint", "left")
    return flagged.groupBy("severity").agg(F.count("*").alias("total"), F.count_if(F.col("s").isNull()).alias("unseen"))


def short_id(c: Column | str = "fingerprint") -> Column:
    return F.substring(F.split_part(T.col(c), F.lit(":"), F.lit(2)), 1, 4)


def resolve_refs(findings: DataFrame, refs: DataFrame) -> DataFrame:
    """ref, fingerprint where exactly one finding's hash begins with the ref (4 to 64 hex digits)."""
    valid = refs.where(F.col("ref").rlike("^[0-9a-f]{4,64}$"))
    keyed = findings.select("fingerprint", F.split_part("fingerprint", F.lit(":"), F.lit(2)).alias("hex"))
    # both sides meet on the first four digits, which every valid ref has
    joined = valid.join(keyed, F.substring("ref", 1, 4) == F.substring("hex", 1, 4)).where(F.col("hex").startswith(F.col("ref")))
    return joined.groupBy("ref").agg(F.count("*").alias("n"), F.min("fingerprint").alias("fingerprint")).where("n = 1").drop("n")


def match_targets(findings: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per wanted (check_id, names): the finding of exactly those names, else the only one that has them all."""
    asked = wanted.select(F.monotonically_increasing_id().alias("w"), "check_id", F.array_sort("names").alias("names"))
    pairs = asked.join(findings.select("check_id", "contributor_names", "fingerprint"), "check_id").where(F.size(F.array_except("names", "contributor_names")) == 0)
    exact = F.col("contributor_names") == F.col("names")
    best = pairs.groupBy("w", "check_id", "names").agg(F.min(F.when(exact, F.col("fingerprint"))).alias("exact"), F.count("*").alias("n"), F.min("fingerprint").alias("only"))
    return best.select("check_id", "names", F.coalesce("exact", F.when(F.col("n") == 1, F.col("only"))).alias("fingerprint")).where("fingerprint is not null")


def mark_seen(findings: DataFrame, seen: DataFrame, today: str) -> DataFrame:
    """fingerprint and first_seen of the current findings; what is gone is forgotten."""
    now = findings.select("fingerprint").distinct()
    return now.join(seen.groupBy("fingerprint").agg(F.min("first_seen").alias("first_seen")), "fingerprint", "left").select("fingerprint", F.coalesce("first_seen", F.lit(today)).alias("first_seen"))


def ack_scope(findings: DataFrame, contributors: DataFrame) -> DataFrame:
    """fingerprint and scope: user if all its contributors are, else project."""
    own = findings.select("fingerprint", F.explode_outer("contributors").alias("id")).join(contributors.select("id", "scope"), "id", "left")
    return own.groupBy("fingerprint").agg(F.when(F.bool_and(F.coalesce(F.col("scope") == "user", F.lit(False))), "user").otherwise("project").alias("scope"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of the same keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def prune(rows: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(live.select(*keys).distinct(), keys, "left_semi")


def fold_ack_events(events: DataFrame) -> DataFrame:
    """State of each fingerprint: its event of highest server_sequence."""
    return events.groupBy("fingerprint").agg(F.max_by("action", "server_sequence").alias("action"), F.max("server_sequence").alias("server_sequence"))


def mint_events(base: DataFrame, current: DataFrame) -> DataFrame:
    """fingerprint, action between two sets of acknowledgements."""
    fresh = current.select("fingerprint").distinct().join(base.select("fingerprint"), "fingerprint", "left_anti").withColumn("action", F.lit("acknowledged"))
    gone = base.select("fingerprint").distinct().join(current.select("fingerprint"), "fingerprint", "left_anti").withColumn("action", F.lit("reopened"))
    return fresh.unionByName(gone)


def first_by(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
