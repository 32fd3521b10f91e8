"""Drift against approved states: lockfiles, published entries, verdicts, file sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions import text as T

from .findings import finding


def lockfile_drift(lock: DataFrame, skills: DataFrame) -> DataFrame:
    """lock: name, expected (null without a hash). skills: seq, id, name, tree_hash.

    If no hashed entry matches at all, one row says that hashes cannot be judged, in place of every mismatch.
    """
    last = skills.groupBy("name").agg(F.max_by(F.struct("id", "tree_hash"), "seq").alias("s"))
    judged = lock.join(last, "name", "left").select("name", "expected", "s.id", "s.tree_hash")
    state = F.when(F.col("id").isNull(), "missing").when(F.col("expected").isNull(), "unhashed").when(F.col("expected") == F.col("tree_hash"), "match").otherwise("changed")
    rows = judged.withColumn("state", state)
    matched = rows.agg(F.coalesce(F.max((F.col("state") == "match").cast("int")), F.lit(0)).alias("any_match"), F.coalesce(F.max((F.col("state") == "changed").cast("int")), F.lit(0)).alias("any_change"))
    flagged = rows.join(F.broadcast(matched))
    each = flagged.where("state = 'missing' or (state = 'changed' and any_match = 1)").select("name", "id", "state")
    blind = matched.where("any_match = 0 and any_change = 1").select(F.lit("").alias("name"), F.lit(None).cast("string").alias("id"), F.lit("unverifiable").alias("state"))
    ids, names = F.array_compact(F.array("id")), F.array_compact(F.array(F.nullif("name", F.lit(""))))
    return finding(each.unionByName(blind), "lockfile-drift", "warning", ids, names, F.array().cast("array<string>"), F.col("state"), ids, F.concat_ws(":", "state", "name"))


def classify_entries(entries: DataFrame, skills: DataFrame, pins: DataFrame, loadout: str) -> DataFrame:
    """selector, id, state, note of published skill entries (selector, name, content_hash) against local skills.

    A single pin of the entry decides; else the first skill of its normalised name and hash, else the first of its name.
    """
    named = skills.select("seq", "id", "content_hash", T.slug("name").alias("n"))
    bound = pins.where(F.col("loadout") == loadout).select("selector", F.col("path").alias("id")).join(named, "id")
    single = bound.groupBy("selector").agg(F.count("*").alias("k"), F.min(F.struct("id", "content_hash")).alias("b")).where("k = 1").select("selector", "b")
    by_name = entries.join(named.select("seq", "id", F.col("content_hash").alias("local"), "n"), F.col("name") == F.col("n"))
    best = by_name.groupBy("selector").agg(F.min_by(F.struct("id", "local"), F.struct((F.col("local") != F.col("content_hash")).alias("x"), "seq")).alias("c"), F.count("*").alias("m"))
    joined = entries.join(single, "selector", "left").join(best, "selector", "left")
    chosen, local = F.coalesce("b.id", "c.id"), F.coalesce("b.content_hash", "c.local")
    state = F.when(chosen.isNull(), "missing").when(local == F.col("content_hash"), "matches").otherwise("changed")
    note = F.when(F.col("b").isNull() & (F.col("m") > 1) & (state == "changed"), "several local skills share this name")
    return joined.select("selector", chosen.alias("id"), state.alias("state"), note.alias("note"))


def diff_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change (added, removed, changed, unchanged) between listings (path, hash)."""
    a, b = old.alias("a"), new.alias("b")
    both = a.join(b, F.col("a.path") == F.col("b.path"), "full_outer")
    change = F.when(F.col("a.path").isNull(), "added").when(F.col("b.path").isNull(), "removed").when(F.col("a.hash") == F.col("b.hash"), "unchanged").otherwise("changed")
    return both.select(F.coalesce("a.path", "b.path").alias("path"), change.alias("change"))


def flagged_pairs(findings: DataFrame) -> DataFrame:
    """fingerprint, a, b: unordered member pairs of each overlap finding, a < b."""
    own = findings.where("check_id = 'description-overlap'").select("fingerprint", "contributor_names")
    later = F.transform("contributor_names", lambda x, i: F.transform(F.slice("contributor_names", i + 2, F.size("contributor_names")), lambda y: F.struct(x.alias("a"), y.alias("b"))))
    return own.select("fingerprint", F.explode(F.flatten(later)).alias("p")).select("fingerprint", "p.a", "p.b")


def apply_verdicts(findings: DataFrame, pairs: DataFrame, verdicts: DataFrame, injected: DataFrame) -> DataFrame:
    """Overlap findings all of whose pairs are judged distinct become notes, unless a member has an injection finding."""
    judged = pairs.join(verdicts, ["a", "b"], "left").groupBy("fingerprint").agg(F.bool_and(F.coalesce(F.col("verdict") == "distinct", F.lit(False))).alias("distinct"))
    held = pairs.select("fingerprint", F.explode(F.array("a", "b")).alias("name")).join(injected.select("name"), "name", "left_semi").select("fingerprint").distinct().withColumn("held", F.lit(True))
    joined = findings.join(judged, "fingerprint", "left").join(held, "fingerprint", "left")
    lower = F.coalesce("distinct", F.lit(False)) & F.col("held").isNull()
    return joined.withColumn("severity", F.when(lower, "note").otherwise(F.col("severity"))).select(*findings.columns)
