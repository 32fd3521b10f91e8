"""Published loadouts against what is here: states of servers, editing, grouping of copies, health recounts, refreshes.

entries: pos, selector, kind, name, content_hash (and server_name of servers).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import structures
from larkspur.functions import text as T

from .findings import first_by


def server_states(entries: DataFrame, servers: DataFrame) -> DataFrame:
    """selector, config_hash, source, state of published server entries: matches by hash; else changed, by the name that
    the entry recorded or its selector's; else missing. The first server in order decides."""
    # the first server of each hash and name is found before entries meet them, so a common name makes no long list
    hashed = servers.groupBy(F.concat(F.lit("sha256:"), F.col("config_hash")).alias("content_hash")).agg(F.min("seq").alias("seq"))
    named = servers.select("seq", F.explode(F.array_distinct(F.array(F.struct(F.lit(True).alias("plain"), F.col("name").alias("key")), F.struct(F.lit(False).alias("plain"), T.slug("name").alias("key"))))).alias("k")).groupBy("k").agg(F.min("seq").alias("seq"))
    asked = entries.select("selector", F.explode(F.array(F.struct(F.lit(True).alias("plain"), F.col("server_name").alias("key")), F.struct(F.lit(False).alias("plain"), F.col("name").alias("key")))).alias("k"))
    found = entries.join(hashed, "content_hash").select("selector", "seq", F.lit("matches").alias("state")).unionByName(asked.join(named, "k").select("selector", "seq", F.lit("changed").alias("state")))
    first = first_by(found, ["selector"], [F.col("state").desc(), "seq"]).join(servers.select("seq", "config_hash", "source"), "seq")
    best = first_by(first, ["selector"], ["config_hash", "source"]).select("selector", "config_hash", "source", "state")
    return entries.select("selector").join(best, "selector", "left").withColumn("state", F.coalesce("state", F.lit("missing")))


def grouped_copies(contributors: DataFrame, loads: DataFrame) -> DataFrame:
    """Copies of one kind and normalised name as one row: the id of the representative (a tracked one first, then the
    least id), copies, harnesses, whether any is the project's."""
    tracked = F.col("provenance").isin("gh-skill", "skills-lock") & (F.coalesce("source", F.lit("")) != "")
    own = contributors.select("id", "kind", "scope", T.slug("name").alias("name"), tracked.alias("tracked"))
    best = own.groupBy("kind", "name").agg(F.min_by("id", F.struct(~F.coalesce("tracked", F.lit(False)), "id")).alias("id"), F.count("*").alias("copies"), F.bool_or(F.col("scope") == "project").alias("in_project"))
    used = own.select("id", "kind", "name").join(loads.select("id", "harness").distinct(), "id").groupBy("kind", "name").agg(F.array_sort(F.collect_set("harness")).alias("harnesses"))
    return best.join(used, ["kind", "name"], "left").withColumn("harnesses", F.coalesce("harnesses", F.array().cast("array<string>")))


def edit_items(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """rows (seq, id, selector) against entries by selector: row, entry position, checked.

    An entry is claimed by the first row of its selector, and of entries of one selector only the first can be; entries
    that nothing claims stay, checked, without a row."""
    first_row, first_entry = first_by(rows, ["selector"], ["seq"]), first_by(entries, ["selector"], ["pos"])
    claims = first_row.join(first_entry.select("selector", "pos"), "selector").select("id", "pos")
    here = rows.join(claims, "id", "left").select("id", "selector", "pos", F.col("pos").isNotNull().alias("checked"))
    rest = entries.join(claims, "pos", "left_anti").select(F.lit(None).cast("string").alias("id"), "selector", "pos", F.lit(True).alias("checked"))
    return here.unionByName(rest)


def edited(entries: DataFrame, items: DataFrame, additions: DataFrame) -> DataFrame:
    """pos (null for additions), selector, change (kept, removed, added, skipped): what a selection of items makes of
    the entries. additions (seq, selector): of one selector only the first counts, and none that a kept entry has."""
    kept = entries.join(items.where("pos is not null").select("pos").distinct(), "pos", "left_semi").select("pos", "selector")
    gone = entries.join(kept, "pos", "left_anti").select("pos", "selector", F.lit("removed").alias("change"))
    nth = F.row_number().over(Window.partitionBy("selector").orderBy("seq"))
    taken = kept.select("selector").distinct().withColumn("taken", F.lit(True))
    fresh = additions.withColumn("n", nth).join(taken, "selector", "left")
    change = F.when(F.col("taken").isNotNull() | (F.col("n") > 1), "skipped").otherwise("added")
    return kept.withColumn("change", F.lit("kept")).unionByName(gone).unionByName(fresh.select(F.lit(None).cast("bigint").alias("pos"), "selector", change.alias("change")))


def tool_servers(tools: DataFrame, servers: DataFrame) -> DataFrame:
    """config_hash, selector, note of the servers behind selected tools (seq, id: configuration:tool, name), each once,
    in order of first selection; a second server of a selector and a server that is gone get a note."""
    picked = tools.withColumn("config_hash", F.split_part("id", F.lit(":"), F.lit(1)))
    known = servers.groupBy("config_hash").agg(F.max_by("name", "seq").alias("server"))
    missing = picked.join(known, "config_hash", "left_anti").select("config_hash", F.lit(None).cast("string").alias("selector"), F.concat(F.lit("server gone: "), "name").alias("note"))
    behind = picked.groupBy("config_hash").agg(F.min("seq").alias("seq")).join(known, "config_hash").withColumn("selector", F.concat(F.lit("mcp:"), T.slug("server")))
    nth = F.row_number().over(Window.partitionBy("selector").orderBy("seq"))
    return behind.select("config_hash", "selector", F.when(nth > 1, F.concat(F.lit("second server: "), "server")).alias("note")).unionByName(missing)


def recounted(reported: DataFrame, fresh: DataFrame) -> DataFrame:
    """A health report (selector, fingerprint, severity) with the findings of the selectors that `fresh` has replaced."""
    return reported.join(fresh.select("selector").distinct(), "selector", "left_anti").unionByName(fresh)


def health_summary(reported: DataFrame) -> DataFrame:
    """errors, warnings, notices."""
    severe = F.coalesce("severity", F.lit(""))
    return reported.agg(F.count_if(severe == "error").alias("errors"), F.count_if(severe == "warning").alias("warnings"), F.count_if(~severe.isin("error", "warning")).alias("notices"))


def folder_action(local_hash: Column, recorded_hash: Column, wanted_hash: Column) -> Column:
    """unchanged where the folder already is what is wanted, held where it was edited since it was recorded, else write."""
    return F.when(local_hash.isNull(), "write").when(local_hash == wanted_hash, "unchanged").when(recorded_hash.isNotNull() & (local_hash != recorded_hash), "held").otherwise("write")


def refreshed(entries: DataFrame, states: DataFrame, local: DataFrame) -> DataFrame:
    """entries with the hash of what is here (selector, hash) where their state is changed, and whether that was done."""
    changed = states.where("state = 'changed'").select("selector").join(local, "selector")
    joined = entries.join(changed.select("selector", F.col("hash").alias("fresh")), "selector", "left")
    return joined.withColumn("content_hash", F.coalesce("fresh", "content_hash")).withColumn("updated", F.col("fresh").isNotNull()).drop("fresh")


def verified_installs(installs: DataFrame) -> DataFrame:
    """installs (directory_hash, expected_directory, skill_hash, expected) with result."""
    return installs.withColumn("result", structures.verified(F.col("directory_hash"), F.col("expected_directory"), F.col("skill_hash"), F.col("expected")))
