"""Usage analytics over invocations (harness, session_id, project, ts, kind, name, server, sidechain, detection, source_file, seq)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["kind", "name", "server"]
MIN_SPAN_DAYS = 7.0


def usage_by_name(invocations: DataFrame) -> DataFrame:
    """Per harness and (kind, name, server): main-thread and side uses, sessions, last use, whether any is inferred."""
    return invocations.groupBy("harness", *KEY).agg(
        F.count_if(~F.col("sidechain")).alias("uses"), F.count_if("sidechain").alias("sidechain_uses"), F.count_distinct("session_id").alias("sessions"),
        F.max("ts").alias("last_used"), F.bool_or(F.col("detection") != "explicit").alias("heuristic"),
    )


def coverage(invocations: DataFrame) -> DataFrame:
    """Per harness: first and last time, sessions, invocations, span in days (seven at least)."""
    span = (F.unix_micros("last") - F.unix_micros("first")) / F.lit(86400e6)
    grouped = invocations.groupBy("harness").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count_distinct("session_id").alias("sessions"), F.count("*").alias("invocations"))
    return grouped.withColumn("span_days", F.greatest(span, F.lit(MIN_SPAN_DAYS)))


def rollup(invocations: DataFrame) -> DataFrame:
    """Over all harnesses: sums (sessions count once for each harness) and main-thread uses a week."""
    spans = coverage(invocations).select("harness", "span_days")
    joined = usage_by_name(invocations).join(F.broadcast(spans), "harness")
    return joined.groupBy(*KEY).agg(
        F.sum("uses").alias("uses"), F.sum("sidechain_uses").alias("sidechain_uses"), F.sum("sessions").alias("sessions"), F.max("last_used").alias("last_used"),
        F.bool_or("heuristic").alias("heuristic"), F.sum(F.col("uses") / (F.col("span_days") / 7.0)).alias("per_week"),
    )


def shares(invocations: DataFrame) -> DataFrame:
    """usage_by_name with each row's percent of its harness's main-thread uses."""
    total = F.greatest(F.sum("uses").over(Window.partitionBy("harness")), F.lit(1))
    return usage_by_name(invocations).withColumn("percent", F.col("uses") * 100.0 / total)


def ranked(rows: DataFrame, overall: bool = False) -> DataFrame:
    """By harness, uses downward and name; over all harnesses by weekly uses downward and name."""
    order = [F.col("per_week").desc(), "name"] if overall else ["harness", F.col("uses").desc(), "name"]
    return rows.orderBy(*order, "kind", F.coalesce("server", F.lit("")))


def labelled(rows: DataFrame) -> DataFrame:
    """rows with the label that reports show: a mark where a use is inferred, tool for mcp_tool."""
    return rows.withColumn("label", F.concat("name", F.when(F.col("heuristic"), " ~").otherwise(""))).withColumn("kind_label", F.replace("kind", F.lit("mcp_tool"), F.lit("tool")))


def unlike_windows(invocations: DataFrame) -> DataFrame:
    """harness, span_days where the longest span is over twice the shortest: rates compare, counts do not."""
    spans = coverage(invocations).select("harness", "span_days")
    ends = spans.agg(F.max("span_days").alias("most"), F.min("span_days").alias("least"))
    return spans.join(F.broadcast(ends)).where("most / least > 2").select("harness", "span_days")


def uses_of(invocations: DataFrame, name: str) -> DataFrame:
    """Every use of `name` (or server:tool), newest first."""
    return invocations.where(matches(name)).orderBy(F.col("ts").desc(), "seq")


def drilldown(invocations: DataFrame, name: str) -> DataFrame:
    """Per key and harness, how often `name` (or server:tool) was invoked."""
    return invocations.where(matches(name)).groupBy(*KEY, "harness").agg(F.count("*").alias("n"), F.max("ts").alias("last_used"))


def matches(name: str) -> Column:
    return (F.col("name") == name) | (F.concat_ws(":", "server", "name") == name)


def last_session(invocations: DataFrame) -> DataFrame:
    """Only the source file of the newest invocation; of equal times the highest seq decides."""
    newest = invocations.agg(F.max_by("source_file", F.struct("ts", "seq")).alias("source_file"))
    return invocations.join(F.broadcast(newest), "source_file", "left_semi")


def in_scope(invocations: DataFrame, since: str | None = None, project: str | None = None, munged: str | None = None) -> DataFrame:
    """Since a time, of a project; a null project counts only by the munged parent folder of one harness's files."""
    out = invocations
    if since is not None:
        out = out.where(F.col("ts") >= F.to_timestamp(F.lit(since)))
    if project is not None:
        by_folder = (F.col("harness") == "claude-code") & (F.element_at(F.split("source_file", "/"), -2) == F.lit(munged))
        out = out.where(F.when(F.col("project").isNotNull(), F.col("project") == project).otherwise(F.coalesce(by_folder, F.lit(False))))
    return out


def carry_forward(events: DataFrame, value: Column, name: str, keys: tuple[str, ...] = ("source_file",), order: tuple[str, ...] = ("line",)) -> DataFrame:
    """events with the latest non-null value at or above each row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn(name, F.last(value, ignorenulls=True).over(w))


def covered_harnesses(invocations: DataFrame, today: str, days: int) -> DataFrame:
    first = invocations.groupBy("harness").agg(F.min(F.to_date("ts")).alias("first"))
    return first.where(F.datediff(F.lit(today).cast("date"), "first") >= days).select("harness")


def unused(contributors: DataFrame, loads: DataFrame, invocations: DataFrame, servers: DataFrame, pins: DataFrame, today: str, days: int = 90) -> DataFrame:
    """Installed but never used: kind, id, name, server. System rows, harnesses without a long enough trace,
    fresh installs and tools of unknown servers are unknown, not unused."""
    covered = loads.join(covered_harnesses(invocations, today, days), "harness", "left_semi").select("id").distinct()
    fresh = pins.where(F.datediff(F.lit(today).cast("date"), F.expr("try_cast(installed_at as date)")) < days).select(F.col("path").alias("id"))
    judged = contributors.where("not system").join(covered, "id", "left_semi").join(fresh, "id", "left_anti")
    tools = judged.where("kind = 'mcp_tool'").withColumn("config_hash", F.split_part("id", F.lit(":"), F.lit(1)))
    named = tools.join(servers.groupBy("config_hash").agg(F.max_by("name", "seq").alias("server")), "config_hash")
    used_tools = invocations.where("kind = 'mcp_tool'").select(F.coalesce("server", F.lit("")).alias("server"), "name").distinct()
    left_tools = named.join(used_tools, ["server", "name"], "left_anti").select("kind", "id", "name", "server")
    used = invocations.where("kind <> 'mcp_tool'").select(F.col("name").alias("used")).distinct()
    others = judged.where("kind <> 'mcp_tool'")
    called = others.select("id", F.explode(F.array_compact(F.array("name", F.when(F.col("suite").isNotNull() & (F.col("suite") != ""), F.concat_ws(":", "suite", "name"))))).alias("used")).join(used, "used", "left_semi")
    left = others.join(called.select("id").distinct(), "id", "left_anti").select("kind", "id", "name", F.lit(None).cast("string").alias("server"))
    return left.unionByName(left_tools)


def ranked_unused(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.when(F.col("kind") == "skill", 0).when(F.col("kind") == "command", 1).otherwise(2), "name")
