"""Which copy of a skill each harness loads, and the checks on copies.

loads: one row per deployment joined to its contributor (harness, ord, path, scope, via_symlink, id, seq, kind, name,
content_hash, catalog_tokens, body_tokens, plugin, system). harnesses: id, search_order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .findings import finding, first_by


def mark_shadows(loads: DataFrame, harnesses: DataFrame) -> DataFrame:
    """loads with shadowed_by: the winner's id where another copy of that name and other content comes first.

    Only skills of harnesses with a search order take part; plugin copies of the namespacing harness do not.
    """
    ordered = loads.join(F.broadcast(harnesses.select(F.col("id").alias("harness"), "search_order")), "harness", "left")
    takes_part = (F.col("kind") == "skill") & (F.coalesce("search_order", F.lit("none")) != "none") & ~((F.col("harness") == "claude-code") & F.coalesce("plugin", F.lit(False)))
    w = Window.partitionBy("harness", "name", takes_part).orderBy("ord", "path").rowsBetween(Window.unboundedPreceding, 0)
    first = F.first_value(F.struct("id", "content_hash")).over(w)
    lost = takes_part & (first["id"] != F.col("id")) & (first["content_hash"] != F.col("content_hash"))
    return ordered.withColumn("shadowed_by", F.when(lost, first["id"])).drop("search_order")


def effective(marked: DataFrame) -> DataFrame:
    """Unshadowed loads, each contributor once per harness."""
    return first_by(marked.where("shadowed_by is null"), ["harness", "id"], ["ord", "path"])


def promote_scope(loads: DataFrame) -> DataFrame:
    """id and scope: project if any deployment is; system if any path has a .system part."""
    system = F.col("path").rlike(r"(^|/)\.system(/|$)")
    return loads.groupBy("id").agg(F.when(F.max((F.col("scope") == "project").cast("int")) == 1, "project").otherwise("user").alias("scope"), F.max(system).alias("system"))


def name_shadow(marked: DataFrame) -> DataFrame:
    lost = marked.where("shadowed_by is not null")
    return finding(lost, "name-shadow", "warning", F.array("shadowed_by", "id"), F.array("name", "name"), F.array("harness"), F.concat_ws(" ", "name", "path"), F.array("content_hash"), F.concat_ws("|", "harness", "shadowed_by", "path"))


def double_load(marked: DataFrame) -> DataFrame:
    own = marked.where("kind = 'skill' and shadowed_by is null").select("harness", "content_hash", "id", "name").distinct()
    groups = own.groupBy("harness", "content_hash").agg(F.count("*").alias("n"), F.collect_list("id").alias("ids"), F.collect_list("name").alias("names")).where("n > 1")
    return finding(groups, "double-load", "error", F.col("ids"), F.col("names"), F.array("harness"), F.concat(F.col("n"), F.lit(" copies")), F.array("content_hash"), F.col("harness"))


def _coloaded(marked: DataFrame, key: str, plugins: bool = True) -> DataFrame:
    """key values of which some harness loads two contributors, and which pairs are not loaded together are left."""
    own = marked if plugins else marked.where(~((F.col("harness") == "claude-code") & F.coalesce("plugin", F.lit(False))))
    return own.select("harness", key, "id").distinct().groupBy("harness", key).agg(F.count("*").alias("n"))


def exact_duplicate(contributors: DataFrame, marked: DataFrame) -> DataFrame:
    """Groups of one content of which not every pair is loaded by one harness (that is double-load's)."""
    groups = contributors.where("kind = 'skill'").groupBy("content_hash").agg(F.count("*").alias("n"), F.collect_list("id").alias("ids"), F.collect_list("name").alias("names")).where("n > 1")
    # every pair is loaded together just when the harness sets cover all n(n-1)/2 pairs; a pair is counted once by
    # the least harness that loads both, through the sorted sets of harnesses of its two members
    own = marked.where("shadowed_by is null").select("id", "content_hash", "harness").distinct().groupBy("id", "content_hash").agg(F.array_sort(F.collect_list("harness")).alias("hs"))
    kinds = own.groupBy("content_hash", "hs").agg(F.count("*").alias("k"))
    a, b = kinds.alias("a"), kinds.alias("b")
    met = a.join(b, (F.col("a.content_hash") == F.col("b.content_hash")) & F.arrays_overlap("a.hs", "b.hs"))
    pairs = met.groupBy("a.content_hash").agg(F.sum(F.when(F.col("a.hs") == F.col("b.hs"), F.col("a.k") * (F.col("a.k") - 1)).otherwise(F.col("a.k") * F.col("b.k"))).alias("together"))
    left = groups.join(pairs, "content_hash", "left").where(F.coalesce("together", F.lit(0)) < F.col("n") * (F.col("n") - 1))
    return finding(left, "exact-duplicate", "warning", F.col("ids"), F.col("names"), F.array().cast("array<string>"), F.concat(F.col("n"), F.lit(" copies")), F.array("content_hash"))


def diverged_copies(contributors: DataFrame, marked: DataFrame) -> DataFrame:
    """Names with several contents, no two of whose copies any harness loads together."""
    groups = contributors.where("is_skill_md").groupBy("name").agg(
        F.count_distinct("content_hash").alias("n"), F.collect_list("id").alias("ids"), F.collect_list("name").alias("names"), F.collect_set("content_hash").alias("hashes"), F.count_distinct("routing_text").alias("descriptions")
    ).where("n > 1")
    skills = marked.join(contributors.where("is_skill_md").select("id"), "id", "left_semi")
    together = _coloaded(skills, "name", plugins=False).where("n > 1").select("name").distinct()
    left = groups.join(together, "name", "left_anti")
    detail = F.concat(F.col("n"), F.lit(" contents, "), F.when(F.col("descriptions") == 1, "descriptions identical").otherwise("descriptions differ"))
    return finding(left, "diverged-copies", "warning", F.col("ids"), F.col("names"), F.array().cast("array<string>"), detail, F.col("hashes"))


def budget_catalog(effective_loads: DataFrame, limit: int = 6000) -> DataFrame:
    totals = effective_loads.where("kind = 'skill'").groupBy("harness").agg(F.sum("catalog_tokens").alias("total")).where(F.col("total") > limit)
    none = F.array().cast("array<string>")
    return finding(totals, "budget-catalog-tokens", "warning", none, none, F.array("harness"), F.col("total"), F.array("harness"))


def budget_body(contributors: DataFrame, limit: int = 20000) -> DataFrame:
    over = contributors.where((F.col("kind") == "skill") & (F.col("body_tokens") > limit))
    return finding(over, "budget-body-tokens", "warning", F.array("id"), F.array("name"), F.array().cast("array<string>"), F.col("body_tokens"), F.array("content_hash"))


def list_totals(marked: DataFrame) -> DataFrame:
    """Per harness: distinct contributors with an unshadowed load, and their catalog tokens."""
    return effective(marked).groupBy("harness").agg(F.count("*").alias("contributors"), F.sum("catalog_tokens").alias("catalog_tokens"))


def context_bill(marked: DataFrame) -> DataFrame:
    """The harness with the largest bill of skill and tool tokens among those with tools; ties go to the first."""
    tokens = effective(marked).groupBy("harness").agg(
        F.sum(F.when(F.col("kind") == "skill", F.col("catalog_tokens")).otherwise(0)).alias("skill_tokens"), F.sum(F.when(F.col("kind") == "mcp_tool", F.col("catalog_tokens")).otherwise(0)).alias("tool_tokens")
    )
    return tokens.where("tool_tokens > 0").orderBy((F.col("skill_tokens") + F.col("tool_tokens")).desc(), "harness").limit(1)


def scope_winner(servers: DataFrame, harnesses: DataFrame) -> DataFrame:
    """The server entry of each (harness, name) that wins by scope."""
    own = servers.join(F.broadcast(harnesses.select(F.col("id").alias("harness"), "search_order")), "harness", "left")
    preferred = F.when(F.col("search_order") == "global-first", "user").otherwise("project")
    return first_by(own, ["harness", "name"], [(F.col("scope") == preferred).desc(), "seq"]).drop("search_order")


def unique_selectors(rows: DataFrame) -> DataFrame:
    """rows (seq, selector) with a unique selector: the n-th equal one gets -n, passing over suffixes already taken."""

    def number(pdf):  # noqa: ANN001, ANN202
        pdf = pdf.sort_values("seq")
        # a suffixed name is free if no row has it as its own, so the sequential rule stays inside one stem
        taken = set(pdf.literal.iloc[0])
        out, n = [], 1
        for k, s in enumerate(pdf.selector):
            if k == 0:
                out.append(s)
                continue
            n += 1
            while f"{s}-{n}" in taken:
                n += 1
            out.append(f"{s}-{n}")
        return pdf.assign(unique=out)[["seq", "selector", "unique"]]

    stem = F.regexp_replace("selector", r"-\d+$", "")
    literal = rows.where(stem != F.col("selector")).groupBy(stem.alias("selector")).agg(F.collect_set("selector").alias("literal"))
    held = rows.join(literal, "selector", "left").withColumn("literal", F.coalesce("literal", F.array().cast("array<string>")))
    return held.groupBy("selector").applyInPandas(number, "seq long, selector string, unique string")
