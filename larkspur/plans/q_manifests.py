"""Queries of the manifest rules: fixed documents spread over the suppliers, expected findings stated by hand."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import manifests as M

from . import adapters as A
from .registry import query


def rows_of(findings: DataFrame) -> DataFrame:
    return findings.select("check_id", "severity", F.col("contributors")[0].alias("root"), F.coalesce(F.get("contributor_names", F.lit(0)), F.lit("")).alias("name"), F.col("detail").alias("reason"))


def expect(check: str, kind: str, rows: list[tuple], where: str = "true") -> str:
    """rows: (document number, severity, name, reason)."""
    if not rows:
        return ""
    return f"SELECT '{check}' AS check_id, severity, '/r/' || CAST(s_suppkey AS VARCHAR) AS root, name, reason FROM supplier JOIN {A.sql_values(rows, 'i, severity, name, reason')} e ON e.i = s_suppkey % {len(A.MANIFESTS[kind])} WHERE {where}"


def register(check: str, kind: str, rows: list[tuple], run: Callable[[SparkSession, str], DataFrame]) -> None:
    query(expect(check, kind, rows), "check_" + check.replace("-", "_"))(lambda spark, d: rows_of(run(spark, d)))


def docs(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: A.manifests(spark, d, kind)


plugin, cc, mcp, market = docs("plugin"), docs("cc"), docs("mcp"), docs("marketplace")
E, W, N = "error", "warning", "note"

register("plugin-manifest-invalid", "plugin", [
    (1, E, "", "$schema"), (1, E, "", "version"), (1, E, "", "keywords"), (1, E, "", "author"), (3, E, "", "parse-error"), (4, E, "", "$schema"), (4, E, "", "name"), (4, E, "", "homepage"),
], lambda s, d: M.plugin_manifest_invalid(plugin(s, d)))
register("plugin-name-invalid", "plugin", [(1, E, "", "Bad..Name"), (2, E, "", "-x")], lambda s, d: M.plugin_name_invalid(plugin(s, d)))
register("plugin-manifest-unknown-field", "plugin", [(1, W, "", "extra"), (1, W, "", "extensions"), (4, W, "", "zeta")], lambda s, d: M.plugin_unknown_field(plugin(s, d)))
register("plugin-schema-unknown", "plugin", [(2, W, "", "https://example.com/other.json")], lambda s, d: M.plugin_schema_unknown(plugin(s, d)))
register("cc-manifest-invalid", "cc", [
    (1, E, "", "name-not-kebab"), (1, E, "", "pointer-type:commands"), (2, E, "", "missing-name"), (2, E, "", "pointer-type:hooks"), (3, E, "", "parse-error"), (4, E, "", "missing-name"),
], lambda s, d: M.cc_manifest_invalid(cc(s, d)))
register("cc-manifest-unknown-field", "cc", [(1, W, "", "mystery")], lambda s, d: M.cc_unknown_field(cc(s, d)))
register("cc-manifest-mismatch", "cc", [(0, W, "", "mismatch:version"), (1, W, "", "mismatch:name")], lambda s, d: M.cc_manifest_mismatch(plugin(s, d), cc(s, d)))
register("mcp-spec-invalid", "mcp", [
    (0, E, "far", "url-userinfo"), (0, E, "far", "url-fragment"), (1, E, "mcp.json", "missing-schema"), (1, E, "a", "command-rel-missing"), (1, E, "b", "command-multi-token"), (1, E, "c", "command-bare-slash"), (1, E, "d", "bad-transport"),
    (1, E, "e", "command-missing"), (2, E, "mcp.json", "servers-not-object"), (3, E, "g", "url-plain-http"), (3, E, "h", "url-scheme"), (3, E, "i", "url-missing"), (4, E, "l", "args-invalid"),
], lambda s, d: M.mcp_spec_invalid(mcp(s, d), A.listing(s, d)))
register("mcp-spec-placeholder", "mcp", [
    (3, W, "j", "header-placeholder:X"), (4, E, "k", "placeholder-command"), (4, E, "k", "env-reserved:PLUGIN_DATA"), (4, E, "k", "env-key-placeholder:A${PLUGIN_ROOT}"), (4, E, "k", "cwd-form"),
], lambda s, d: M.mcp_spec_placeholder(mcp(s, d)))
register("marketplace-invalid", "marketplace", [
    (1, E, "", "name-not-kebab"), (1, E, "", "missing-owner"), (1, E, "", "entry-name-not-kebab:C C"), (1, E, "", "entry-shape:1"), (1, E, "", "entry-missing-name:2"), (1, E, "", "entry-missing-source:d"), (1, E, "", "source-shape:e"),
    (2, E, "", "missing-name"), (2, E, "", "missing-plugins"), (3, E, "", "source-missing:f:package"), (3, W, "", "unknown-source-type:i"), (3, E, "", "source-missing:j:url"), (4, E, "", "parse-error"),
], lambda s, d: M.marketplace_invalid(market(s, d)))
register("marketplace-unpinned-source", "marketplace", [
    (1, N, "", "ref-only:C C"), (3, W, "", "npm-unpinned:f"), (3, W, "", "insecure-url:g"), (3, W, "", "archive-unpinned:g"), (3, W, "", "unpinned:j"),
], lambda s, d: M.marketplace_unpinned(market(s, d)))
register("marketplace-command-source", "marketplace", [(3, W, "", "command:h")], lambda s, d: M.marketplace_command(market(s, d)))
register("marketplace-entry-missing", "marketplace", [(1, E, "", "missing:entry 2:./gone")], lambda s, d: M.marketplace_entry_missing(market(s, d), A.listing(s, d)))

COMPONENT = [(1, E, "", "missing:agents:./gone.md")]


@query(expect("cc-component-missing", "cc", COMPONENT))
def check_cc_component_missing(spark: SparkSession, d: str) -> DataFrame:
    return rows_of(M.cc_component_missing(cc(spark, d), A.listing(spark, d)))


EACH = "SELECT '{}' AS check_id, '{}' AS severity, '/r/' || CAST(s_suppkey AS VARCHAR) AS root, '' AS name, reason FROM supplier CROSS JOIN {} e WHERE {}"


@query(EACH.format("plugin-skill-undiscoverable", W, A.sql_values([("skills/b",), ("skills/c/deep/SKILL.md",)], "reason"), "s_suppkey <> 3"))
def check_plugin_skill_undiscoverable(spark: SparkSession, d: str) -> DataFrame:
    return rows_of(M.plugin_skill_undiscoverable(plugin(spark, d), A.listing(spark, d)))


@query(EACH.format("plugin-path-escape", E, A.sql_values([("link", 0), ("inner", 1)], "reason, own"), "own = 0 OR s_suppkey <> 1"))
def check_plugin_path_escape(spark: SparkSession, d: str) -> DataFrame:
    return rows_of(M.plugin_path_escape(plugin(spark, d), A.listing(spark, d)))


@query(EACH.format("plugin-extension-hygiene", W, A.sql_values([("com.example.client:shadow",), ("Bad.Name",), ("com.example.client/settings.json:api_token",), ("Bad.Name/x.json:k",)], "reason"), "true"))
def check_plugin_extension_hygiene(spark: SparkSession, d: str) -> DataFrame:
    return rows_of(M.plugin_extension_hygiene(plugin(spark, d), A.listing(spark, d), A.files(spark, d)))
