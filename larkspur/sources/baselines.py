"""Kept approvals: commands that were approved, verdicts on pairs, findings that were seen; one JSON file for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import structures
from larkspur.operators.judging import VERDICT

BASELINE = "name string, path string, commands array<string>, date string"


def store_path(kind: str, project: str, home: str, global_only: bool = False, folder: str = ".larkspur") -> str:
    """Where a store of the project, or of the home folder, lies."""
    inside = {"verdicts": "cache", "commands": "cache/skill-shell", "snapshots": "cache/mcp", "approved": "cache/mcp/approved", "seen": "state", "pins": "pins", "ledger": "ledger"}
    return f"{(home if global_only else project).rstrip('/')}/{folder}/{inside[kind]}"


def keyed(spark: SparkSession, folder: str, ddl: str) -> DataFrame:
    """key (file stem) and the columns of a folder of JSON files; files that do not parse, or lack the first column, go."""
    read = spark.read.schema(f"{ddl}, _bad string").option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").option("pathGlobFilter", "*.json").json(folder)
    first = ddl.split()[0]
    return read.select(F.regexp_extract("_metadata.file_path", r"([^/]*)\.json$", 1).alias("key"), *[c.split()[0] for c in ddl.split(", ")], "_bad").where(f"_bad is null and {first} is not null").drop("_bad")


def baselines(spark: SparkSession, folder: str) -> DataFrame:
    """key, name, path, commands, date of approved command sets."""
    return keyed(spark, folder, BASELINE)


def verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts by the key of their pair, as judging has them."""
    return keyed(spark, folder, VERDICT.split(", ", 1)[1])


def seen(spark: SparkSession, path: str) -> DataFrame:
    """fingerprint, first_seen of one state file: an object of dates by fingerprint."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("fingerprint", "first_seen"))


def approved_commands(skills: DataFrame, kept: DataFrame, project: str, home: str) -> DataFrame:
    """id, command, date: what was approved of the skills (id: path, name) that are here, by a key that survives a move
    of the project or of the home folder."""
    key = structures.baseline_key(F.col("name"), structures.portable_path("id", project, home))
    return skills.select("id", key.alias("key")).join(kept.select("key", "commands", "date"), "key").select("id", F.explode("commands").alias("command"), "date")


def to_approve(findings: DataFrame, current: DataFrame) -> DataFrame:
    """Of current sets (fingerprint and what is to be kept), those that a finding showed as they still are."""
    return current.join(findings.select("fingerprint").distinct(), "fingerprint", "left_semi")
