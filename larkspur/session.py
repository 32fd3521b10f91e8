"""What a session needs before its Python workers can run functions of this package."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Lets workers import the package from where the driver has it (a no-op where it is installed)."""
    root = str(Path(__file__).resolve().parents[1])
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "")
    if root not in paths.split(":"):
        environment["PYTHONPATH"] = f"{root}:{paths}".rstrip(":")
    return spark
