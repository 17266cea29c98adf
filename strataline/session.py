"""What a session needs before Python workers run this package's code."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Lets workers import the package from where the driver has it.

    On a cluster whose machines do not share that folder, ship the package with
    ``--py-files`` or install it; the entry is then without effect.
    """
    home = str(Path(__file__).resolve().parent.parent)
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(":") if p]
    if home not in paths:
        environment["PYTHONPATH"] = ":".join([*paths, home])
    return spark
