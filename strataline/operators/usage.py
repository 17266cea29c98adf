"""Usage of integration candidates, rolled up the containment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = ("method", "type", "namespace", "project")


def rolled_up(use: DataFrame, up: list[DataFrame]) -> DataFrame:
    """``use`` (node_id, candidate_id) and per level (child, parent) -> level, node_id, candidates (sorted).

    Distinct pairs go up level by level, so each join and shuffle carries a level's pairs once.
    """
    pairs = use.select("node_id", "candidate_id").distinct()
    out = pairs.withColumn("level", F.lit(LEVELS[0]))
    for level, parents in zip(LEVELS[1:], up):
        pairs = pairs.join(parents.select(F.col("child").alias("node_id"), "parent"), "node_id").select(F.col("parent").alias("node_id"), "candidate_id").distinct()
        out = out.unionByName(pairs.withColumn("level", F.lit(level)))
    return out.groupBy("level", "node_id").agg(F.array_sort(F.collect_set("candidate_id")).alias("candidates"))


def first_parents(contains: DataFrame) -> DataFrame:
    """(child, parent): of several parents the one whose edge stands first (``position``)."""
    return contains.groupBy(F.col("child_id").alias("child")).agg(F.min_by("parent_id", F.struct("position", "parent_id")).alias("parent"))
