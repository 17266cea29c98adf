"""Exported analysis snapshots read back as graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.graph import Graph
from ..schema import EDGE_KINDS, NODE_KINDS

_NODE = "struct<Id:string,Kind:string,Name:string,Attributes:map<string,string>,Evidence:string>"
_EDGE = "struct<FromId:string,ToId:string,Kind:string,Label:string,Attributes:map<string,string>,Evidence:string,Confidence:double>"
SNAPSHOT = f"Graph struct<Nodes:map<string,{_NODE}>,Edges:array<{_EDGE}>>"


def _kind(column: F.Column, names: tuple[str, ...]) -> F.Column:
    """Kinds stand as names or as numbers."""
    number = column.try_cast("int")
    return F.when(number.isNull(), column).otherwise(F.get(F.array(*map(F.lit, names)), number))


def read(spark: SparkSession, path: str) -> Graph:
    """The graph of one or many snapshot files; ``snapshot_id`` is the file."""
    rows = spark.read.schema(SNAPSHOT).option("multiLine", True).json(path).withColumn("snapshot_id", F.input_file_name())
    return graph(rows)


def graph(rows: DataFrame) -> Graph:
    n = rows.select("snapshot_id", F.explode("Graph.Nodes").alias("key", "n"))
    nodes = n.select("snapshot_id", F.coalesce("n.Id", "key").alias("id"), _kind(F.col("n.Kind"), NODE_KINDS).alias("kind"), F.col("n.Name").alias("name"),
                     F.coalesce("n.Attributes", F.create_map().cast("map<string,string>")).alias("attributes"), F.col("n.Evidence").alias("evidence"))
    e = rows.select("snapshot_id", F.posexplode("Graph.Edges").alias("position", "e"))
    edges = e.select("snapshot_id", "position", F.col("e.FromId").alias("from_id"), F.col("e.ToId").alias("to_id"), _kind(F.col("e.Kind"), EDGE_KINDS).alias("kind"), F.col("e.Label").alias("label"),
                     F.coalesce("e.Attributes", F.create_map().cast("map<string,string>")).alias("attributes"), F.col("e.Evidence").alias("evidence"), F.coalesce("e.Confidence", F.lit(1.0)).alias("confidence"))
    return Graph(nodes, edges)
