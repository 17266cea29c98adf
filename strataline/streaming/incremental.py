"""Metrics kept up to date as exported graphs arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import metrics
from ..plans.graph import batched, snapshot_of, without_snapshot
from ..sources.graph_json import SNAPSHOT, graph


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Writes the type metrics of every snapshot file that arrives in ``folder`` to ``out``, by snapshot (the file's name).

    A batch computes the metrics of its own files in one plan; a file that comes again
    replaces its rows, because only the partitions that a batch holds are overwritten.
    """
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)
    files = spark.readStream.schema(SNAPSHOT).option("multiLine", True).json(folder).withColumn("snapshot_id", name)

    def batch(rows: DataFrame, number: int) -> None:
        held = rows.persist()
        found = metrics.type_metrics(batched(graph(held)).model())
        found = found.withColumn("snapshot", snapshot_of("type_id")).withColumn("type_id", without_snapshot("type_id"))
        found.write.partitionBy("snapshot").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(out)
        held.unpersist()

    writer = files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
