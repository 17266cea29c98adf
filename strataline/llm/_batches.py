"""How many rows go to a Python worker at a time."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from threading import RLock

from pyspark.sql import SparkSession

#: The setting is the session's, so one plan at a time is built with it.
_ONE = RLock()
_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """Plans that run inside send at most ``rows`` rows a batch, so long texts take less memory on both sides."""
    with _ONE:
        before = spark.conf.get(_KEY)
        spark.conf.set(_KEY, str(min(rows, int(before)) if int(before) > 0 else rows))
        try:
            yield
        finally:
            spark.conf.set(_KEY, before)
