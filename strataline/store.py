"""Where intermediate tables go, and how they are written, read back and dropped."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps
from typing import ParamSpec

from pyspark.sql import DataFrame, SparkSession

P = ParamSpec("P")

#: Tables that the innermost ``tidy`` function has written so far.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)
#: Shuffle files go at the end of an execution, not when the driver next collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster the setting must be there, because every executor has to see
    the folder. A local session that lacks it (tests) gets a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="strataline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, stem: str) -> str:
    """A folder that nothing has written yet. It goes with the others at the end of the innermost ``tidy`` function."""
    path = f"{scratch_dir(spark)}/{stem}-{uuid.uuid4().hex}"
    if (written := _written.get()) is not None:
        written.append(path)
    return path


@contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def _write(df: DataFrame, path: str) -> DataFrame:
    with _shuffles_go(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, stem: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a reread, not a recomputation.
    """
    return _write(df, new_path(df.sparkSession, stem))


def tidy(stem: str) -> Callable[[Callable[P, DataFrame]], Callable[P, DataFrame]]:
    """A function whose result is written, and all other tables it wrote on the way are dropped.

    Its result goes in turn at the end of the ``tidy`` function that called it, if there is one.
    """

    def around(f: Callable[P, DataFrame]) -> Callable[P, DataFrame]:
        @wraps(f)
        def run(*args: P.args, **named: P.kwargs) -> DataFrame:
            written: list[str] = []
            token = _written.set(written)
            spark = None
            try:
                lazy = f(*args, **named)
                spark = lazy.sparkSession
                _written.reset(token)
                token = None
                return materialize(lazy, stem)
            finally:
                if token is not None:
                    _written.reset(token)
                if written:
                    for path in written:
                        delete(spark or SparkSession.getActiveSession(), path)

        return run

    return around


def drop(df: DataFrame) -> None:
    """Removes the folder that a table returned by ``materialize`` or a ``tidy`` function is read from; no other."""
    spark = df.sparkSession
    home = scratch_dir(spark).removeprefix("file:").lstrip("/")
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.removeprefix("file:").lstrip("/").startswith(home):
            delete(spark, folder)


class Rounds:
    """The tables of an iteration, of which only the last stays.

    A round's table may be dropped once the next one is written, because nothing reads it
    again: the next is in the shared folder itself.
    """

    def __init__(self, spark: SparkSession, stem: str):
        self.spark, self.stem, self.last = spark, stem, None

    def keep(self, df: DataFrame) -> DataFrame:
        path = new_path(self.spark, self.stem)
        out = _write(df, path)
        if self.last is not None:
            delete(self.spark, self.last)
        self.last = path
        return out


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder of any store that Spark writes to."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
