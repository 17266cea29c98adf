import glob

import pytest
from pyspark.sql import functions as F

from strataline import store


def folders(spark):
    return set(glob.glob(store.scratch_dir(spark).removeprefix("file://") + "/*"))


@store.tidy("inner")
def inner(df):
    return store.materialize(df.withColumn("x", F.col("id") * 2), "middle")


@store.tidy("outer")
def outer(df, fail=False):
    a, b = inner(df), store.materialize(df, "side")
    rounds = store.Rounds(df.sparkSession, "round")
    for _ in range(3):
        b = rounds.keep(b.select((F.col("id") + 1).alias("id")))
    if fail:
        raise ValueError("no")
    return a.join(b, "id")


def test_only_the_result_stays(spark):
    before = folders(spark)
    got = outer(spark.range(10))
    assert sorted(r.x for r in got.collect()) == [2 * k for k in range(3, 10)]
    left = folders(spark) - before
    assert len(left) == 1 and "/outer-" in left.pop()
    store.drop(got)
    assert folders(spark) == before


def test_nothing_stays_of_a_failure(spark):
    before = folders(spark)
    with pytest.raises(ValueError):
        outer(spark.range(10), fail=True)
    assert folders(spark) == before


def test_drop_leaves_other_folders(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    store.drop(df)
    assert df.count() == 3


def test_shuffle_files_go_with_the_write(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    assert store.materialize(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count(), "t").count() == 7
    assert spark.conf.get(key, "false") == (before or "false")
