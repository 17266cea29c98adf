"""What the operators share: id filters and batch sizes."""

import threading

from pyspark.sql import functions as F

from strataline.llm import _batches, _filter


def test_only_by_broadcast_and_by_shuffle(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "doc_id bigint, text string")
    ids = spark.createDataFrame([(1,), (1,), (3,), (None,)], "doc_id bigint")
    for most in (_filter.BROADCAST_IDS, 0):
        monkeypatch.setattr(_filter, "BROADCAST_IDS", most)
        assert sorted(r.text for r in _filter.only(rows, ids).collect()) == ["a", "b"]
        assert sorted(r.text for r in _filter.only(rows, ids, how="left_anti").collect()) == ["c", "d"]
        assert _filter.only(rows, ids.limit(0)).count() == 0 and _filter.only(rows.limit(0), ids).count() == 0


def test_batches_are_small_inside_only(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)

    def sizes(batches):
        for batch in batches:
            yield batch.select(["id"]).slice(0, 1)

    with _batches.small_batches(spark, 10):
        assert spark.range(0, 100, 1, 1).mapInArrow(sizes, "id bigint").count() == 10
    assert spark.conf.get(key) == before


def test_batches_of_threads_do_not_meet(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen = spark.conf.get(key), []

    def build(n):
        for _ in range(20):
            with _batches.small_batches(spark, n):
                seen.append((n, spark.conf.get(key)))

    threads = [threading.Thread(target=build, args=(n,)) for n in (7, 70)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert spark.conf.get(key) == before and all(str(n) == said for n, said in seen)
