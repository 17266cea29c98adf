import gzip
import hashlib

from pyarrow import fs
from pyspark.sql import functions as F

from strataline.llm import warc as W
from strataline.store import new_path

BIG = "<p>é" + "x" * 1200


def frame(spark):
    rows = [(1, "http://a/1", BIG), (2, "http://a/2", BIG), (5, None, BIG), (3, "u\r\nv", "small"), (4, "w", "small"), (6, "x", None), (7, "y", ""), (None, "z", BIG), (8, "q", "y" * 999), (9, "q", "y" * 999), (10, "r", "z" * 1000), (10, "r", "z" * 1000)]
    return rows, spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit("clash"))


def test_round_trip(spark):
    rows, df = frame(spark)
    folder = new_path(spark, "warc")
    index = W.write(df, folder)
    assert index.count() == len(rows)
    got = W.read(index, folder).collect()
    assert sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in got) == sorted([
        ("1", "revisit", "5"), ("2", "revisit", "5"), ("5", "response", "None"), ("None", "revisit", "5"), *((str(k), "response", "None") for k in (3, 4, 6, 7, 8, 9, 10, 10))])
    for r in got:
        html = (next(h for i, _, h in rows if i == r.page_id) or "").encode()
        assert r.payload_bytes == len(html) and r.payload_digest == hashlib.sha1(html).hexdigest()
        assert (r.payload is None) == (r.record_type == "revisit") and (r.payload is None or bytes(r.payload) == html)


def test_index_selects_records(spark):
    _, df = frame(spark)
    folder = new_path(spark, "warc")
    index = W.write(df, folder)
    some = W.read(index.where("url = 'http://a/1' or page_id = 3"), folder).collect()
    assert sorted(r.page_id for r in some) == [1, 3] and next(r for r in some if r.page_id == 3).url == "u%0D%0Av"


def test_files_are_plain_warc(spark):
    _, df = frame(spark)
    folder = new_path(spark, "warc")
    index = W.write(df.coalesce(1), folder)
    where, base = W.store(folder)
    for info in where.get_file_info(fs.FileSelector(base)):
        data = gzip.decompress(where.open_input_file(info.path).read())
        while data:
            assert data.startswith(b"WARC/1.1\r\n")
            head, _, rest = data.partition(b"\r\n\r\n")
            size = int(dict(W._fields(head))["content-length"])
            assert rest[size : size + 4] == b"\r\n\r\n"
            data = rest[size + 4 :]
    assert index.select("file").distinct().count() >= 1


def test_ranges_are_joined():
    rows = [(0, 10), (10, 5), (40, 10), (200, 1)]
    assert [(a, n, len(r)) for a, n, r in W.ranges(rows, gap=30, span=100)] == [(0, 50, 3), (200, 1, 1)]
    assert [(a, n) for a, n, _ in W.ranges([(0, 60), (60, 60)], gap=30, span=100)] == [(0, 60), (60, 60)]
    assert list(W.ranges([])) == []


def test_empty_table(spark):
    _, df = frame(spark)
    assert W.archive_and_read(spark, df.limit(0)).count() == 0
