import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataline.llm import _hashing as H
from strataline.llm import substring_dedup as S


def text(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(n))


def test_gear_looks_back_sixteen_bytes():
    data = np.frombuffer(text(random.Random(1), 60).encode(), np.uint8)
    slow = []
    for k in range(len(data)):
        h = 0
        for b in data[max(0, k - 15) : k + 1]:
            h = (h << 1) + int(S._GEAR[b]) & 0xFFFF
        slow.append(h)
    assert S.gear(data).tolist() == slow


def test_chunks_cover_every_row_and_survive_insertions(monkeypatch):
    monkeypatch.setattr(H, "PIECE", 300)
    r = random.Random(2)
    body = text(r, 400)
    texts = [body, "", text(r, 3) + " " + body, "x"]
    data, offsets = H.buffers(pa.array(texts))
    parts = {k: [] for k in range(4)}
    n_words = {k: 0 for k in range(4)}
    for row, start, end, words, digest in S.chunks(data, offsets):
        for k, a, b, w, d in zip(row, start, end, words, digest):
            parts[int(k)].append((int(a), int(b), int(d)))
            n_words[int(k)] += int(w)
    assert n_words == {k: len(t.split()) for k, t in enumerate(texts)}
    for k, t in enumerate(texts):
        edges = [a for a, _, _ in parts[k]] + [len(t.encode())]
        assert edges[0] == 0 and [b for _, b, _ in parts[k]] == edges[1:] if t else parts[k] == []
    first, third = {d for *_, d in parts[0]}, {d for *_, d in parts[2]}
    assert len(first - third) <= 2


def test_finds_passages_and_leaves_clean_rows(spark):
    r = random.Random(3)
    passage, line = text(r, 60), text(r, 8)
    rows = [(k, f"{text(r, 50)} {passage} {text(r, 50)}" if k < 20 else f"{text(r, 120)}\n{line}") for k in range(60)]
    rows += [(200, None), (201, ""), (None, passage), (300, passage + " " + passage), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("digest", F.lit(1))
    got = S.repeated_passages(df).collect()
    assert {g.doc_id for g in got} == {*range(20), 300}
    for g in got:
        raw = dict((a, b) for a, b in rows if a is not None)[g.doc_id].encode()[g.byte_start : g.byte_end]
        assert raw in passage.encode() * 1 or raw in (passage + " " + passage).encode() or len(raw) < len(passage.encode()) + 40
        assert g.first_doc_id == 0 and g.duplicate == (g.doc_id != 0)
    assert S.repeated_passages(df.limit(0)).count() == 0


def test_repeats_inside_one_document_do_not_count(spark):
    t = text(random.Random(4), 80)
    assert S.repeated_passages(spark.createDataFrame([(1, t + " " + t), (2, "other")], "doc_id bigint, text string")).count() == 0


def test_short_runs_are_decided_byte_by_byte(spark):
    r = random.Random(9)
    half, whole = text(r, 42), text(r, 51)
    rows = [(k, f"{text(r, 40)} {half if k < 10 else whole} {text(r, 40)}") for k in range(40)]
    got = S.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {g.doc_id for g in got} == set(range(10, 40))
    texts = dict(rows)
    for g in got:
        assert g.n_words < 50 or whole[5:-5] in texts[g.doc_id].encode()[g.byte_start : g.byte_end].decode() or g.n_words >= 50


def test_common_text():
    a, b = b"xx the quick brown fox jumps over it yy", b"zz the quick brown fox jumps over it ww"
    s, e = S.common(a, b, 10, 30)
    assert a[s:e] == b" the quick brown fox jumps over it "
    assert S.common(a, b"none of that", 10, 30) == (10, 10)


def brute(rows, n=50):
    """Documents that hold a stretch of n whole words, byte for byte, that another one holds."""
    held = {}
    for k, t in rows:
        at = [m.span() for m in re.finditer(r"\S+", t)]
        for a, b in zip(at, at[n - 1 :]):
            held.setdefault(t[a[0] : b[1]], set()).add(k)
    return {k for ids in held.values() if len(ids) > 1 for k in ids}


def test_copies_between_decoys_are_found(spark):
    # the chunks' first documents hold parts only: words 1-32 and words 23-54 of the passage
    r = random.Random(21)
    rows = []
    for g in range(25):
        w = text(r, 54).split()
        rows += [(g * 20 + 1, f"{text(r, 9)} {' '.join(w[:32])} {text(r, 9)}"), (g * 20 + 2, f"{text(r, 9)} {' '.join(w[22:])} {text(r, 9)}")]
        rows += [(g * 20 + k, f"{text(r, 20)} {' '.join(w)} {text(r, 20)}") for k in range(5, 10)]
        rows += [(g * 20 + 18, f"{text(r, 9)} {' '.join(w[:32])} {text(r, 9)}"), (g * 20 + 19, f"{text(r, 9)} {' '.join(w[22:])} {text(r, 9)}")]
    got = S.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {g.doc_id for g in got} == brute(rows) == {g * 20 + k for g in range(25) for k in range(5, 10)}


def test_short_words_are_found(spark):
    r = random.Random(22)
    rows = []
    for g in range(150):
        w = " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(1, 1 + g % 3))) for _ in range(50))
        rows += [(g * 2 + k, f"{text(r, 20)} {w} {text(r, 20)}") for k in range(2)]
    got = S.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {g.doc_id for g in got} == brute(rows) == set(range(300)) and all(g.n_words >= 50 for g in got)


def test_neighbouring_short_repeats_are_no_passage(spark):
    r = random.Random(23)
    one, two = text(r, 45), text(r, 45)
    rows = [(1, f"{text(r, 20)} {one} {two} {text(r, 20)}"), (2, f"{text(r, 20)} {one} {text(r, 20)}"), (3, f"{text(r, 20)} {two} {text(r, 20)}")]
    assert S.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).count() == len(brute(rows)) == 0
    solid = "".join(r.choice("abcdefghij") for _ in range(900))
    rows = [(1, f"{text(r, 5)} x{solid}"), (2, f"{solid}y {text(r, 5)}")]
    got = S.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {g.doc_id for g in got} == {1, 2} and all(50 <= g.n_words <= 56 for g in got)


def passages(rows, n=50):
    """(doc_id, byte_start, byte_end, n_words, first_doc_id) by comparing all windows of n whole words."""
    held, mine = {}, {}
    for k, t in rows:
        at = [(len(t[: m.start()].encode()), len(t[: m.end()].encode()), m.start(), m.end()) for m in re.finditer(r"[^ \t-\r]+", t)]
        mine[k] = [(a[0], b[1], i, t[a[2] : b[3]]) for i, (a, b) in enumerate(zip(at, at[n - 1 :]))]
        for *_, words in mine[k]:
            held.setdefault(words, set()).add(k)
    out = set()
    for k, found in mine.items():
        run = []
        for start, end, i, words in [x for x in found if len(held[x[3]]) > 1] + [(1 << 60, 0, 0, "")]:
            if run and start > run[-1][1]:
                first = [min(held[w]) for *_, w in run]
                out.add((k, run[0][0], run[-1][1], run[-1][2] - run[0][2] + n, min(first, key=lambda d: (-first.count(d), d))))
                run = []
            run.append((start, end, i, words))
    return out


@pytest.mark.parametrize("hot", [1 / 5000, 1e-9])
def test_passages_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT_SHARE", hot)  # with and without salted digests
    r = random.Random(31)
    stock = [text(r, r.randint(30, 90)) for _ in range(12)]
    line = text(r, 9)
    rows = [(k, " ".join(x for _ in range(3) for x in (text(r, r.randint(0, 30)), r.choice(stock), r.choice([line, "é ü"]))).strip()) for k in range(60)]
    got = S.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {(g.doc_id, g.byte_start, g.byte_end, g.n_words, g.first_doc_id) for g in got} == passages(rows)
    assert all(g.duplicate == (g.doc_id != g.first_doc_id) for g in got)


def test_a_stock_of_phrases_is_no_passage(spark):
    r = random.Random(32)
    stock = [text(r, 9) for _ in range(300)]
    rows = [(k, " ".join(r.choice(stock) for _ in range(30))) for k in range(300)]
    assert not passages(rows) and S.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).count() == 0


def test_query_against_brute_force(spark):
    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = {(g.doc_id, g.byte_start, g.byte_end, g.n_words, g.first_doc_id) for g in S.repeated_passages(docs).collect()}
    assert got == passages([(d.doc_id, d.text) for d in docs.collect()]) and got
