"""The queries over whole small tables, against brute force; op3 also against its SQL."""

import glob
import hashlib
import html as charrefs
import os
import re
import zlib

import duckdb
import numpy as np
import pytest

from strataline.llm import queries, secrets

from .test_embeddings import brute as near_vectors
from .test_minhash import brute as near_texts
from .test_secrets import base

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def rows(spark, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{DATA}/{name}.parquet").select(*columns).collect()]


def result(spark, name):
    return queries.QUERIES[name](spark, DATA).collect()


def held(k):
    return zlib.crc32(str(k).encode()) % 3 == 1


def test_op1_keeps_the_article(spark):
    pages = dict(rows(spark, "pages", "page_id", "html"))
    for r in result(spark, "op1_html_extract"):
        inner = re.search(r"<article>(.*)</article>", pages[r.page_id], re.DOTALL)[1]
        parts = [re.sub(r"\s+", " ", charrefs.unescape(re.sub(r"<br>|</?b>", " ", p))).strip() for p in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_op2_against_all_pairs(spark):
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in result(spark, "op2_minhash_dedup")}
    assert got == near_texts(rows(spark, "documents", "doc_id", "text"), 3, 85)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    db = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        db.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    other = db.execute(queries.ORACLE_SQL[name])
    at = [[d[0] for d in other.description].index(c) for c in columns]
    assert sorted(map(str, map(tuple, df.select(*columns).collect()))) == sorted(str(tuple(r[k] for k in at)) for r in other.fetchall())


def test_op4_and_op10_on_held_out_rows(spark):
    docs = {d: (t, lang) for d, t, lang in rows(spark, "documents", "doc_id", "text", "lang")}
    said = result(spark, "op10_language_id")
    assert {r.doc_id: r.held_out for r in said} == {d: held(d) for d in docs}
    right = [r.lang_pred == docs[r.doc_id][1] for r in said if r.held_out and docs[r.doc_id][1]]
    assert np.mean(right) > 0.95
    quality = dict(rows(spark, "labels", "doc_id", "quality"))
    scored = result(spark, "op4_quality")
    assert {r.doc_id for r in scored} == set(docs)
    right = [r.predicted == quality[r.doc_id] for r in scored if r.held_out and r.doc_id in quality]
    assert np.mean(right) > 0.85
    by_label = [[r.predicted == q for r in scored if r.held_out and quality.get(r.doc_id) == q] for q in (0, 1)]
    assert np.mean([np.mean(x) for x in by_label if x]) > 0.85  # a constant has 0.5 where both labels are there


def test_op5_base_spans(spark):
    texts = dict(rows(spark, "documents", "doc_id", "text"))
    for r in result(spark, "op5_secrets"):
        want = base(texts[r.doc_id] or "")
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == n for k, _, _ in want) for n in secrets.KINDS[:3]]
        assert ",".join(s for s in r.spans.split(",") if not s.startswith("lexed")) == said


def test_op6_finds_long_repeats(spark):
    texts = dict(rows(spark, "documents", "doc_id", "text"))
    where: dict[str, set[int]] = {}
    for d, t in texts.items():
        w = (t or "").split(" ")
        for k in range(len(w) - 59):
            where.setdefault(" ".join(w[k : k + 60]), set()).add(d)
    must = set().union(*(v for v in where.values() if len(v) > 1))
    got = result(spark, "op6_substring_dedup")
    assert must <= {r.doc_id for r in got}
    every = {d: (t or "").encode() for d, t in texts.items()}
    for r in got:  # each reported piece of 40 bytes stands in another document
        piece = every[r.doc_id][r.byte_start : r.byte_end]
        assert any(piece[k : k + 40] in t for k in (0, len(piece) // 2 - 20) for d, t in every.items() if d != r.doc_id)


def test_op7_against_all_pairs(spark):
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in result(spark, "op7_embedding_dedup")}
    assert got == near_vectors(rows(spark, "embeddings", "vec_id", "label", "embedding"))


def test_op8_round_trip(spark):
    texts = dict(rows(spark, "documents", "doc_id", "text"))
    for r in result(spark, "op8_sentencepiece"):
        assert r.lossless and r.text_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() and r.n_tokens > 0


def test_op9_finds_passages(spark):
    def words(t):
        return re.findall(r"[^\W_]+", (t or "").lower())

    items: dict[tuple, set[int]] = {}
    for i, t in rows(spark, "benchmark", "item_id", "text"):
        w = words(t)
        for k in range(len(w) - 14):
            items.setdefault(tuple(w[k : k + 15]), set()).add(i)
    must = {(d, i) for d, t in rows(spark, "documents", "doc_id", "text") for w in [words(t)] for k in range(len(w) - 14) for i in items.get(tuple(w[k : k + 15]), ())}
    got = {(r.doc_id, r.item_id) for r in result(spark, "op9_decontaminate")}
    assert must <= got and len(got) <= len(must) + 2
