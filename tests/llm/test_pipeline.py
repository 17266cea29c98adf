"""The pipeline's stages against brute-force versions, each on its own input."""

import os
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from strataline.llm import pieces, secrets

from .test_minhash import brute

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = [(9001, "12 34 !!", "en", "s", 8), (9002, None, None, "s", None), (9003, "", "en", "s", 0)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema)).withColumn("component_id", F.lit("clash"))
    out = [docs.cache()]
    for _, stage in C.STAGES:
        out.append(stage(spark, out[-1], DATA).cache())
    yield out
    for df in out:
        df.unpersist()


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_names_and_columns(stages):
    assert [n for n, _ in C.STAGES] == ["language", "near_duplicates", "benchmark", "secrets", "pieces"]
    assert all(df.columns == stages[0].columns for df in stages[:-1])


def test_language_rejects_what_has_no_letter(stages):
    texts = {r.doc_id: r.text for r in stages[0].collect()}
    assert ids(stages[1]) == {d for d, t in texts.items() if any(c.isalpha() for c in t or "")}


def test_one_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    assert ids(stages[2]) == {d for d, _, _, kept in brute(rows, 5, 80) if kept}


def test_benchmark_documents_go(spark, stages):
    def words(t):
        return re.findall(r"[^\W_]+", t.lower())

    items = {tuple(w[k : k + 15]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect() for w in [words(r.text)] for k in range(len(w) - 14)}
    must = {r.doc_id for r in stages[2].collect() for w in [words(r.text)] if any(tuple(w[k : k + 15]) in items for k in range(len(w) - 14))}
    gone = ids(stages[2]) - ids(stages[3])
    assert must <= gone and len(gone) <= len(must) + 2


def test_secrets_are_masked(stages):
    before = {r.doc_id: r.text for r in stages[3].collect()}
    for r in stages[4].collect():
        assert r.text == secrets.masked(before[r.doc_id]) and (r.text == before[r.doc_id] or r.n_chars == len(r.text))
        assert not re.search(r"[0-9a-f]{24}", r.text)


def test_tokens_give_the_text_back(spark, stages):
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    assert all(r.lossless for r in stages[5].collect())
    assert {r.doc_id: r.text for r in pieces.detokenize(stages[5]).collect()} == texts


def test_run(spark, stages):
    got = C.run(spark, DATA)
    assert ids(got) == ids(stages[5])


def test_stages_on_empty_repeated_and_very_long_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("component_id", F.lit("clash")).withColumn("spans", F.lit(1))
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet").first().text
    kind = docs.schema
    long = "the words of a very long text stand here with others that follow " * 30000
    rows = [(1, "the cat sat on the mat with them", "en", "s", 9), (1, "the cat sat on the mat with them", "en", "s", 9), (2, long, "en", "s", None), (3, long + 'password = "q8Zx91kd82"', "en", "s", 1),
            (None, "les chiens sont dans la maison", None, None, None), (5, None, "en", "s", None), (6, "", "en", "s", 0), (7, f"So: {bench}", "en", "s", 3)]
    mine = spark.createDataFrame([(*r, "clash", 1) for r in rows], kind)
    for _, stage in C.STAGES[:4]:
        assert stage(spark, docs.limit(0), DATA).count() == 0
        assert stage(spark, mine, DATA).columns == docs.columns
    assert C.STAGES[4][1](spark, docs.limit(0), DATA).count() == 0
    # trained on the table, judged on rows of all kinds
    said = C.language(spark, docs.unionByName(mine.withColumn("lang", F.lit(None).cast("string"))), DATA)
    assert said.where("doc_id in (5, 6) and component_id = 'clash' and text = ''").count() == 0
    assert sorted(str(r.doc_id) for r in C.near_duplicates(spark, mine, DATA).collect()) == ["1", "2", "5", "6", "7", "None"]
    assert sorted(str(r.doc_id) for r in C.benchmark(spark, mine, DATA).collect()) == ["1", "1", "2", "3", "5", "6", "None"]
    masked = {r.doc_id: r for r in C.secret_masking(spark, mine, DATA).collect()}
    assert masked[3].text == long + 'password = "[secret]"' or "q8Zx91kd82" not in masked[3].text
    assert masked[3].n_chars == len(masked[3].text) and masked[2].text == long and masked[5].text is None
    out = C.tokens(spark, mine, DATA).collect()
    assert len(out) == len(rows) and all(r.lossless for r in out if r.doc_id not in (5,))
