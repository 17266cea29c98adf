import zlib

from pyspark.sql import functions as F

from strataline.llm import language_id as L

EN = "the cat sat on the mat and then the dog came to the house with them"
FR = "le chat est sur la table et puis les chiens sont venus dans la maison avec eux"


def test_identifies_and_holds_out(spark):
    rows = [(k, (EN if k % 2 else FR) + f" {k}", "en" if k % 2 else "fr") for k in range(40)]
    rows += [(100, "The dog and the cat are with us", None), (101, None, "en"), (102, "12 !!", "fr"), (103, "", None), (104, "les maisons sont dans le noir", "xx" * 0 or None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("score", F.lit(7))
    got = {r.doc_id: r for r in L.identify(df).collect()}
    assert len(got) == len(rows)
    assert all(got[k].lang_pred == ("en" if k % 2 else "fr") for k in range(40))
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k in got)
    assert [got[k].lang_pred for k in (100, 101, 102, 103, 104)] == ["en", "und", "und", "und", "fr"]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[101].score == 0
    kept = L.accepted(df)
    assert kept.columns == df.columns and kept.count() == len(rows) - 3


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "text", None), (None, "more", None)], "doc_id bigint, text string, lang string")
    assert {(r.lang_pred, r.score) for r in L.identify(df).collect()} == {("und", 0.0)}
    assert L.identify(df.limit(0)).count() == 0 == L.accepted(df.limit(0)).count()


def test_profiles_count_the_whole_corpus(spark):
    from collections import Counter

    rows = [("en", EN), ("en", "Ünder the sea"), ("fr", FR)]
    got = {(r.lang, r.key): r["rank"] for r in L.profiles(spark.createDataFrame(rows, "lang string, text string"), top=50).collect()}
    for lang in ("en", "fr"):
        counts = Counter(k for n, t in rows if n == lang for k in L.ngrams(t).tolist())
        order = sorted(counts, key=lambda k: (-counts[k], k))[:50]
        assert [k if k < 2**63 else k - 2**64 for k in order] == [k for _, k in sorted((r, k) for (n, k), r in got.items() if n == lang)]


def test_null_ids_ties_repeats_and_long_texts(spark):
    base = [(k, EN if k % 2 else FR, "en" if k % 2 else "fr") for k in range(30)]
    rows = base + [(None, "zzz qqq xxx " * 50, "zz"), (200, EN, None), (200, EN, None), (201, (EN + " ") * 20000, None), (202, (FR + " ") * 20000 + EN, None)]
    got = L.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()
    assert len(got) == len(rows) and "zz" not in {r.lang_pred for r in got}  # nothing is learned from a row without doc_id
    assert [r.lang_pred for r in got if r.doc_id in (200, 201, 202)] == ["en", "en", "en", "fr"]
    assert next(r for r in got if r.doc_id is None).held_out is False
    same = [(k, EN, lang) for k in range(30) for lang in ("b", "a")]
    tied = L.identify(spark.createDataFrame(same, "doc_id bigint, text string, lang string"))
    assert {r.lang_pred for r in tied.collect()} == {"a"}  # the first in code-point order


def test_distances_by_hand(spark):
    from collections import Counter

    rows = [(k, t, n) for k, (t, n) in enumerate([(EN, "en"), (FR, "fr"), ("die katze und der hund sind in dem haus", "de")] * 6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    seen = [(t, n) for k, t, n in rows if zlib.crc32(str(k).encode()) % 3 != 1]
    top = 40

    def ranked(texts):
        counts = Counter(x for t in texts for x in L.ngrams(t).tolist())
        return {x: i for i, x in enumerate(sorted(counts, key=lambda x: (-counts[x], x))[:top])}

    profiles = {n: ranked([t for t, m in seen if m == n]) for _, n in seen}
    for r in L.identify(docs, top=top).collect():
        mine = ranked([rows[r.doc_id][1]])
        apart = {n: sum(abs(i - p[x]) if x in p else top for x, i in mine.items()) for n, p in profiles.items()}
        best = min(apart, key=lambda n: (apart[n], n))
        assert r.lang_pred == best and abs(r.score - (1 - apart[best] / (top * len(mine)))) < 1e-9
