import random
import re

import pytest
from pyspark.sql import functions as F

from strataline.llm import minhash_dedup as M


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset([tuple(w)] if 0 < len(w) < width else zip(*(w[k:] for k in range(width))))


def brute(rows, width, percent):
    sets = [(d, shingles(t, width)) for d, t in rows]
    parent = {d: d for d, _ in rows}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {(d, len(s), find(d), find(d) == d) for d, s in sets}


def corpus(seed):
    r = random.Random(seed)
    rows, words = [], [f"w{k}" for k in range(400)]
    for base in range(12):
        text = [r.choice(words) for _ in range(r.choice((2, 5, 40, 120)))]
        for _ in range(r.choice((1, 2, 9))):
            copy = [r.choice(words) if r.random() < r.choice((0, 0.01, 0.03)) else w for w in text]
            rows.append((len(rows), " ".join(copy)))
    return rows + [(900, None), (901, ""), (902, " \n"), (903, "One"), (904, "ONE "), (905, "É x"), (906, "é x")]


@pytest.mark.parametrize(("seed", "width", "percent"), [(1, 3, 85), (2, 5, 80)])
def test_against_all_pairs(spark, seed, width, percent):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("component_id", F.lit("clash")).withColumn("rep", F.lit(1))
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in M.near_duplicates(df, width, percent).collect()}
    assert got == brute(rows, width, percent)


def test_repeated_and_null_ids(spark):
    text = " ".join(f"w{k}" for k in range(30))
    df = spark.createDataFrame([(5, text), (5, text), (None, text), (7, text), (None, "alone here now")], "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in M.near_duplicates(df, 3, 85).collect()), key=str)
    assert got == [(5, 5, True), (5, 5, True), (7, 5, False), (None, 5, False), (None, None, False)]
    kept = M.deduplicated(df.withColumn("lang", F.lit("en")), 3, 85)
    assert kept.columns == ["doc_id", "text", "lang"] and sorted(str(r.doc_id) for r in kept.collect()) == ["5", "None", "None"]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert M.near_duplicates(df).count() == 0 == M.deduplicated(df).count()


def test_estimates_are_close(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    for share in (0.5, 0.85):
        off = []
        for _ in range(60):
            common = rng.integers(0, 2**63, 800).astype(np.uint64)
            n = int(400 * (1 - share) / (1 + share) * 2)
            a, b = (np.unique(np.concatenate((common[:400], rng.integers(0, 2**63, n // 2 * 1).astype(np.uint64)))) for _ in range(2))
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            m = M.packed(M.minima([a, b]))
            x = m[0] ^ m[1]
            x |= x >> np.uint64(1)
            x |= x >> np.uint64(2)
            match = 1 - np.bitwise_count(x & np.uint64(0x1111111111111111)).sum() / M.K
            off.append((match - 1 / 16) / (1 - 1 / 16) - true)
        assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.06


def test_banding_misses_little():
    for threshold in (0.8, 0.85, 0.95):
        r, n = M.banding(threshold)
        assert r * n <= M.K and (1 - threshold**r) ** n < 1e-6


def test_large_clusters_by_pivots_first(spark, monkeypatch):
    import random

    monkeypatch.setattr(M, "BLOCK", 8)
    monkeypatch.setattr(M, "HOT_LEAST", 3)
    r = random.Random(17)
    rows = []
    for _ in range(3):
        base = [f"w{r.randrange(10**6)}" for _ in range(120)]
        drift = list(base)
        for k in range(40):
            if k % 2:  # a chain: each step is close to the one before, its ends are far apart
                drift[r.randrange(len(drift))] = f"w{r.randrange(10**6)}"
                words = list(drift)
            else:
                words = list(base)
                for _ in range(r.randint(0, 5)):
                    words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {tuple(x) for x in M.near_duplicates(docs, 3, 85).select("doc_id", "n_shingles", "component_id", "kept").collect()}
    assert got == brute(rows, 3, 85)
