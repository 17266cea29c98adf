import math
import os
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataline.llm import _hashing as H
from strataline.llm import pieces as P

pytestmark = pytest.mark.skipif(not os.path.exists(P.DEFAULT_MODEL), reason="no model file")


@pytest.fixture(scope="module")
def vocabulary():
    return P.load()


def encoded(v, rows, seed=0):
    data, offsets = H.buffers(pa.array([t for _, t in rows], pa.string()))
    out = []
    for first, last, tokens, at in P.encode(v, data, offsets, P.row_keys(pa.array([k for k, _ in rows], pa.int64()), seed)):
        out += [tokens[at[k - first] : at[k - first + 1]] for k in range(first, last)]
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aé \n▁漢🎉\x00theing "), max_size=60), min_size=1, max_size=6))
def test_round_trip_and_reproducibility(texts):
    v = P.load()
    rows = list(enumerate(texts))
    all_ = encoded(v, rows)
    assert [P.decode(v, t).decode() for t in all_] == texts
    for k, row in enumerate(rows):
        assert encoded(v, [row])[0].tolist() == all_[k].tolist()


def test_draws_follow_the_exact_distribution(vocabulary):
    v, word = vocabulary, " then"
    weight = {p: v.weight[i] for i, p in enumerate(v.pieces) if p and i in set(v.id.tolist())}

    def splits(s):
        if not s:
            yield ()
        for n in range(1, len(s) + 1):
            if s[:n] in weight:
                yield from ((s[:n], *rest) for rest in splits(s[n:]))

    share = {s: math.exp(sum(weight[p] for p in s)) for s in splits(word.encode())}
    total, n = sum(share.values()), 20_000
    seen = Counter(tuple(v.pieces[i] for i in t) for t in encoded(v, [(k, "then") for k in range(n)]))
    assert sum(seen.values()) == n and set(seen) <= set(share)
    for s, w in share.items():
        p = w / total
        assert abs(seen[s] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4


def test_long_rows_do_not_depend_on_their_cuts(vocabulary, monkeypatch):
    text = " ".join(f"word{k} then  some" for k in range(3000)) + "\n" + "y" * 4000
    whole = encoded(vocabulary, [(3, text)])[0]
    monkeypatch.setattr(H, "PIECE", 5000)
    cut = encoded(vocabulary, [(1, "a b"), (3, text), (2, "c")])
    assert cut[1].tolist() == whole.tolist() and P.decode(vocabulary, whole).decode() == text


def test_tables(spark):
    rows = [(1, "The end of it"), (2, None), (3, ""), (None, "a▁b"), (1, "The end of it")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("tokens", F.lit("clash"))
    got = P.tokenize(df)
    assert [(r.doc_id, r.lossless) for r in got.collect()] == [(1, True), (2, None), (3, True), (None, True), (1, True)]
    assert [tuple(r) for r in P.detokenize(got).collect()] == rows
    a, b = (P.tokenize(df, seed=s).first().tokens for s in (0, 0))
    assert a == b
    d = P.digests(df).collect()
    assert d[0] == d[4] and d[1].n_tokens is None and d[2].n_tokens == 0 and all(r.lossless in (True, None) for r in d)
    assert P.digests(df.limit(0)).count() == 0 == P.tokenize(df.limit(0)).count()
    assert np.all(P.load().byte_id >= 0)


def test_lattices_are_small_and_memory_is_given_back(vocabulary, monkeypatch):
    seen = []
    monkeypatch.setattr(P, "lattice", lambda v, data, *rest, f=P.lattice: seen.append(len(data)) or f(v, data, *rest))
    text = " ".join(f"w{k}" for k in range(150_000))
    got = encoded(vocabulary, [(1, text), (2, text[:400_000]), (3, "end")])
    assert [P.decode(vocabulary, t).decode() for t in got] == [text, text[:400_000], "end"]
    assert max(seen) <= 2 * P.LATTICE + 2 < H.PIECE

    def resident():
        return next(int(x.split()[1]) for x in open("/proc/self/status") if x.startswith("VmRSS"))

    held = [np.ones(1000) for _ in range(20_000)]  # blocks too small for maps of their own
    keep, full = held[::5000], resident()
    del held
    H.give_back()
    assert full - resident() > 100_000 and len(keep) == 4
