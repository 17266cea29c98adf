import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from strataline.llm import _hashing as H

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\t\x0b漢", max_size=30)), max_size=8)


def all_words(texts):
    data, offsets = H.buffers(pa.array(texts, pa.string()))
    out = [[] for _ in texts]
    hashes = {}
    for found in H.words(data, offsets):
        for k, (a, b) in enumerate(zip(found.ptr[:-1], found.ptr[1:])):
            for w in range(a, b):
                raw = data[found.start[w] : found.end[w]].tobytes()
                out[found.first + k].append(raw)
                hashes.setdefault(raw.lower(), set()).add(int(found.hash[w]))
    return out, hashes


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words_are_those_of_split(texts):
    out, hashes = all_words(texts)
    assert out == [(t or "").encode().split() for t in texts]
    assert all(len(v) == 1 for v in hashes.values()) and len({min(v) for v in hashes.values()}) == len(hashes)


def test_long_rows_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(H, "PIECE", 1 << 10)
    text = " ".join(f"w{k}" for k in range(30_000)) + " " + "x" * 70_000 + " end"
    out, _ = all_words(["a b", text, "c"])
    assert out[1] == text.encode().split() and out[0] == [b"a", b"b"] and out[2] == [b"c"]


def test_slices_and_empty_columns():
    column = pa.array(["skip", None, "a b", ""], pa.string()).slice(1)
    data, offsets = H.buffers(column)
    assert len(offsets) == 4 and [len(s) for f in H.words(data, offsets) for s in H.shingle_sets(f, 3)] == [0, 1, 0]
    data, offsets = H.buffers(pa.array([], pa.string()))
    assert len(offsets) == 1 and list(H.words(data, offsets)) == []
    assert np.array_equal(H.mix64(np.array([1], H.U64)), H.mix64(np.array([1], H.U64)))
