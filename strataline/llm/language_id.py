"""Language identification by rank-order profiles (out-of-place distance).

A language's profile is its most frequent character n-grams (n = 1 to 3, words padded
with a boundary mark), ranked by their counts over all training documents. A document's
own most frequent n-grams are ranked alike, and each language's distance is the sum of
rank differences, with the profile's length for an n-gram that the profile lacks. The
least distance wins; the score is one less the distance as a share of the largest
possible. Ties go to the code-point order of n-grams and of language names.

Texts are lower-cased; whatever is no letter is a boundary.

Defined results: null texts and texts without a letter are ``und`` with score 0, as is
every text where nothing could be learned. Rows with a null lang are not learned from, nor rows with
a null doc_id, of which it cannot be told whether they are held out (their held_out is false).
Repeated rows count each time they are there. Texts of any length are read whole. Empty tables give
empty tables; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOP = 300
#: Languages that a model may hold; more is an error, because profiles go to every executor.
MAX_LANGUAGES = 5_000
_HOLD = 1 << 20  # n-grams counted at a time


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def ngrams(text: str) -> np.ndarray:
    """The keys of a text's n-grams, in no order: 21 bits a character, 0 the boundary."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[c]
    if not letter.any():
        return np.zeros(0, np.uint64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    x = np.zeros(int(keep.sum()) + 2, dtype=np.uint64)
    x[1:-1] = np.where(letter, c, 0)[keep]
    if x[-2] == 0:
        x = x[:-1]
    high, mid = np.uint64(42), np.uint64(21)
    one = x[x > 0] << high | np.uint64(1 << 63)
    two = x[:-1] << high | x[1:]
    three = (x[:-2] << high | x[1:-1] << mid | x[2:])[x[1:-1] > 0]
    return np.concatenate((one, two, three))


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.diff(np.append(at, len(keys)))


def _sum(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[at], np.add.reduceat(counts, at)


def profiles(docs: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, key, rank from 0) learned from every row of ``docs`` (text, lang)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        raw: dict[str, list[np.ndarray]] = {}
        size: dict[str, int] = {}

        def fold(lang: str) -> None:
            if raw.get(lang):
                held.setdefault(lang, []).append(counted(np.concatenate(raw[lang])))
                if len(held[lang]) >= 8:
                    held[lang] = [_sum(held[lang])]
            raw[lang], size[lang] = [], 0

        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang")):
                lang = lang.as_py()
                got = ngrams(text.as_py())
                raw.setdefault(lang, []).append(got)
                size[lang] = size.get(lang, 0) + len(got)
                if size[lang] > _HOLD:
                    fold(lang)
        for lang in list(raw):
            fold(lang)
            if held.get(lang):
                keys, counts = _sum(held.pop(lang))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], names=["lang", "key", "n"])

    rows = docs.select("text", "lang").where("text is not null and lang is not null").mapInArrow(count, "lang string, key bigint, n bigint")
    total = rows.groupBy("lang", "key").agg(F.sum("n").alias("n"))
    # the order of unsigned keys, ties included
    order = Window.partitionBy("lang").orderBy(F.desc("n"), (F.col("key") < 0).asc(), "key")
    return total.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < top).select("lang", "key", "rank")


def collected(model: DataFrame, top: int = TOP) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, sorted n-grams of all profiles, and the rank of each by language (``top`` where absent).

    At most MAX_LANGUAGES * ``top`` short rows come to the driver.
    """
    rows = model.limit(MAX_LANGUAGES * top + 1).collect()
    if len(rows) > MAX_LANGUAGES * top:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    langs = sorted({r.lang for r in rows})
    keys = np.array([r.key for r in rows], dtype=np.int64).view(np.uint64)
    known = np.unique(keys)
    ranks = np.full((len(langs), len(known)), top, dtype=np.int32)
    row = {lang: i for i, lang in enumerate(langs)}
    if len(rows):
        ranks[[row[r.lang] for r in rows], np.searchsorted(known, keys)] = [r.rank for r in rows]
    return langs, known, ranks


def nearest(text: str | None, langs: list[str], known: np.ndarray, ranks: np.ndarray, top: int = TOP) -> tuple[str, float]:
    """The language of least out-of-place distance, and its score."""
    keys, counts = counted(ngrams(text or ""))
    if not len(keys) or not langs:
        return "und", 0.0
    mine = keys[np.argsort(-counts, kind="stable")[:top]]
    at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
    found = known[at] == mine
    theirs = ranks[:, at[found]]
    place = np.flatnonzero(found).astype(np.int32)
    apart = np.where(theirs == top, top, np.abs(theirs - place))
    distance = apart.sum(axis=1) + top * int((~found).sum())
    best = int(np.argmin(distance))
    return langs[best], float(1 - distance[best] / (top * len(mine)))


def held_out() -> F.Column:
    """crc32 of doc_id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, top: int = TOP) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score; learned from the rows that are not held out."""
    langs, known, ranks = collected(profiles(docs.where(F.col("doc_id").isNotNull() & ~held_out()), top), top)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [nearest(t.as_py(), langs, known, ranks, top) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, top: int = TOP) -> DataFrame:
    """The rows of ``docs``, all columns, whose language could be told; what is ``und`` goes."""
    langs, known, ranks = collected(profiles(docs.where(F.col("doc_id").isNotNull() & ~held_out()), top), top)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [nearest(t.as_py(), langs, known, ranks, top)[0] != "und" for t in batch.column("text")]
            yield batch.filter(pa.array(told, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
