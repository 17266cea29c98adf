"""Quality scores from supervised subword embeddings.

A document's features are its words, the pairs of adjacent words, and its character n-grams (3 and 4
bytes, of the whole text, white space and punctuation included), hashed into buckets, and one mark that
every text has. The hash of a pair is the mixed difference of its words' hashes, so that a word which
follows itself gives the same bucket whichever word it is: a mark of echoes, chosen by hand. Each bucket has a learned vector; the mean
of a document's vectors goes through a softmax over the two classes. Vectors and output weights are trained by
stochastic gradient descent in numpy, one document a step, on at most ``max_train``
labelled documents (those of least hash of doc_id, whole texts).

The output is linear in the mean vector, so scoring needs one number a bucket: its
vector's product with the difference of the two output columns.

Defined results: null and empty texts have the mark alone and get a score too. Without
any label every score is 0.5. A doc_id that has several labels is learned with each, and repeated
rows of a document each count as an example; a tie of the two classes is predicted as 1.
Rows with a null doc_id are scored and count as not held out. Empty tables give empty
tables; columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _hashing as H
from .language_id import held_out

WORD_BITS, GRAM_BITS, PAIR_BITS, GRAMS = 15, 16, 15, (3, 4)
FIRST_GRAM = 1 << WORD_BITS
FIRST_PAIR = FIRST_GRAM + (1 << GRAM_BITS)
MARK = FIRST_PAIR + (1 << PAIR_BITS)
BUCKETS = MARK + 1
MAX_TRAIN = 4000
DIM, EPOCHS, RATE = 8, 6, 20.0


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, buckets, 1) streams in groups: first row, bucket of each feature, row of each feature less the first."""
    for found in H.words(data, offsets, H.EXACT):
        rows = np.repeat(np.arange(found.last - found.first, dtype=np.int32), np.diff(found.ptr))
        yield found.first, (found.hash >> H.U64(64 - WORD_BITS)).astype(np.int32), rows
        pair = np.flatnonzero(rows[1:] == rows[:-1])
        h = H.mix64(found.hash[pair + 1] - found.hash[pair])
        yield found.first, (h >> H.U64(64 - PAIR_BITS)).astype(np.int32) + FIRST_PAIR, rows[pair]
        lo, hi = int(offsets[found.first]), int(offsets[found.last])
        most = max(GRAMS)
        for at in range(lo, hi, H.PIECE):
            end = min(hi, at + H.PIECE + most - 1)
            prefix = H.Prefix(data[at:end], H.EXACT)
            row = (np.searchsorted(offsets, np.arange(at, end), side="right") - 1).astype(np.int32) if found.last - found.first > 1 else np.full(end - at, found.first, np.int32)
            for n in GRAMS:
                last = min(at + H.PIECE, hi - n + 1, end - n + 1)  # n-grams begin before it
                if last <= at:
                    continue
                start = np.arange(last - at)
                same = row[: last - at] == row[n - 1 : last - at + n - 1]
                h = prefix.ranges(start, start + n)
                yield found.first, (h >> H.U64(64 - GRAM_BITS)).astype(np.int32)[same] + FIRST_GRAM, row[: last - at][same] - found.first


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct buckets and their counts by document."""
    for batch in batches:
        data, offsets = H.buffers(batch.column("text"))
        for row in range(batch.num_rows):
            total = np.zeros(BUCKETS, dtype=np.int64)
            total[MARK] = 1
            for _, bucket, _ in features(data, offsets[row : row + 2]):
                total += np.bincount(bucket, minlength=BUCKETS)
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, 1), batch.column("quality").slice(row, 1), pa.array([some.astype(np.int32)], pa.list_(pa.int32())), pa.array([total[some].astype(np.int32)], pa.list_(pa.int32()))], names=["doc_id", "quality", "bucket", "n"])


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE) -> np.ndarray:
    """One weight a bucket: the log-odds of label 1 that it adds to a document's mean."""
    rng = np.random.default_rng(17)
    vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    output = np.zeros((dim, 2), dtype=np.float32)
    if not examples:
        return np.zeros(BUCKETS, dtype=np.float32)
    steps, done = epochs * len(examples), 0
    ready = [(b, (n / n.sum()).astype(np.float32)[:, None], y) for b, n, y in examples]
    for _ in range(epochs):
        for i in rng.permutation(len(ready)):
            bucket, share, y = ready[i]
            step = rate * (1 - done / steps)
            done += 1
            mine = vectors[bucket]
            mean = (mine * share).sum(axis=0)
            z = mean @ output
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = output @ p
            output -= min(step, 1.0) * np.outer(mean, p)
            # a share is about one in the number of features: scaled by its norm, a step moves the mean as far for long texts as for short
            vectors[bucket] = mine - step * share * back
    return vectors @ (output[:, 1] - output[:, 0])


def learned(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> np.ndarray:
    """Weights from at most ``max_train`` labelled documents that are not held out."""
    marked = labels.where(~held_out() & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "quality").distinct()
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_train)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most max_train short rows
    got = rows.select("doc_id", F.col("quality").cast("int").alias("quality"), "text").mapInArrow(_counts, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, quality int, bucket array<int>, n array<int>")
    by_id = got.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_train).toArrow()
    examples = [(b.values.to_numpy(), n.values.to_numpy(), y.as_py()) for b, n, y in zip(by_id["bucket"], by_id["n"], by_id["quality"])]
    return train(examples)


def score(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(learned(docs, labels, max_train).astype(np.float32))  # BUCKETS floats

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = shared.value
        for batch in batches:
            data, offsets = H.buffers(batch.column("text"))
            total, n = np.full(batch.num_rows, weight[MARK], dtype=np.float64), np.ones(batch.num_rows)
            for first, bucket, row in features(data, offsets):
                if len(row):
                    got = np.bincount(row, weights=weight[bucket])
                    total[first : first + len(got)] += got
                    n[first : first + len(got)] += np.bincount(row)
            p = 1 / (1 + np.exp(-np.clip(total / n, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(predict, f"doc_id {kind}, held_out boolean, score double, predicted int")
