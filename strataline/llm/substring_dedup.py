"""Repeated passages by content-defined chunking.

Where chunks end depends on content alone, so text inserted before a passage moves its
chunks but does not change them: a gear hash over the 16 bytes from each unit on (a word, or
in text without white space a content-defined piece of it) is taken, and a cut is made at the
least hash of any ``SPAN`` units in a row. Chunks (4 words on average) are compared by 64-bit
digest. A chunk whose digest stands in two or more documents is repeated; adjacent repeated
chunks make a run.

Because every ``SPAN`` units hold a cut, the units of a passage of ``min_words`` words that
both copies cut alike make a run of at least ``shortest_run`` units in each of them,
whatever stands around: no passage is without a run. Which of the texts around the runs are
passages is decided by the exact bytes: each window of ``min_words`` words (or 16 bytes for
each of them, if that is less) that could have made the run is hashed, and is repeated if two
documents hold it. Adjacent repeated windows make a passage. No list of partners is made or
cut short, and adjacent repeats from different documents are not taken for one.

Digests of chunks and of windows are aggregated (first and last document) before the shuffle; a
digest that is everywhere costs one row a task, and its rows are salted in the join back.

Result rows: doc_id, byte_start, byte_end (of the UTF-8 text), n_words, first_doc_id
(where most of the passage's windows stand first; ties: the least) and duplicate (it is not
this one, so this copy can go). Documents without a repeated passage have no row. Repeats
inside one document do not count. Words are whole ones. Null and empty texts, rows with a null
doc_id and empty tables give no rows; rows that repeat a doc_id count as one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _hashing as H
from ._batches import small_batches
from ._filter import only
from ..store import drop, materialize, tidy

WINDOW = 16
SPAN = 7  # units, of which the least hash makes a cut
MIN_WORDS = 50
BYTES_A_WORD = 16  # at most: text without white space has words too
PIECE_BYTES = 8  # on average, of text without white space
UNIT_BITS = 24  # of a chunk's place, for the units that begin in it
_GEAR = (H.stream64(256, 31) >> H.U64(48)).astype(np.uint16)


def gear(data: np.ndarray) -> np.ndarray:
    """At each byte, the sum of the gear numbers of the last 16 bytes, each shifted once a step (16 bits, so older bytes are gone)."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8):
        older = h.copy()
        older[step:] += h[:-step] << np.uint16(step)
        h = older
    return h


def _space_before(data: np.ndarray) -> np.ndarray:
    """How many bytes of white space stand before each position."""
    return np.append(0, np.cumsum(H.SPACE[data], dtype=np.int64))


def units(data: np.ndarray, rows: np.ndarray, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, gear hash of the 16 bytes from there on, whether a word begins there) of the units of the rows that begin at ``rows``; the last one ends at ``hi``."""
    found = []
    lo = int(rows[0])
    ends = np.append(rows[1:], hi)
    for a in range(lo, hi, H.PIECE):
        b = min(hi, a + H.PIECE)
        back, ahead = max(lo, a - WINDOW), min(hi, b + WINDOW)
        h = gear(data[back:ahead])
        space = _space_before(data[back:b])
        p = np.flatnonzero(~H.SPACE[data[a:b]]) + a
        row = np.searchsorted(rows, p, side="right") - 1
        word = (p == rows[row]) | H.SPACE[data[np.maximum(p - 1, 0)]]
        # 16 bytes without white space before it, all of them the row's
        far = p - rows[row] >= WINDOW
        inner = far & ~word
        inner[far] &= space[p[far] - back] == space[p[far] - WINDOW - back]
        inner[inner] = h[p[inner] - 1 - back] < np.uint16((1 << 16) // PIECE_BYTES)
        keep = word | inner
        p, row, word = p[keep], row[keep], word[keep]
        found.append((p, h[np.minimum(p + WINDOW, ends[row]) - 1 - back], word))
    start, value, word = (np.concatenate(x) for x in zip(*found))
    return start, value, word


def cuts(start: np.ndarray, value: np.ndarray, row: np.ndarray, span: int) -> np.ndarray:
    """Which units are the least of some ``span`` units of a row (ties: the last)."""
    n = len(start)
    if n < span:
        return np.zeros(0, dtype=np.int64)
    key = (value.astype(np.int64) << 32) + np.arange(n - 1, -1, -1)
    least = key[: n - span + 1].copy()
    for k in range(1, span):
        np.minimum(least, key[k : n - span + 1 + k], out=least)
    least = least[row[: n - span + 1] == row[span - 1 :]]
    return np.unique(n - 1 - (least & 0xFFFFFFFF))


def _cut_up(data: np.ndarray, offsets: np.ndarray, span: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, start, end, words that begin in it, units, digest) of each chunk in groups; positions from the row's start."""
    for first, last in H.groups(offsets):
        lo, hi = int(offsets[first]), int(offsets[last])
        if hi == lo:
            continue
        starts = offsets[first : last + 1]
        rows = starts[:-1][np.diff(starts) > 0]
        unit, value, word = units(data, rows, hi)
        cut = unit[cuts(unit, value, np.searchsorted(rows, unit, side="right"), span)]
        edges = np.unique(np.concatenate((cut, rows, [hi])))
        start, end = edges[:-1], edges[1:]
        digest = np.empty(len(start), dtype=H.U64)
        at = 0
        while at < len(start):  # pieces of whole chunks
            to = max(at + 1, int(np.searchsorted(end, start[at] + H.PIECE, side="right")))
            base = int(start[at])
            digest[at:to] = H.Prefix(data[base : int(end[to - 1])], H.EXACT).ranges(start[at:to] - base, end[at:to] - base)
            at = to
        row = np.searchsorted(offsets, start, side="right") - 1
        words = unit[word]
        yield row, start - offsets[row], end - offsets[row], np.searchsorted(words, end) - np.searchsorted(words, start), np.searchsorted(unit, end) - np.searchsorted(unit, start), digest


def chunks(data: np.ndarray, offsets: np.ndarray, span: int = SPAN) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, start, end, words that begin in it, digest) of each chunk in groups; positions from the row's start."""
    for row, start, end, words, _, digest in _cut_up(data, offsets, span):
        yield row, start, end, words, digest


def chunked(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """(digest, doc_id, place, size) of each chunk; place is its start, then the number of its units."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = H.buffers(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for row, start, end, _, n, digest in _cut_up(data, offsets, span):
                place = (start.astype(np.int64) << UNIT_BITS) + np.minimum(n, (1 << UNIT_BITS) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(digest.view(np.int64)), pa.array(ids[row]), pa.array(place), pa.array((end - start).astype(np.int32))], names=["digest", "doc_id", "place", "size"])

    return _named(docs).mapInArrow(cut, "digest bigint, doc_id bigint, place bigint, size int")


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text is not null")


def common(mine: bytes, theirs: bytes, start: int, end: int) -> tuple[int, int]:
    """The longest text around ``mine[start:end]`` that ``theirs`` holds too: the whole run, or else one of its pieces, drawn out to both sides."""
    best = (start, start)
    pieces = [(start, end)] if mine[start:end] in theirs else [(k, min(end, k + 24)) for k in range(start, end, 24)]
    x = np.frombuffer(mine, dtype=np.uint8)
    y = np.frombuffer(theirs, dtype=np.uint8)
    for a, b in pieces:
        if b - a < 16 or best[0] <= a and b <= best[1]:
            continue
        at = theirs.find(mine[a:b])
        while at >= 0:
            n = min(a, at)
            off = np.flatnonzero(x[a - n : a][::-1] != y[at - n : at][::-1])
            left = int(off[0]) if len(off) else n
            n = min(len(x) - b, len(y) - at - (b - a))
            off = np.flatnonzero(x[b : b + n] != y[at + b - a : at + b - a + n])
            right = int(off[0]) if len(off) else n
            if b + right - a + left > best[1] - best[0]:
                best = (a - left, b + right)
            at = theirs.find(mine[a:b], at + right + 1)
    return best


def known(min_words: int) -> int:
    """Of a passage's units, those whose hash is of its own bytes: words and what parts them take two bytes at least, so at most 8 words begin in the last 15 bytes."""
    return min_words - WINDOW // 2


def shortest_run(span: int, min_words: int) -> int:
    """Units between the first and the last cut that a passage must have: both copies decide units ``span - 1`` to ``known - span`` alike, and every ``span`` of them hold a cut."""
    return max(1, known(min_words) - 4 * span + 3)


def windows(text: bytes, runs: list[tuple[int, int]], span: int, min_words: int) -> tuple[np.ndarray, ...]:
    """(start, end, number of the first word, words, digest) of each window of a text that could have made one of the runs (start, end)."""
    none = np.zeros(0, dtype=np.int64)
    data = np.frombuffer(text, dtype=np.uint8)
    if not len(data):
        return none, none, none, none, none.view(H.U64)
    start, _, word = units(data, np.zeros(1, dtype=np.int64), len(data))
    chosen = np.zeros(len(start) + 1, dtype=np.int64)
    for a, b in runs:
        # no cut before the run, and none after it, is among those that both copies share
        i, j = np.searchsorted(start, (a, b))
        i, j = max(0, int(i) - 2 * span + 2), int(j) + 2 * span - known(min_words) - 1
        if j >= i:
            chosen[i] += 1
            chosen[min(j + 1, len(start))] -= 1
    begin = start[np.cumsum(chosen[:-1]) > 0]
    space = np.append(H.SPACE[data], True)
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1  # of words
    words = start[word]
    nth = np.searchsorted(words, begin)
    far = np.append(ends, [len(data) + 1] * min_words)[nth + min_words - 1]
    stops = np.append(np.unique(np.concatenate((start, ends))), len(data) + 1)
    end = np.minimum(far, stops[np.searchsorted(stops, np.minimum(begin + BYTES_A_WORD * min_words, len(data) + 1))])
    whole = end <= len(data)
    begin, end, nth = begin[whole], end[whole], nth[whole]
    return begin, end, nth, np.searchsorted(words, end) - nth, H.Prefix(data, H.EXACT).ranges(begin, end)


def _windows(runs: DataFrame, docs: DataFrame, span: int, min_words: int) -> DataFrame:
    """Runs (doc_id, byte_start, byte_end) -> (digest, doc_id, place, words) of the windows around them; place is start and size, words is the number of the first and how many."""
    runs = runs.groupBy("doc_id").agg(F.collect_list("byte_start").alias("starts"), F.collect_list("byte_end").alias("ends"))
    texts = only(_named(docs), runs.select("doc_id"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for doc_id, text, starts, ends in _rows(batch, "doc_id", "text", "starts", "ends"):
                begin, end, nth, n, digest = windows(text.encode("utf-8", "surrogatepass"), list(zip(starts, ends)), span, min_words)
                parts.append((digest.view(np.int64), np.full(len(begin), doc_id, dtype=np.int64), (begin << 32) + end - begin, (nth << 32) + n))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts)], names=["digest", "doc_id", "place", "words"])

    return runs.join(texts, "doc_id").select("doc_id", "text", "starts", "ends").mapInArrow(cut, "digest bigint, doc_id bigint, place bigint, words bigint")


def _rows(batch: pa.RecordBatch, *columns: str) -> Iterator[tuple]:
    """A batch's rows one by one, so that its texts are not all held as objects."""
    return (tuple(x.as_py() for x in row) for row in zip(*(batch.column(c) for c in columns)))


#: A digest of more than this share of all rows is dealt over ``SALTS`` tasks; there are at most as many as go into one.
HOT_SHARE, SALTS = 1 / 1000, 64


def _repeated(pieces: DataFrame, first: bool) -> DataFrame:
    """The rows whose digest stands in two or more documents, with the first of them if that is asked for.

    The pieces are written once, and dropped when what repeats of them is written. The digests' first and
    last documents are aggregated before the shuffle. What is joined back with them is dealt by digest, and
    rows of the few digests that stand nearly everywhere by digest and a salt.
    """
    pieces = materialize(pieces, "pieces")
    held = pieces.groupBy("digest").agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last_doc_id"), F.count(F.lit(1)).alias("n")).where("first_doc_id <> last_doc_id")
    held = materialize(held.select("digest", "first_doc_id", "n"), "digests")
    total = held.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    hot = F.col("n") > total * HOT_SHARE
    salts = F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    few = held.where(hot).select("digest", F.lit(True).alias("hot"))  # of at most 1 / HOT_SHARE digests can this be true
    dealt = pieces.join(F.broadcast(few), "digest", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", "place"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))).drop("hot")
    found = dealt.join(held.select("digest", "first_doc_id", F.explode(salts).alias("salt")), ["digest", "salt"]).drop("digest", "salt")
    found = materialize(found if first else found.drop("first_doc_id"), "repeated")
    drop(pieces)
    return found


def _in_runs(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, start, size) with the number of their run, which goes on while rows begin no later than the last one ended, and whether a row begins where the one before did not."""
    order = Window.partitionBy("doc_id").orderBy("start", "size")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("reached", F.max(F.col("start") + F.col("size")).over(before)).withColumn("new", F.col("start") != F.lag("start", 1, -1).over(order))
    return rows.withColumn("run", F.sum((F.col("start") > F.coalesce("reached", F.lit(-1))).cast("long")).over(order))


@tidy("passages")
def repeated_passages(docs: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per repeated passage of each document."""
    start, end = F.min("start").alias("byte_start"), F.max(F.col("start") + F.col("size")).alias("byte_end")
    with small_batches(docs.sparkSession):
        hits = _repeated(chunked(docs, span), first=False).select("doc_id", F.shiftright("place", UNIT_BITS).alias("start"), F.col("place").bitwiseAND((1 << UNIT_BITS) - 1).alias("units"), "size")
    # rows that repeat a doc_id repeat its chunks
    runs = _in_runs(hits).groupBy("doc_id", "run").agg(start, end, F.sum(F.when(F.col("new"), F.col("units"))).alias("units"))
    runs = materialize(runs.where(F.col("units") >= shortest_run(span, min_words)).select("doc_id", "byte_start", "byte_end"), "chunks")
    low = (1 << 32) - 1
    with small_batches(docs.sparkSession, 500):
        held = _repeated(_windows(runs, docs, span, min_words), first=True).select(
            "doc_id", F.shiftright("place", 32).alias("start"), F.col("place").bitwiseAND(low).alias("size"), F.shiftright("words", 32).alias("nth"), F.col("words").bitwiseAND(low).alias("n"), "first_doc_id")
    found = _in_runs(held).groupBy("doc_id", "run").agg(start, end, (F.max(F.col("nth") + F.col("n")) - F.min("nth")).alias("n_words"), F.mode("first_doc_id", True).alias("first_doc_id"))
    found = materialize(found, "chunks")
    n_words = F.greatest("n_words", F.floor((F.col("byte_end") - F.col("byte_start")) / BYTES_A_WORD)).alias("n_words")
    return found.select("doc_id", "byte_start", "byte_end", n_words, "first_doc_id", (F.col("first_doc_id") != F.col("doc_id")).alias("duplicate"))
