"""Near-duplicate vectors by randomised-rotation binary codes.

Unit vectors are turned into ``bits(d)`` coordinates by a random matrix with orthonormal columns, which
leaves inner products as they are. A vector's code is the signs of its coordinates, one bit each, with one
stored correction factor: f, the inner product of the turned vector with its own code vector. For another
vector q, <code(x), q> / f(x) is an unbiased estimate of <x, q>. q takes part with coordinates rounded to 4
bits, stored as bit planes, so that the estimate is made of bit counts alone. It is off by at most

    EPSILON / sqrt(bits - 1) * (sqrt(1 - f^2) + |q - rounded q|) / f ,

a confidence bound (at EPSILON = 6 a pair is lost less than once in 10^8). Only pairs whose estimate can
reach the threshold are computed again, exactly, in double precision.

Equal vectors of a label are one node with a count and a number of its own. Codes, factors and planes are
made once for each node and stored. A label's nodes are dealt by hash into blocks of ``BLOCK`` rows; each
pair of blocks is a group of codes on one side and planes on the other, of bounded size, that says which of
its rows are in doubt: in some pair that the estimate does not rule out. Full vectors are read for those
rows only, again by pairs of blocks. A group returns link counts and the least reachable node by vector,
never a list of pairs. What is compared still grows with the square of a label's size: up to 256 dimensions, a row
costs 36 or 140 bytes for each block it meets, as code or as planes, and a pair 16 bit counts.

Defined results: vectors that are null, empty or zero, or hold null or non-finite
components, and vectors without a label, link with nothing, as do vectors of different
lengths. Rows that repeat a vec_id count as vectors of their own in n_links and share a
component. A row with a null vec_id counts and connects like any other; it takes the least vec_id of its
component, or null if there is none, and is not kept.
Empty tables give empty tables; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import materialize, tidy
from .components import connected_components, roots

THRESHOLD = 0.93
BLOCK = 2048
EPSILON = 6.0
LEAST_BITS = 256
PLANES = 4
TILE = 256  # rows of a block that are compared at a time


def bits(d: int) -> int:
    """Bits of a code: whole words, and enough that the estimate tells most pairs."""
    return max(LEAST_BITS, -(-d // 64) * 64)


@cache
def rotation(d: int) -> np.ndarray:
    """A random matrix with orthonormal columns, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(97 + d).standard_normal((bits(d), d)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits of turned unit vectors, and the factor of each."""
    turned = x @ rotation(x.shape[1]).T
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])


def signs(codes: np.ndarray, d: int) -> np.ndarray:
    """The code vectors, of unit length."""
    n = bits(d)
    return (np.unpackbits(codes, axis=1, count=n).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(n))


class Rounded(NamedTuple):
    """Turned vectors in whole steps."""

    planes: np.ndarray  # packed bits of the step numbers, by plane: rows, planes, bytes
    low: np.ndarray
    step: np.ndarray
    off: np.ndarray  # how far the rounded vector is from the true one

    def take(self, rows: np.ndarray | slice) -> Rounded:
        return Rounded(*(x[rows] for x in self))


def rounded(q: np.ndarray) -> Rounded:
    turned = q @ rotation(q.shape[1]).T
    low = turned.min(axis=1, keepdims=True)
    step = np.maximum((turned.max(axis=1, keepdims=True) - low) / ((1 << PLANES) - 1), 1e-12)
    number = np.clip(np.rint((turned - low) / step), 0, (1 << PLANES) - 1).astype(np.uint8)
    planes = np.stack([np.packbits(number >> k & 1, axis=1) for k in range(PLANES)], axis=1)
    return Rounded(planes, low[:, 0], step[:, 0], np.linalg.norm(turned - low - step * number, axis=1))


def estimates(codes: np.ndarray, q: Rounded) -> np.ndarray:
    """Inner products of code vectors (rows) with rounded vectors (columns), by bit counts."""
    n = codes.shape[1] * 8
    mine = np.ascontiguousarray(codes).view(np.uint64)
    theirs = np.ascontiguousarray(q.planes).view(np.uint64)
    weight = np.bitwise_count(theirs).sum(axis=2, dtype=np.float32) @ (2.0 ** np.arange(PLANES)).astype(np.float32)
    total = q.low * n + q.step * weight  # of the rounded coordinates
    kind = np.uint16 if n << PLANES < 1 << 16 else np.uint32
    both = np.zeros((len(codes), len(theirs)), dtype=kind)
    for k in range(PLANES):
        for w in range(mine.shape[1]):
            both += np.bitwise_count(mine[:, w, None] & theirs[None, :, k, w]).astype(kind) << kind(k)
    ones = np.bitwise_count(mine).sum(axis=1, dtype=np.float32)[:, None]
    return (2 * (q.low * ones + q.step * both) - total) / np.sqrt(n)


def reach(codes: np.ndarray, factor: np.ndarray, q: Rounded, threshold: float) -> np.ndarray:
    """Which pairs (row of codes, row of q) may have an inner product of ``threshold``."""
    f = np.clip(factor, 1e-6, 1.0)[:, None]
    bound = EPSILON / np.sqrt(codes.shape[1] * 8 - 1) * (np.sqrt(1 - f * f) + q.off)
    return estimates(codes, q) + bound + 1e-5 >= threshold * f


def within_reach(codes: np.ndarray, factor: np.ndarray, q: np.ndarray, threshold: float) -> np.ndarray:
    """``reach`` for unit vectors that are not rounded yet."""
    return reach(codes, factor, rounded(q), threshold)


def _above(near: np.ndarray, first: int) -> np.ndarray:
    """Of a block with itself, rows from ``first`` on: each pair once."""
    return near & (np.arange(near.shape[1])[None, :] > np.arange(first, first + len(near))[:, None])


CODED = "node bigint, label {0}, h bigint, embedding {1}, vec_id bigint, n bigint, d int, code binary, factor float, planes binary, low float, step float, off float"
COLUMNS = ("code", "factor", "planes", "low", "step", "off")


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the codes of nodes."""
    for batch in batches:
        vectors = batch.column("embedding")
        sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
        for d in np.unique(sizes):
            some = batch.filter(pa.array(sizes == d))
            x = unit(some.column("embedding"), int(d))
            (codes, factor), q = encode(x), rounded(x)
            packed = [pa.array(np.full(len(x), d), pa.int32()), _binary(codes), pa.array(factor.astype(np.float32)), _binary(q.planes.reshape(len(x), -1)), *(pa.array(v.astype(np.float32)) for v in (q.low, q.step, q.off))]
            yield pa.RecordBatch.from_arrays([*some.columns, *packed], names=[*some.schema.names, "d", *COLUMNS])


def unit(vectors: pa.Array, d: int) -> np.ndarray:
    x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # very small and very large ones have a norm, too
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _binary(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, (len(rows) + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _bytes(column: pa.ChunkedArray, shape: tuple[int, ...]) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), *shape)


def _codes_of(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    n = bits(group.column("d")[0].as_py()) // 8
    return _bytes(group.column("code"), (n,)), group.column("factor").to_numpy()


def _rounded_of(group: pa.Table) -> Rounded:
    n = bits(group.column("d")[0].as_py()) // 8
    return Rounded(_bytes(group.column("planes"), (PLANES, n)), *(group.column(c).to_numpy().astype(np.float32) for c in ("low", "step", "off")))


def _sides(group: pa.Table) -> tuple[pa.Table, pa.Table, bool]:
    """The rows of the first and of the second block of a group, and whether they are one block."""
    block = group.column("block").to_numpy()
    b1, b2 = group.column("b1")[0].as_py(), group.column("b2")[0].as_py()
    return group.filter(pa.array(block == b1)), group.filter(pa.array(block == b2)), b1 == b2


def doubtful(threshold: float):
    """Of a pair of blocks, by codes alone: the rows that are in some pair the estimate does not rule out."""

    def one(group: pa.Table) -> pa.Table:
        first, second, same = _sides(group)
        mine, theirs = np.zeros(len(first), dtype=bool), np.zeros(len(second), dtype=bool)
        if len(first) and len(second):
            (codes, factor), q = _codes_of(first), _rounded_of(second)
            for a in range(0, len(first), TILE):
                near = reach(codes[a : a + TILE], factor[a : a + TILE], q, threshold)
                near = _above(near, a) if same else near
                mine[a : a + TILE] = near.any(axis=1)
                theirs |= near.any(axis=0)
        found = first.filter(pa.array(mine | theirs)) if same else pa.concat_tables([first.filter(pa.array(mine)), second.filter(pa.array(theirs))])
        return found.select(["node", "block", "b1", "b2"])

    return one


def linked(threshold: float):
    """Of a pair of blocks, the rows in doubt with their vectors: link counts, and the least node that each reaches."""

    def one(group: pa.Table) -> pa.Table:
        first, second, same = _sides(group)
        d = group.column("d")[0].as_py()
        (codes, factor), q = _codes_of(first), _rounded_of(second)
        x, y = (unit(t.column("embedding").combine_chunks(), d) for t in (first, second))
        pairs = []
        for a in range(0, len(first), TILE):
            near = reach(codes[a : a + TILE], factor[a : a + TILE], q, threshold)
            i, j = np.nonzero(_above(near, a) if same else near)
            i += a
            for b in range(0, len(i), 1 << 15):
                some = slice(b, b + (1 << 15))
                keep = np.einsum("nd,nd->n", x[i[some]], y[j[some]]) >= threshold
                pairs.append((i[some][keep], j[some][keep]))
        i, j = (np.concatenate(v) for v in zip(*pairs)) if pairs else (np.zeros(0, int), np.zeros(0, int))
        rows = first if same else pa.concat_tables([first, second])
        j = j if same else j + len(first)
        ids, count = rows.column("node").to_numpy(), rows.column("n").to_numpy()
        links = np.bincount(i, weights=count[j], minlength=len(ids)) + np.bincount(j, weights=count[i], minlength=len(ids))
        held = links > 0
        return pa.table({"node": ids[held], "links": links[held].astype(np.int64), "root": roots(ids, i, j)[held]})

    return one


@tidy("near-vectors")
def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", "embedding")
    usable = F.expr("label is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)")
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False))).withColumn("h", F.xxhash64("embedding"))
    good = rows.where("usable")
    grouped = good.groupBy("label", "h", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("n"))
    # numbers are given once, in a written table: what is computed again by a lost executor finds the same ones
    numbered = materialize(grouped.withColumn("node", F.monotonically_increasing_id()), "vectors").select("node", "label", "h", "embedding", "vec_id", "n")
    kinds = dict(rows.dtypes)
    nodes = materialize(numbered.mapInArrow(_coded, CODED.format(kinds["label"], kinds["embedding"])), "vectors")

    sizes = nodes.groupBy("label", "d").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    dealt = nodes.select("node", "label", "d", *COLUMNS).join(sizes, ["label", "d"])
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    as_first, as_second = F.col("block") <= F.col("other"), F.col("block") >= F.col("other")
    dealt = dealt.select(
        "label", "d", "node", "block", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"),
        *(F.when(as_first, F.col(c)).alias(c) for c in COLUMNS[:2]), *(F.when(as_second, F.col(c)).alias(c) for c in COLUMNS[2:]))
    doubts = dealt.groupBy("label", "d", "b1", "b2").applyInArrow(doubtful(threshold), "node bigint, block bigint, b1 bigint, b2 bigint")
    doubts = materialize(doubts, "vectors")
    held = doubts.join(nodes.select("node", "label", "d", "n", "embedding", *COLUMNS), "node")
    found = materialize(held.groupBy("label", "d", "b1", "b2").applyInArrow(linked(threshold), "node bigint, links bigint, root bigint"), "vectors")

    placed = materialize(good.join(nodes.select("label", "h", "embedding", "node", "n"), ["label", "h", "embedding"]).select("vec_id", "node", "n"), "vectors")
    # rows that repeat a vec_id connect their nodes
    repeated = placed.where("vec_id is not null").groupBy("vec_id").agg(F.min("node").alias("b"), F.max("node").alias("last")).where("b <> last").select("vec_id", "b")
    edges = found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(placed.join(repeated, "vec_id").select(F.col("node").alias("a"), "b"))
    where = materialize(connected_components(edges), "vectors")
    least = nodes.select("node", "vec_id").join(where, "node").groupBy("component").agg(F.min("vec_id").alias("component_id"))
    named = nodes.select("node", "vec_id").join(where, "node", "left").join(least, "component", "left")
    named = named.select("node", F.when(F.col("component").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    done = placed.join(named, "node").join(links, "node", "left").select("vec_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = done.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
