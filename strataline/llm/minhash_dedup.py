"""Near-duplicate documents by b-bit MinHash.

Per document, K linear permutations of 32-bit shingle hashes give K minima. Bands of r
minima make candidate buckets; of each minimum only its low bits stay, packed into
longs, and the similarity of a candidate pair is estimated by counting equal b-bit
fields and correcting for chance agreement, (match/K - 2^-b) / (1 - 2^-b). Pairs whose
estimate is near or above the threshold are confirmed on their full shingle sets.

Equal sets are collapsed first, so a group of copies of any size is one node. No list of
all pairs of a bucket is made. Documents are first clustered by estimates against a few
pivots of their buckets; the links inside a cluster are counted exactly on the full sets,
in blocks of bounded size, and only least reachable ids come out of a block. Then only
documents of different clusters that share a bucket meet, filtered by the estimate inside
the join, and what passes is confirmed pair by pair. Inside a cluster that is larger than a
block, documents that their pivots connect are not compared with each other; what is compared
grows with the cluster's size times the number of those that are left.

With r and the number of bands chosen for a miss rate below 1e-6 at the threshold, what
is left to chance is that one pair in a million at the threshold shares no bucket, or
that an estimate is 4.5 standard deviations low.

Defined results: null or blank texts have an empty set, link with nothing and stay as
their own component. Rows that repeat a doc_id are one node. A row with a null doc_id
takes the component of its equals, if any has an id, and is never kept. Empty tables
give empty tables; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _hashing as H
from ._filter import only
from ..store import materialize, tidy
from .components import connected_components, roots

K, BITS = 128, 4
LONGS = K * BITS // 64
_MULTIPLIERS = (H.stream64(K, 21) >> H.U64(32)).astype(np.uint32) | np.uint32(1)
_SALT = H.stream64(K, 22)


def banding(threshold: float) -> tuple[int, int]:
    """Most rows a band, and as many bands as K allows, that miss a pair at the threshold less than once in a million."""
    fits = [r for r in range(1, 17) if (1 - threshold**r) ** (K // r) < 1e-6]
    r = max(fits, default=1)
    return r, K // r


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """K minima per non-empty set, as 32-bit words."""
    flat = (np.concatenate(sets) >> H.U64(32)).astype(np.uint32)
    at = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out, held = np.empty((len(sets), K), dtype=np.uint32), np.empty_like(flat)
    for k in range(K):
        np.multiply(flat, _MULTIPLIERS[k], out=held)
        out[:, k] = np.minimum.reduceat(held, at)
    return out


def packed(m: np.ndarray) -> np.ndarray:
    """The low b bits of each minimum, after mixing, packed into longs."""
    low = H.mix64(m.astype(H.U64) + _SALT) & H.U64((1 << BITS) - 1)
    low = low.reshape(len(m), LONGS, 64 // BITS) << (np.arange(64 // BITS, dtype=H.U64) * H.U64(BITS))
    return np.bitwise_or.reduce(low, axis=2)


def _bands(m: np.ndarray, r: int, n: int) -> np.ndarray:
    x = m[:, : r * n].astype(H.U64).reshape(len(m), n, r)
    key = np.zeros(x.shape[:2], dtype=H.U64)
    for k in range(r):
        key = H.mix64(key + x[:, :, k] + H.U64(0x9E3779B97F4A7C15))
    return H.mix64(key + _SALT[:n])


def _lists(values: np.ndarray, which: np.ndarray, n: int) -> pa.Array:
    """A list column of n rows that holds the rows of ``values`` at ``which`` and null elsewhere."""
    sizes = np.zeros(n + 1, dtype=np.int32)
    sizes[which + 1] = values.shape[1]
    empty = np.ones(n + 1, dtype=bool)
    empty[which] = empty[n] = False
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32), mask=empty), pa.array(values.astype(np.int64).ravel()))


SIGNED = "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, sig array<bigint>, bands array<bigint>"


def signed(docs: DataFrame, width: int, threshold: float) -> DataFrame:
    """Set size, set digest, b-bit signature and band keys of each document."""
    r, n = banding(threshold)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = H.buffers(batch.column("text"))
            for found in H.words(data, offsets):
                sets = list(H.shingle_sets(found, width))
                size = np.array([len(s) for s in sets], dtype=np.int64)
                which = np.flatnonzero(size)
                d1, d2 = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
                sig, keys = np.zeros((0, LONGS)), np.zeros((0, n))
                if len(which):
                    some = [sets[i] for i in which]
                    at = np.cumsum([0] + [len(s) for s in some[:-1]])
                    flat = np.concatenate(some)
                    d1[which] = H.mix64(np.add.reduceat(H.mix64(flat), at)).view(np.int64)
                    d2[which] = H.mix64(np.add.reduceat(H.mix64(flat + H.U64(1)), at)).view(np.int64)
                    m = minima(some)
                    sig, keys = packed(m).view(np.int64), _bands(m, r, n).view(np.int64)
                ids = batch.column("doc_id").slice(found.first, found.last - found.first)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(size), pa.array(d1), pa.array(d2), _lists(sig, which, len(sets)), _lists(keys, which, len(sets))],
                    names=["doc_id", "n_shingles", "d1", "d2", "sig", "bands"])
            H.give_back()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(sign, SIGNED)


def estimate(a: str, b: str) -> F.Column:
    """Collision-corrected similarity of two packed signatures, by bit counts."""
    differ = F.lit(0)
    ones = 0x1111111111111111  # the lowest bit of each 4-bit field
    for k in range(LONGS):
        x = F.expr(f"{a}[{k}] ^ {b}[{k}]")
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(ones))
        differ = differ + F.bit_count(x)
    chance = 1 / (1 << BITS)
    return (F.lit(1.0) - differ / F.lit(float(K)) - F.lit(chance)) / F.lit(1 - chance)


def least_estimate(threshold: float) -> float:
    """An estimate 4.5 standard deviations below the threshold."""
    chance = 1 / (1 << BITS)
    p = threshold + (1 - threshold) * chance
    return threshold - 4.5 * (p * (1 - p) / K) ** 0.5 / (1 - chance)


#: A document in more than this share of all pairs, and in so many at least, is dealt over ``SALTS`` tasks.
HOT_SHARE, HOT_LEAST, SALTS = 1 / 1000, 500, 64


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    left = only(texts, pairs.select(F.col("a").alias("doc_id"))).select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    right = only(texts, pairs.select(F.col("b").alias("doc_id"))).select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for name in ("ta", "tb"):
                # rows with the same text stand together after the join: hash each once
                column = batch.column(name).dictionary_encode()
                data, offsets = H.buffers(column.dictionary)
                sets = [s for found in H.words(data, offsets) for s in H.shingle_sets(found, width)]
                sides.append((sets, column.indices.to_numpy(zero_copy_only=False)))
            (xs, i), (ys, j) = sides
            keep = np.zeros(batch.num_rows, dtype=bool)
            for row in range(batch.num_rows):
                x, y = xs[i[row]], ys[j[row]]
                if len(x) > len(y):
                    x, y = y, x
                if 100 * len(x) < percent * len(y):
                    continue
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                same = int((y[at] == x).sum()) if len(y) else 0
                keep[row] = same > 0 and 100 * same >= percent * (len(x) + len(y) - same)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], names=["a", "b"])

    # a document that many pairs name is dealt over several tasks
    total = pairs.count()
    hot = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > max(HOT_LEAST, total * HOT_SHARE)).select("b")  # of at most 1 / HOT_SHARE can this be true
    hot = materialize(hot.withColumn("hot", F.lit(True)), "minhash")
    pairs = pairs.select("a", "b").join(F.broadcast(hot), "b", "left").select("a", "b", F.when(F.col("hot"), F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)).alias("salt"))
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = right.join(F.broadcast(hot), "b", "left").select("b", "tb", F.explode(salts).alias("salt"))
    return pairs.join(left, "a").join(right, ["b", "salt"]).select("a", "b", "ta", "tb").mapInArrow(check, "a bigint, b bigint")


#: Documents, and shingles, in a block of a cluster.
BLOCK, BLOCK_SHINGLES = 1024, 2_000_000


def linked_roots(sets: list[np.ndarray], ids: np.ndarray, mine: np.ndarray, theirs: np.ndarray, percent: int) -> np.ndarray:
    """For each set the least id reachable over links between rows of ``mine`` and rows of ``theirs``.

    Intersections are counted exactly, as products of 0/1 columns of the shingles that
    more than one set holds.
    """
    size = np.array([len(s) for s in sets], dtype=np.int64)
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    new = np.append(True, flat[1:] != flat[:-1])
    column = np.cumsum(new) - 1
    often = np.diff(np.append(np.flatnonzero(new), len(flat)))[column] > 1
    row, column = row[often], column[often]
    same = np.zeros((len(mine), len(theirs)), dtype=np.float32)
    place = np.full((2, len(sets)), -1)
    place[0, mine], place[1, theirs] = np.arange(len(mine)), np.arange(len(theirs))
    at = 0
    while at < len(column):  # about a thousand columns at a time
        to = int(np.searchsorted(column, column[at] + 1024))
        c, r = column[at:to] - column[at], row[at:to]
        sides = []
        for k, n in enumerate((len(mine), len(theirs))):
            dense = np.zeros((n, int(c[-1]) + 1), dtype=np.float32)
            here = place[k, r] >= 0
            dense[place[k, r[here]], c[here]] = 1
            sides.append(dense)
        same += sides[0] @ sides[1].T
        at = to
    union = size[mine][:, None] + size[theirs][None, :] - same
    i, j = np.nonzero(100 * same >= percent * union)
    return roots(ids, mine[i], theirs[j])


def _linked_in_clusters(rows: DataFrame, near: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b) edges that connect what is linked inside the clusters of ``rows`` (rep, n, cluster), found on full sets.

    Only what is connected counts, so where a cluster is larger than a block its documents are first
    held against the pivots that ``near`` (a, b) names, one pair of texts each. Those that this connects
    need no comparison among themselves: the cluster's largest connected part meets the rest of it
    only, and a cluster of a million copies of one text with small changes costs a million pairs.
    """
    sizes = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total")).where("m > 1")
    sizes = sizes.select("cluster", F.ceil(F.greatest(F.col("m") / BLOCK, F.col("total") / BLOCK_SHINGLES)).alias("blocks"))
    sized = materialize(rows.join(sizes, "cluster"), "minhash")
    small = sized.where("blocks = 1").select("rep", "cluster", F.lit(0).cast("bigint").alias("b1"), F.lit(0).cast("bigint").alias("b2"), F.lit(True).alias("mine"), F.lit(True).alias("theirs"))
    out, dealt = None, small
    large = sized.where("blocks > 1")
    if not large.isEmpty():
        pairs = near.join(large.select(F.col("rep").alias("a")), "a", "left_semi").distinct()
        out = materialize(confirmed(pairs, docs, width, percent), "minhash")
        where = materialize(connected_components(out), "minhash").select(F.col("node").alias("rep"), F.col("component").alias("part"))
        parted = materialize(large.join(where, "rep", "left").withColumn("part", F.coalesce("part", "rep")), "minhash")
        parts = parted.groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total"))
        most = parts.groupBy("cluster").agg(F.max_by("part", F.struct("m", "part")).alias("main"))
        rest = parts.join(most, "cluster").where("part <> main").groupBy("cluster", "main").agg(F.sum("m").alias("m"), F.sum("total").alias("total"))
        rest = rest.select("cluster", "main", F.ceil(F.greatest(F.col("m") / BLOCK, F.col("total") / BLOCK_SHINGLES)).alias("rests"))
        parted = parted.join(rest, "cluster")  # clusters that are one part are done
        spread = F.xxhash64("rep")
        first = parted.where("part <> main").select("rep", "cluster", F.pmod(spread, F.col("rests")).alias("b1"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("b2"), F.lit(True).alias("mine"), F.lit(False).alias("theirs"))
        second = parted.select("rep", "cluster", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rests") - 1)).alias("b1"), F.pmod(spread, F.col("blocks")).alias("b2"), F.lit(False).alias("mine"), F.lit(True).alias("theirs"))
        dealt = dealt.unionByName(first).unionByName(second)
    dealt = materialize(dealt, "minhash")
    texts = only(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), dealt.select(F.col("rep").alias("doc_id")))
    dealt = dealt.join(texts.withColumnRenamed("doc_id", "rep"), "rep").select("cluster", "b1", "b2", "mine", "theirs", "rep", "text")

    def link(group: pa.Table) -> pa.Table:
        data, offsets = H.buffers(group.column("text"))
        sets = [s for found in H.words(data, offsets) for s in H.shingle_sets(found, width)]
        ids = group.column("rep").to_numpy()
        mine, theirs = (np.flatnonzero(group.column(c).to_numpy(zero_copy_only=False)) for c in ("mine", "theirs"))
        root = linked_roots(sets, ids, mine, theirs, percent) if len(mine) and len(theirs) else ids
        return pa.table({"a": ids[root != ids], "b": root[root != ids]})

    found = dealt.groupBy("cluster", "b1", "b2").applyInArrow(link, "a bigint, b bigint")
    return found if out is None else found.unionByName(out)


def _nearest_pivots(rows: DataFrame, sigs: DataFrame, percent: int, low: float) -> DataFrame:
    """Of (a, b) rows, one for each shared band, the two partners of each a that share most bands, if their estimates reach ``low``."""
    shared = rows.where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    first = shared.groupBy("a").agg(F.max_by("b", F.struct("c", "b")).alias("x"), F.max_by("b", F.struct("c", F.negative("b"))).alias("y"))
    pairs = first.select("a", F.explode(F.array_distinct(F.array("x", "y"))).alias("b"))
    return materialize(_scored(pairs, sigs, percent).where(F.col("e") >= low).select("a", "b"), "minhash")


@tidy("near-documents")
def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    threshold = percent / 100
    low = least_estimate(threshold)
    sign = materialize(signed(docs, width, threshold), "minhash")
    classes = sign.where("n_shingles > 0").groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep")).where("rep is not null")
    classes = materialize(classes, "minhash")
    reps = classes.select("d1", "d2", F.col("n_shingles").alias("n"), "rep").join(
        sign.where("n_shingles > 0").select("d1", "d2", F.col("n_shingles").alias("n"), F.col("doc_id").alias("rep"), "sig", "bands"), ["d1", "d2", "n", "rep"]).dropDuplicates(["d1", "d2", "rep"])
    reps = materialize(reps.select("rep", "n", "sig", "bands"), "minhash")
    sigs = reps.select("rep", "n", "sig")
    own = reps.select("rep", F.explode("bands").alias("key"))
    shared = own.groupBy("key").agg(F.min("rep").alias("p0"), F.max("rep").alias("last"), F.min_by("rep", F.xxhash64("rep")).alias("p1")).where("p0 <> last")
    buckets = materialize(own.join(shared, "key").select("key", "rep", "p0", "p1"), "minhash")

    # clusters: whatever estimates connect to pivots of shared buckets, in two rounds
    near = _nearest_pivots(buckets.select(F.col("rep").alias("a"), F.explode(F.array_distinct(F.array("p0", "p1"))).alias("b")), sigs, percent, low)
    cluster = _clusters(near)
    rows = _with_cluster(buckets.select("key", "rep"), cluster)
    spread = F.xxhash64("rep", F.lit(5))
    pivots = rows.groupBy("key").agg(F.min("cluster").alias("lo"), F.max("cluster").alias("hi"), F.min_by(F.struct("rep", "cluster"), spread).alias("p"), F.max_by(F.struct("rep", "cluster"), spread).alias("q")).where("lo <> hi")
    again = rows.join(pivots, "key").select("rep", "cluster", F.explode(F.array("p", "q")).alias("b")).where("b.cluster <> cluster")
    near = near.unionByName(_nearest_pivots(again.select(F.col("rep").alias("a"), F.col("b.rep").alias("b")), sigs, percent, low))
    cluster = _clusters(near)
    links = materialize(_linked_in_clusters(_with_cluster(sigs.select("rep", "n"), cluster), near, docs, width, percent), "minhash")

    # pairs that share a bucket but no cluster: whoever is not in the bucket's largest
    # cluster meets the rest of it, and the estimate is a condition of the join
    rows = _with_cluster(buckets.select("key", "rep"), cluster)
    parts = rows.groupBy("key", "cluster").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.max_by("cluster", F.struct("c", "cluster")).alias("main")).where("k > 1")
    rows = materialize(rows.join(parts.select("key", "main"), "key").join(sigs, "rep"), "minhash")
    a, b = rows.alias("a"), rows.alias("b")
    rest = a.where("cluster <> main").join(
        b, (F.col("a.key") == F.col("b.key")) & (F.col("a.cluster") != F.col("b.cluster")) & (100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n")) & (estimate("a.sig", "b.sig") >= F.lit(low)))
    rest = materialize(rest.select(F.least("a.rep", "b.rep").alias("a"), F.greatest("a.rep", "b.rep").alias("b")).distinct(), "minhash")
    links = links.unionByName(materialize(confirmed(rest, docs, width, percent), "minhash"))
    where = materialize(connected_components(links), "minhash").select(F.col("node").alias("rep"), "component")
    named = classes.join(where, "rep", "left").select("d1", "d2", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    out = sign.select("doc_id", "n_shingles", "d1", "d2").join(named, ["d1", "d2", "n_shingles"], "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, one of each group of near duplicates: that of the least doc_id.

    Rows that repeat a doc_id become one. Rows with a null doc_id stay.
    """
    gone = near_duplicates(docs, width, percent).where("not kept and doc_id is not null").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id"])
    return named.select(docs.columns).unionByName(docs.where("doc_id is null"))


def _clusters(near: DataFrame) -> DataFrame:
    return materialize(connected_components(near), "minhash").select(F.col("node").alias("rep"), F.col("component").alias("cluster"))


def _with_cluster(rows: DataFrame, cluster: DataFrame) -> DataFrame:
    return rows.join(cluster, "rep", "left").withColumn("cluster", F.coalesce("cluster", "rep"))


def _scored(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """Estimates of pairs (a, b), without those whose set sizes alone rule a link out."""
    a = sigs.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    b = sigs.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    both = pairs.join(a, "a").join(b, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return both.select("a", "b", estimate("sa", "sb").alias("e"))
