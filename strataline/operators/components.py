"""Connected and strongly connected components of edge tables of any size."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import Rounds, materialize, tidy

#: Edges of a weakly connected component that one task may solve.
SMALL = 200_000


def least_reached(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (i, j), and the least node that each of them reaches."""
    names, at = np.unique(np.concatenate((i, j)), return_inverse=True)
    a, b = at[: len(i)], at[len(i) :]
    low = np.arange(len(names))
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        np.minimum.at(new, low[a], low[b])  # trees hook on as wholes, so that a long path takes few rounds
        np.minimum.at(new, low[b], low[a])
        new = new[new]
        if (new == low).all():
            return names, names[low]
        low = new


def _solved(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) -> (node, component) by one task, without a shuffle."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column("u").to_numpy(zero_copy_only=False), b.column("v").to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
        if parts:
            found = least_reached(*map(np.concatenate, zip(*parts)))
            yield pa.RecordBatch.from_arrays(list(map(pa.array, found)), names=["node", "component"])

    kind = dict(edges.dtypes)["u"]
    return edges.coalesce(1).mapInArrow(solve, f"node {kind}, component {kind}")


def connected_components(edges: DataFrame, rounds: int = 40, small: int = SMALL) -> DataFrame:
    """``edges`` (a, b) -> (node, component), component the least reachable node.

    At most ``small`` edges are solved whole by one task, since rounds cost much more than that.
    More take large-star and small-star rounds: every step is an aggregation to the least
    neighbour and a join on the node, so a hub of any degree is pre-aggregated before
    the shuffle and its join can be split. Each round is written to the shared folder.
    Self-loops, repeated edges and nulls are dropped; an empty table gives an empty table.
    """
    rounds_ = Rounds(edges.sparkSession, "cc")
    work = rounds_.keep(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("a is not null and b is not null and a <> b"))
    if work.count() <= small:
        return _solved(work)
    work = rounds_.keep(work.distinct())
    before = None
    for _ in range(rounds):
        both = work.unionByName(work.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        work = rounds_.keep(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct())
        state = work.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("connected components did not settle")
    roots = work.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return work.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def tarjan(edges: Iterable[tuple[object, object]]) -> list[list[object]]:
    """Strongly connected components of more than one node, without recursion."""
    after: dict[object, list[object]] = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
        after.setdefault(b, [])
    index: dict[object, int] = {}
    low: dict[object, int] = {}
    stack: list[object] = []
    on: set[object] = set()
    found = []
    for root in after:
        if root in index:
            continue
        work = [(root, iter(after[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            node, rest = work[-1]
            for nxt in rest:
                if nxt not in index:
                    index[nxt] = low[nxt] = len(index)
                    stack.append(nxt)
                    on.add(nxt)
                    work.append((nxt, iter(after[nxt])))
                    break
                if nxt in on:
                    low[node] = min(low[node], index[nxt])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    part = []
                    while True:
                        part.append(stack.pop())
                        on.discard(part[-1])
                        if part[-1] == node:
                            break
                    if len(part) > 1:
                        found.append(part)
    return found


def trimmed(edges: DataFrame, rounds: int = 3) -> DataFrame:
    """Edges without nodes that nothing enters or nothing leaves: those are in no cycle."""
    for _ in range(rounds):
        edges = edges.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        edges = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst")
    return edges


@tidy("strong")
def strongly_connected(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """``edges`` (src, dst) -> (node, root): root is the least node of a component of two or more.

    A graph of at most ``small`` edges is solved whole by one task. Of a larger one, what is left after
    trimming falls into weakly connected parts; parts of at most ``small`` edges are solved whole, one
    group each, larger ones by rounds of colours.
    """
    work = materialize(edges.where("src <> dst").select("src", "dst").distinct(), "scc")
    kind = dict(work.dtypes)["src"]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        found = tarjan(zip(pdf["src"], pdf["dst"]))
        return pd.DataFrame([(node, min(part)) for part in found for node in part], columns=["node", "root"])

    def solved(parts: DataFrame) -> DataFrame:
        return parts.groupBy("component").applyInPandas(solve, f"node {kind}, root {kind}")

    if work.limit(small + 1).count() <= small:
        return solved(work.coalesce(1).withColumn("component", F.lit(0)))
    work = materialize(trimmed(work), "scc")
    parts = materialize(connected_components(work.select(F.col("src").alias("a"), F.col("dst").alias("b"))), "scc")
    work = work.join(parts.withColumnRenamed("node", "src"), "src")
    size = work.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    work = materialize(work.join(size, "component"), "scc")
    out = solved(work.where(F.col("n") <= small))
    large = work.where(F.col("n") > small).select("src", "dst")
    if not large.isEmpty():
        out = out.unionByName(coloured(large))
    return out


@tidy("reached")
def least_reaching(edges: DataFrame, nodes: DataFrame, rounds: int = 10_000) -> DataFrame:
    """(node, least): the least of the ``nodes`` (node) that reach each node along ``edges`` (src, dst), itself included.

    Each round pushes what is known one step along the edges, then twice takes over what is known of the
    node found so far: whatever reaches that reaches this one. With numbers in random order a path of n
    steps is crossed in a small multiple of log n rounds.
    """
    tables = Rounds(edges.sparkSession, "reached")
    known = tables.keep(nodes.select("node", F.col("node").alias("least"), F.lit(True).alias("moved")))
    for _ in range(rounds):
        pushed = edges.join(known.select(F.col("node").alias("src"), "least"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("least").alias("pushed"))
        step = known.select("node", F.col("least").alias("old")).join(pushed, "node", "left").withColumn("near", F.least("old", "pushed"))
        # jumps go by what was known before the push, which is right at any time
        for _ in range(2):
            step = step.join(known.select(F.col("node").alias("near"), F.col("least").alias("far")), "near").select("node", "old", F.least("near", "far").alias("near"))
        known = tables.keep(step.select("node", F.col("near").alias("least"), (F.col("near") < F.col("old")).alias("moved")))
        if known.where("moved").isEmpty():
            return known.select("node", "least")
    raise RuntimeError("reachability did not settle")


@tidy("coloured")
def coloured(edges: DataFrame, rounds: int = 10_000) -> DataFrame:
    """Strongly connected components of large parts, by forward colours and backward reach.

    Each round gives every node the least node that reaches it, its colour. A component that holds the
    least node of its colour is that of the colour's nodes which reach that node, and the way there is
    through nodes of the colour. Those components are done; edges between colours are in none.
    """
    spark = edges.sparkSession
    left = Rounds(spark, "left")
    done: list[DataFrame] = []
    # nodes get numbers in random order, and the least number of a component is its name until the end
    names = edges.select(F.col("src").alias("name")).unionByName(edges.select(F.col("dst").alias("name"))).distinct()
    names = names.repartition(F.xxhash64("name")).sortWithinPartitions(F.xxhash64("name", F.lit(3)))
    names = materialize(names.withColumn("number", F.monotonically_increasing_id()), "names")
    rest = edges.distinct().join(names.toDF("src", "s"), "src").join(names.toDF("dst", "d"), "dst")
    rest = left.keep(rest.select(F.col("s").alias("src"), F.col("d").alias("dst")))
    for _ in range(rounds):
        rest = left.keep(trimmed(rest, 1))
        if rest.isEmpty():
            break
        nodes = rest.select(F.col("src").alias("node")).unionByName(rest.select(F.col("dst").alias("node"))).distinct()
        colour = least_reaching(rest, nodes)
        inside = rest.join(colour.select(F.col("node").alias("src"), F.col("least").alias("cs")), "src").join(colour.select(F.col("node").alias("dst"), F.col("least").alias("cd")), "dst")
        inside = materialize(inside.where("cs = cd").select("src", "dst"), "inside")
        back = least_reaching(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")), nodes)
        found = colour.withColumnRenamed("least", "root").join(back.withColumnRenamed("least", "reaches"), "node").where("root = reaches").select("node", "root")
        done.append(materialize(found, "coloured"))
        rest = left.keep(inside.join(done[-1].select(F.col("node").alias("src")), "src", "left_anti").join(done[-1].select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"))
    else:
        raise RuntimeError("strongly connected components did not settle")
    if not done:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("root")).limit(0)
    every = spark.read.schema(done[0].schema).parquet(*(f for d in done for f in d.inputFiles()))
    named = every.join(names.toDF("name", "node"), "node")
    roots = named.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("least")).where("n > 1").select("root", "least")
    return named.join(roots, "root").select(F.col("name").alias("node"), F.col("least").alias("root"))


def cycles(edges: DataFrame, scope: str) -> DataFrame:
    """scope, root, size, members (sorted, comma-joined) of each cycle group; a row holds the names of one component."""
    found = strongly_connected(edges)
    rows = found.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.array_join(F.array_sort(F.collect_set("node")), ",").alias("members"))
    return rows.select(F.lit(scope).alias("scope"), "root", "size", "members")
