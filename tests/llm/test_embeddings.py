import numpy as np
import pytest
from pyspark.sql import functions as F

from strataline.llm import embedding_dedup as E


def brute(rows):
    good = [(i, l, np.array(v, float)) for i, l, v in rows if l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    near = {k: [] for k in range(len(good))}
    for a in range(len(good)):
        for b in range(len(good)):
            if a != b and good[a][1] == good[b][1] and len(good[a][2]) == len(good[b][2]):
                x, y = good[a][2], good[b][2]
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                    near[a].append(b)
    out = {(i, 0, i, True) for i, l, v in rows if i is not None and i not in {g[0] for g in good}}
    for a, (i, _, _) in enumerate(good):
        seen, todo = {a}, [a]
        while todo:
            for b in near[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        least = min(good[b][0] for b in seen)
        out.add((i, len(near[a]), least, i == least))
    return out


@pytest.mark.parametrize("block", [1024, 16])
def test_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(E, "BLOCK", block)
    rng = np.random.default_rng(8)
    rows = []
    for label in (0, 1):
        for _ in range(14):
            base = rng.standard_normal(32)
            for noise in (0, 0, 0.15, 0.25, 0.4):
                rows.append((len(rows), label, [float(np.float32(x)) for x in base + noise * rng.standard_normal(32)]))
    rows += [(900, 0, rows[0][2]), (901, None, rows[0][2]), (902, 0, None), (903, 0, [0.0] * 32), (904, 0, [float("nan")] * 32), (905, 0, [1.0, None]), (906, 0, [float("inf")] + [1.0] * 31), (907, 0, []), (908, 0, [1.0, 2.0]), (909, 0, [2.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").withColumn("rep", F.lit(1)).repartition(3)
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in E.near_duplicates(df).collect()} == brute(rows)


def test_repeated_rows_and_empty_table(spark):
    v = [1.0, 2.0, 3.0]
    df = spark.createDataFrame([(1, 0, v), (1, 0, v), (None, 0, v), (2, 0, [-1.0, 0.0, 0.0])], "vec_id bigint, label int, embedding array<float>")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in E.near_duplicates(df).collect()), key=str)
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True), (None, 2, 1, False)]
    assert E.near_duplicates(df.limit(0)).count() == 0


def test_bounds_hold_and_estimates_are_unbiased():
    rng = np.random.default_rng(2)
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (rng.standard_normal((300, 64)), rng.standard_normal((200, 64))))
    codes, factor = E.encode(x)
    for threshold in (-0.3, 0.0, 0.2):
        assert not ((x @ y.T >= threshold) & ~E.within_reach(codes, factor, y, threshold)).any()
    t = E.signs(codes, 64) @ (y @ E.rotation(64).T).astype(np.float32).T
    assert abs((t / factor[:, None] - x @ y.T).mean()) < 0.005


def reachable(rows):
    """(vec_id, n_links, component_id, kept) with rows as nodes, and rows that repeat a vec_id connected."""
    good = [k for k, (_, l, v) in enumerate(rows) if l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = {k: np.array(rows[k][2], float) / np.linalg.norm(rows[k][2]) for k in good}
    near = {k: [m for m in good if k in x and m != k and rows[m][1] == rows[k][1] and len(x[m]) == len(x[k]) and x[m] @ x[k] >= 0.93] for k in range(len(rows))}
    out = []
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            at = todo.pop()
            more = near[at] + [m for m in good if k in x and rows[at][0] is not None and rows[m][0] == rows[at][0]]
            todo += [m for m in more if m not in seen]
            seen.update(more)
        least = min((rows[m][0] for m in seen if rows[m][0] is not None), default=None)
        out.append((i, len(near[k]), least, i is not None and i == least))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [2048, 8])
def test_null_and_repeated_ids(spark, monkeypatch, block):
    monkeypatch.setattr(E, "BLOCK", block)
    rng = np.random.default_rng(11)
    rows = []
    for label in (0, 1, 2):
        for g in range(8):
            base = rng.standard_normal(24)
            for k in range(4):
                vector = [float(np.float32(x)) for x in base + 0.12 * rng.standard_normal(24)]
                rows.append((None if k % 2 else 1000 * label + 10 * g + k, label, vector))
                if k == 1:
                    rows.append((None, (label + 1) % 3, vector))  # the same vector without an id under two labels
    lonely = [float(x) for x in rng.standard_normal(24)]
    rows += [(None, 0, lonely), (None, 1, lonely), (None, None, lonely), (5, 0, [float(x) for x in rng.standard_normal(24)]), (5, 1, rows[0][2]), (5, 1, None)]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").withColumn("node", F.lit(1)).withColumn("code", F.lit("clash")).repartition(3)
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in E.near_duplicates(df).collect()), key=str) == reachable(rows)


@pytest.mark.parametrize("d", [3, 64, 300])
def test_bit_counts_are_products_with_rounded_vectors(d):
    rng = np.random.default_rng(d)
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (rng.standard_normal((70, d)), rng.standard_normal((50, d))))
    codes, _ = E.encode(x)
    q = E.rounded(y)
    numbers = sum(np.unpackbits(q.planes[:, k], axis=1).astype(float) * 2**k for k in range(E.PLANES))
    dense = q.low[:, None] + q.step[:, None] * numbers
    assert np.allclose(E.estimates(codes, q), E.signs(codes, d).astype(float) @ dense.T, atol=1e-4)
    assert np.allclose(np.linalg.norm(dense - y @ E.rotation(d).T, axis=1), q.off)


def test_no_pair_is_lost_near_the_threshold():
    rng = np.random.default_rng(3)
    base = rng.standard_normal((400, 64))
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (base, np.repeat(base, 3, axis=0) + np.tile([[0.2], [0.38], [0.42]], (400, 1)) * rng.standard_normal((1200, 64))))
    near = E.within_reach(*E.encode(x), y, 0.93)
    truth = x @ y.T >= 0.93
    assert truth.sum() > 600 and not (truth & ~near).any() and near.sum() < 0.006 * near.size


def test_few_vectors_are_read_again(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 128)
    real, counted = E.materialize, {}
    rng = np.random.default_rng(4)
    v = rng.standard_normal((1000, 64))
    v[1:4] = v[0] + 0.1 * rng.standard_normal((3, 64))
    df = spark.createDataFrame([(k, 0, [float(x) for x in row]) for k, row in enumerate(v)], "vec_id bigint, label int, embedding array<float>")

    def counting(df, stem):
        out = real(df, stem)
        counted[len(counted)] = (out.columns, out.count())
        return out

    monkeypatch.setattr(E, "materialize", counting)
    kept = {r.vec_id: (r.n_links, r.component_id) for r in E.near_duplicates(df).collect()}
    assert [kept[k] for k in range(4)] == [(3, 0)] * 4
    in_doubt = next(n for columns, n in counted.values() if columns == ["node", "block", "b1", "b2"])
    assert in_doubt < 200  # of 36 pairs of blocks with 256 rows each
