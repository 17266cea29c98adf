"""Hand-computed values of the metric formulas and their empty cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from strataline.operators import components, evidence, metrics
from strataline.plans.graph import Graph, encode
from strataline.schema import EDGES, NODES

TYPE = dict(kind="Class", is_abstract=False, fields=[], depends=[])


def graph(spark, types, methods=(), edges=(), projects=("p",)):
    """types: (full name, kind, abstract, fields, depends_on); methods: (type, name, params, sloc, dp, nesting, calls, public, accessed)."""
    nodes, links = [], []
    for p in projects:
        nodes.append((p, "Project", p, {}, None))
    for ns in sorted({t[0].rpartition(".")[0] for t in types}):
        nodes.append((f"ns:{ns}", "Namespace", ns, {}, None))
        links.append((projects[0], f"ns:{ns}", "Contains"))
    for name, kind, abstract, fields, depends in types:
        nodes.append((f"t:{name}", "Type", name, {"typeKind": kind, "isAbstract": str(abstract), "fieldNames": json.dumps(fields), "dependsOnTypes": json.dumps(depends)}, None))
        links.append((f"ns:{name.rpartition('.')[0]}", f"t:{name}", "Contains"))
    for owner, name, params, sloc, dp, nesting, calls, public, accessed in methods:
        nodes.append((f"m:{owner}.{name}", "Method", name, {"parameters": str(params), "sloc": str(sloc), "decisionPoints": str(dp), "maxNestingDepth": str(nesting), "calls": str(calls), "isPublic": str(public), "accessedFields": json.dumps(accessed)}, None))
        links.append((f"t:{owner}", f"m:{owner}.{name}", "Contains"))
    links += [(f"t:{a}", f"t:{b}", "ReferencesType") for a, b in edges]
    return Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame([(a, b, k, None, {}, None, 1.0) for a, b, k in links], EDGES))


def by(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


def test_single_type(spark):
    g = graph(spark, [("N1.T1", "Class", False, ["F1", "F2"], ["N1.T2", "System.String"]), ("N1.T2", "Class", False, [], [])],
              [("N1.T1", "M1", 0, 10, 2, 1, 0, True, ["F1"]), ("N1.T1", "M2", 0, 5, 0, 0, 0, False, ["F1"])], [("N1.T1", "N1.T2")])
    t = by(metrics.type_metrics(g.model()), "type_id")["t:N1.T1"]
    assert (t["sloc"], t["nom"], t["npm"], t["wmc"], t["dep"], t["i_dep"], t["fan_out"], t["fan_in"], t["noa"], t["lcom3"]) == (15, 2, 1, 4, 2, 1, 1, 0, 2, 0.5)
    empty = by(metrics.type_metrics(g.model()), "type_id")["t:N1.T2"]
    assert (empty["sloc"], empty["nom"], empty["dep"], empty["fan_in"], empty["lcom3"]) == (0, 0, 0, 1, 0.0)


def test_negative_counts_are_clamped_method_by_method(spark):
    g = graph(spark, [("N.T", "Class", False, [], [])], [("N.T", "A", 1, -5, -3, -1, -1, True, []), ("N.T", "B", 2, 7, 3, 2, 5, True, [])])
    t = by(metrics.type_metrics(g.model()), "type_id")["t:N.T"]
    assert (t["sloc"], t["wmc"]) == (7, 5)
    m = by(metrics.method_metrics(g.model().methods), "method_id")
    assert tuple(m["m:N.T.B"].values())[1:] == (7, 4, 5, 2, 2)
    assert tuple(m["m:N.T.A"].values())[1:] == (0, 1, 0, 0, 1)


def test_coupling(spark):
    g = graph(spark, [("N1.A", "Class", False, [], ["N1.B", "System.String"]), ("N1.B", "Class", False, [], ["N2.C"]), ("N2.C", "Class", False, [], [])],
              edges=[("N1.A", "N1.B"), ("N1.B", "N2.C")])
    t = by(metrics.type_coupling(g.model()), "type_id")
    assert [tuple(t[f"t:{k}"].values())[1:] for k in ("N1.A", "N1.B", "N2.C")] == [(2, 1, 0, 1), (1, 1, 1, 1), (0, 0, 1, 0)]
    n = by(metrics.namespace_coupling(g.model()), "namespace")
    assert [(n[k]["ca"], n[k]["ce"], n[k]["i"], n[k]["a"], n[k]["d"]) for k in ("N1", "N2")] == [(0, 1, 1.0, 0.0, 0.0), (1, 0, 0.0, 0.0, 1.0)]


def test_cycles_and_totals(spark):
    g = graph(spark, [("N1.A", "Class", False, [], ["N1.B", "N2.C", "System.String", " "]), ("N1.B", "Class", False, [], ["N1.A"]), ("N2.C", "Class", False, [], ["N1.A"])],
              edges=[("N1.A", "N1.B"), ("N1.A", "N2.C"), ("N1.B", "N1.A"), ("N2.C", "N1.A"), ("N1.A", "N1.A")])
    m = g.model()
    assert metrics.dependency_totals(m).first().asDict() == {"total_deps": 5, "internal_deps": 4}
    assert [r["members"] for r in components.cycles(m.type_edges, "Type").collect()] == ["N1.A,N1.B,N2.C"]
    spaces = m.namespace_edges().select(F.col("src_ns").alias("src"), F.col("dst_ns").alias("dst"))
    assert [r["members"] for r in components.cycles(spaces, "Namespace").collect()] == ["N1,N2"]


def test_namespaces(spark):
    g = graph(spark, [("N1.A", "Class", True, [], []), ("N1.B", "Record", True, [], []), ("N1.I", "Interface", True, [], []), ("N2.S", "Struct", False, [], []), ("N2.E", "Enum", False, [], [])])
    n = by(metrics.namespace_counts(g.model()), "namespace")
    assert [(n[k]["noc"], n[k]["nac"]) for k in ("N1", "N2")] == [(3, 2), (2, 0)]


def test_summary(spark):
    types = [(f"N{1 + k // 2}.T{k}", "Class", False, [], []) for k in range(3)]
    methods = [("N1.T0", "a", 0, 5, 0, 0, 0, True, []), ("N1.T0", "b", 0, 5, 1, 0, 0, True, []), *[("N1.T1", c, 0, s, d, 0, 0, True, []) for c, s, d in (("a", 10, 2), ("b", 5, 0), ("c", 5, 0))], ("N2.T2", "a", 0, 30, 1, 0, 0, True, [])]
    s = metrics.summary(graph(spark, types, methods).model()).first().asDict()
    assert (s["total_namespaces"], s["total_types"], s["mean_types_per_namespace"], s["total_sloc"], s["avg_sloc"], s["median_sloc"], s["total_methods"], s["avg_methods"], s["total_complexity"], s["median_complexity"]) == (2, 3, 1.5, 60, 20.0, 20.0, 6, 2.0, 10, 3.0)
    assert s["stddev_sloc"] == pytest.approx(8.16496580) and s["stddev_methods"] == pytest.approx(0.81649658) and s["stddev_complexity"] == pytest.approx(1.2472191)


def test_empty_graph(spark):
    g = Graph(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES))
    assert set(metrics.summary(g.model()).first().asDict().values()) == {0}
    assert metrics.dependency_totals(g.model()).first().asDict() == {"total_deps": 0, "internal_deps": 0}
    assert components.cycles(g.model().type_edges, "Type").count() == 0
    assert metrics.type_metrics(g.model()).count() == 0


def test_method_counts_agree(spark):
    g = graph(spark, [("N.A", "Class", False, [], []), ("N.B", "Class", False, [], [])], [("N.A", "x", 0, 1, 0, 0, 0, True, []), ("N.B", "y", 0, 1, 0, 0, 0, True, [])])
    m = g.model()
    n = g.of_kind("Method").count()
    assert n == metrics.method_metrics(m.methods).count() == metrics.summary(m).first()["total_methods"] == metrics.type_metrics(m).agg(F.sum("nom")).first()[0]


def test_bad_attributes_read_as_nothing(spark):
    rows = [("p", "Project", "p", {}, None), ("n", "Namespace", "", {}, None), ("t", "Type", "T", {"typeKind": "Widget", "isAbstract": "yes", "fieldNames": "{bad", "dependsOnTypes": None}, None), ("m", "Method", "M", {"sloc": "x", "isPublic": "TRUE"}, None)]
    links = [("p", "n", "Contains", None, {}, None, 1.0), ("n", "t", "Contains", None, {}, None, 1.0), ("n", "t", "Contains", None, {}, None, 1.0), ("t", "m", "Contains", None, {}, None, 1.0), ("t", "gone", "ReferencesType", None, {}, None, 1.0)]
    m = Graph(spark.createDataFrame(rows, NODES), spark.createDataFrame(links, EDGES)).model()
    t = m.types.first()
    assert (t["kind"], t["is_abstract"], t["fields"], t["depends_on"], m.types.count(), m.type_edges.count()) == ("Class", False, [], [], 1, 0)
    assert m.methods.first()["sloc"] == 0 and m.methods.first()["is_public"]


def test_encoded_model_reads_back(spark):
    g = graph(spark, [("N1.A", "Class", True, ["f"], ["N1.B"]), ("N1.B", "Struct", False, [], [])], [("N1.A", "x", 1, 4, 2, 1, 3, True, ["f"])], [("N1.A", "N1.B")])
    a, b = metrics.type_metrics(g.model()), metrics.type_metrics(encode(g.model()).model())
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_statistics(spark):
    def four(values):
        return tuple(spark.createDataFrame([(float(v),) for v in values], "v double").agg(*metrics.statistics("v")).first())

    assert four([2, 4, 4, 4, 5, 5, 7, 9])[2] == 2 and four([2, 4, 4, 4, 5, 5, 7, 9])[3] == pytest.approx(2.138089935)
    assert four([4, 1, 2, 3])[:2] == (2.5, 2.5) and four([9, 1, 5])[1] == 5
    assert four([]) == (0, 0, 0, 0) and four([3])[2:] == (0, 0)


def test_strong_components_by_either_way(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 7), (7, 8), (8, 8), (9, 1)]
    df = spark.createDataFrame(edges, "src bigint, dst bigint")
    want = {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}
    assert {tuple(r) for r in components.strongly_connected(df).collect()} == want
    assert {tuple(r) for r in components.strongly_connected(df, small=0).collect()} == want


def test_connected_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 9), (1, 2), (3, 3), (None, 1), (9, 8), (2, 1)], "a bigint, b bigint")
    assert {tuple(r) for r in components.connected_components(edges).collect()} == {(4, 4), (5, 4), (8, 4), (9, 4), (1, 1), (2, 1)}
    assert components.connected_components(edges.limit(0)).count() == 0


def test_few_edges_are_solved_without_rounds(spark, monkeypatch):
    r = random.Random(5)
    path = r.sample(range(10**6), 300)  # a long path in random order, beside random parts
    edges = [*zip(path, path[1:]), *((r.randrange(-400, 0), r.randrange(-400, 0)) for _ in range(250)), (None, 3), (7, 7)]
    df = spark.createDataFrame(edges, "a bigint, b bigint").repartition(5)
    by_rounds = {tuple(x) for x in components.connected_components(df, small=0).collect()}
    named = df.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"))
    names_by_rounds = {tuple(x) for x in components.connected_components(named, small=0).collect()}
    monkeypatch.setattr(components.F, "explode", None)  # what rounds need
    assert {tuple(x) for x in components.connected_components(df).collect()} == by_rounds
    assert {tuple(x) for x in components.connected_components(named).collect()} == names_by_rounds
    assert len(by_rounds) > 300 and len({c for _, c in by_rounds if c >= 0}) == 1


def test_confidence_is_clamped_at_every_step(spark):
    rows = [("a", 1, 0.9), ("a", 2, 0.9), ("a", 3, -0.5), ("b", 1, -1.0), ("b", 2, 0.2), ("c", 1, -0.1)]
    got = by(evidence.confidence(spark.createDataFrame(rows, "k string, o int, w double"), "k", ["o"], "w"), "k")
    assert {k: round(v["confidence"], 6) for k, v in got.items()} == {"a": 0.5, "b": 0.2}

    chunked = by(evidence.confidence(spark.createDataFrame(rows, "k string, o int, w double"), "k", ["o"], "w", F.col("o")), "k")
    assert {k: round(v["confidence"], 6) for k, v in chunked.items()} == {"a": 0.5, "b": 0.2}


def test_confidence_is_the_double_that_single_steps_give(spark):
    r = random.Random(4)
    weights = {k: [r.choice((-0.3, 0.6, 0.2, 0.05, 0.05, 0.05)) for _ in range(r.choice((3, 8, 40)))] for k in range(200)}
    weights[-1] = [0.05, 0.05, 0.2, -0.3]  # a rest of 5.6e-17 stays, so the row does
    rows = [(k, o, w) for k, ws in weights.items() for o, w in enumerate(ws)]
    rows += [(-2, 1, 0.9), (-2, None, -0.4), (-2, 2, 0.9)]  # what has no place comes last, as in SQL
    weights[-2] = [0.9, 0.9, -0.4]
    want = {}
    for k, ws in weights.items():
        x = 0.0
        for w in ws:
            x = min(1.0, max(0.0, x + w))
        if x > 0:
            want[k] = x
    df = spark.createDataFrame(rows, "k int, o int, w double")
    for chunk in (None, F.floor(F.col("o") / 3), F.col("o")):
        assert {x["k"]: x["confidence"] for x in evidence.confidence(df, "k", ["o"], "w", chunk).collect()} == want


def test_evidence_order(spark):
    rows = [("k", "ConfigKey", "b", 2, "x"), ("k", "ConfigKey", "b", None, "x"), ("k", "Invocation", None, None, "y"), ("k", "ConfigKey", "b", 2, "x")]
    got = evidence.distinct_evidence(spark.createDataFrame(rows, "k string, kind string, file_path string, line int, details string"), "k").orderBy("position").collect()
    assert [(r["kind"], r["line"]) for r in got] == [("Invocation", None), ("ConfigKey", None), ("ConfigKey", 2)]


def test_registered_metric(spark):
    g = graph(spark, [("N.A", "Class", False, ["f", "g"], [])])
    metrics.register_metric("fields_squared", lambda m: m.types.select("type_id", (F.size("fields") * F.size("fields")).alias("fields_squared")))
    try:
        assert metrics.type_metrics(g.model()).first()["fields_squared"] == 4
    finally:
        metrics.EXTRA.clear()


def test_snapshots_do_not_mix(spark):
    from strataline.plans.graph import batched, snapshot_of, without_snapshot

    one = graph(spark, [("N.A", "Class", False, ["f"], ["N.B"]), ("N.B", "Class", False, [], [" "])], [("N.A", "m", 0, 3, 1, 0, 0, True, [])], [("N.A", "N.B")])
    two = Graph(*(df.withColumn("snapshot_id", F.explode(F.array(F.lit("x"), F.lit("y|z")))) for df in (one.nodes, one.edges)))
    rows = metrics.type_metrics(batched(two).model()).withColumn("s", snapshot_of("type_id")).withColumn("type_id", without_snapshot("type_id"))
    alone = {r["type_id"]: tuple(r) for r in metrics.type_metrics(one.model()).collect()}
    got = {(r["s"], r["type_id"]): tuple(r)[:-1] for r in rows.collect()}
    assert got == {(s, k): v for s in ("x", "y_z") for k, v in alone.items()}
    assert metrics.namespace_counts(batched(two).model()).count() == 2


def test_rings_are_solved_in_few_rounds(spark, monkeypatch):
    rounds = []
    real = components.Rounds.keep
    monkeypatch.setattr(components.Rounds, "keep", lambda self, df: rounds.append(1) or real(self, df))
    n = 64
    rows = [(f"n{k:03d}", f"n{(k + 1) % n:03d}") for k in range(n)] + [("a", "n000"), ("n000", "z"), ("b", "c"), ("c", "b")]
    edges = spark.createDataFrame(rows, "src string, dst string")
    want = {(f"n{k:03d}", "n000") for k in range(n)} | {("b", "b"), ("c", "b")}
    assert {tuple(r) for r in components.coloured(edges).collect()} == want and len(rounds) < 50
    assert {tuple(r) for r in components.strongly_connected(edges).collect()} == want


def test_repeated_containment_counts_again(spark):
    from strataline.operators import metrics
    from strataline.plans.graph import Graph

    kinds = {"p": "Project", "q": "Project", "n": "Namespace", "t": "Type", "m": "Method"}
    nodes = spark.createDataFrame([(i, k, i, {}, None) for i, k in kinds.items()], "id string, kind string, name string, attributes map<string,string>, evidence string")
    edges = [("p", "n"), ("p", "n"), ("n", "t"), ("t", "m"), ("t", "m"), ("t", "m")]
    edges = spark.createDataFrame([(a, b, "Contains") for a, b in edges], "from_id string, to_id string, kind string")
    rows = {tuple(r) for r in metrics.project_counts(Graph(nodes, edges).model()).collect()}
    assert rows == {("p", "p", 2, 2, 6), ("q", "q", 0, 0, 0)}
