"""The code graph as two tables, and the relational views that the metrics read.

Nodes are keyed by id, dependency edges by name: a full name that stands in two projects
is one end of an edge and two rows of metrics.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import extract_namespace, json_list, parse_bool, parse_int
from ..schema import TYPE_KINDS


@dataclass(frozen=True)
class Model:
    """projects(project_id, name); namespaces(project_id, ns_id, ns_name);
    types(project_id, ns_id, type_id, full_name, kind, is_abstract, fields, depends_on);
    methods(type_id, method_id, full_name, parameters, sloc, decision_points, max_nesting, calls, is_public, accessed_fields);
    type_edges(src, dst), distinct names; all_methods(method_id), those that no type contains included.
    """

    projects: DataFrame
    namespaces: DataFrame
    types: DataFrame
    methods: DataFrame
    type_edges: DataFrame
    all_methods: DataFrame | None = None
    #: project_id, namespaces, types, methods counted along every containment edge, repeated ones each time; None: as often as the tables hold them.
    counts: DataFrame | None = None

    def namespace_edges(self) -> DataFrame:
        """The quotient of the type edges by the namespace in their names, without loops."""
        ends = self.type_edges.select(extract_namespace(F.col("src")).alias("src_ns"), extract_namespace(F.col("dst")).alias("dst_ns"))
        return ends.where("src_ns <> dst_ns").distinct()


@dataclass(frozen=True)
class Graph:
    """nodes(id, kind, name, attributes, evidence) and edges(from_id, to_id, kind, label, attributes, evidence, confidence)."""

    nodes: DataFrame
    edges: DataFrame

    def contains(self) -> DataFrame:
        return self.edges.where("kind = 'Contains'").select(F.col("from_id").alias("parent_id"), F.col("to_id").alias("child_id")).distinct()

    def counts(self) -> DataFrame:
        """project_id and what it holds, along containment edges as they stand: a repeated edge counts again."""
        edges = self.edges.where("kind = 'Contains'").groupBy(F.col("from_id").alias("parent"), F.col("to_id").alias("child")).agg(F.count(F.lit(1)).alias("m"))
        reached = self.of_kind("Project").select(F.col("id").alias("project_id"), F.col("id").alias("parent"), F.lit(1).cast("bigint").alias("ways"))
        out = reached.select("project_id")
        for kind, name in (("Namespace", "namespaces"), ("Type", "types"), ("Method", "methods")):
            below = reached.join(edges, "parent").join(self.of_kind(kind).select(F.col("id").alias("child")), "child", "left_semi")
            reached = below.groupBy("project_id", F.col("child").alias("parent")).agg(F.sum(F.col("ways") * F.col("m")).alias("ways"))
            out = out.join(reached.groupBy("project_id").agg(F.sum("ways").alias(name)), "project_id", "left")
        return out

    def of_kind(self, kind: str) -> DataFrame:
        return self.nodes.where(F.col("kind") == kind)

    def model(self) -> Model:
        """The views, by fixed-depth joins down the containment and typed readings of the attributes."""
        contains, a = self.contains(), F.col("attributes")

        def children(parents: DataFrame, key: str, kind: str, child: str) -> DataFrame:
            below = contains.withColumnRenamed("parent_id", key).withColumnRenamed("child_id", child)
            return parents.select(key).join(below, key).join(self.of_kind(kind).withColumnRenamed("id", child), child)

        projects = self.of_kind("Project").select(F.col("id").alias("project_id"), "name")
        namespaces = children(projects, "project_id", "Namespace", "ns_id").select("project_id", "ns_id", F.coalesce("name", F.lit("")).alias("ns_name"))
        kind = F.coalesce(F.get(F.filter(F.array(*map(F.lit, TYPE_KINDS)), lambda k: F.lower(k) == F.lower(F.trim(a["typeKind"]))), 0), F.lit("Class"))
        types = children(namespaces, "ns_id", "Type", "type_id").select(
            "ns_id", "type_id", F.col("name").alias("full_name"), kind.alias("kind"), parse_bool(a["isAbstract"]).alias("is_abstract"),
            json_list(a["fieldNames"]).alias("fields"), json_list(a["dependsOnTypes"]).alias("depends_on"))
        methods = children(types, "type_id", "Method", "method_id").select(
            "type_id", "method_id", F.col("name").alias("full_name"), parse_int(a["parameters"]).alias("parameters"), parse_int(a["sloc"]).alias("sloc"),
            parse_int(a["decisionPoints"]).alias("decision_points"), parse_int(a["maxNestingDepth"]).alias("max_nesting"), parse_int(a["calls"]).alias("calls"),
            parse_bool(a["isPublic"]).alias("is_public"), json_list(a["accessedFields"]).alias("accessed_fields"))
        named = self.of_kind("Type").select("id", "name")
        edges = self.edges.where("kind = 'ReferencesType'").select("from_id", "to_id")
        edges = edges.join(named.select(F.col("id").alias("from_id"), F.col("name").alias("src")), "from_id")
        edges = edges.join(named.select(F.col("id").alias("to_id"), F.col("name").alias("dst")), "to_id").select("src", "dst").distinct()
        return Model(projects, namespaces, namespaces.select("project_id", "ns_id").join(types, "ns_id"), methods, edges, self.of_kind("Method").select(F.col("id").alias("method_id")), self.counts())


MARK = "|"


def batched(graph: Graph) -> Graph:
    """Many snapshots as one graph: ids and type and namespace names get their ``snapshot_id`` before them.

    All metrics then run over any number of repositories in one plan, and ``snapshot_of``
    tells the rows of the results apart.
    """
    tag = F.concat(F.replace("snapshot_id", F.lit(MARK), F.lit("_")), F.lit(MARK))
    depends = F.expr(f"transform_values(attributes, (k, v) -> if(k = 'dependsOnTypes', to_json(transform(from_json(v, 'array<string>'), x -> if(trim(x) = '', x, concat(replace(snapshot_id, '{MARK}', '_'), '{MARK}', x)))), v))")
    nodes = graph.nodes.select("snapshot_id", F.concat(tag, "id").alias("id"), "kind", F.when(F.col("kind").isin("Type", "Namespace"), F.concat(tag, "name")).otherwise(F.col("name")).alias("name"), depends.alias("attributes"), "evidence")
    edges = graph.edges.withColumn("from_id", F.concat(tag, "from_id")).withColumn("to_id", F.concat(tag, "to_id"))
    return Graph(nodes, edges)


def snapshot_of(column: str) -> Column:
    return F.substring_index(column, MARK, 1)


def without_snapshot(column: str) -> Column:
    return F.expr(f"substr({column}, instr({column}, '{MARK}') + 1)")


def encode(model: Model) -> Graph:
    """A model as nodes and edges with string attributes, the form in which graphs are exchanged."""
    none = F.create_map().cast("map<string,string>")

    def node(df: DataFrame, id_: str, kind: str, name: str, attributes=none) -> DataFrame:
        return df.select(F.col(id_).alias("id"), F.lit(kind).alias("kind"), F.col(name).alias("name"), attributes.alias("attributes"), F.lit(None).cast("string").alias("evidence"))

    def text(c: str):
        return F.when(F.col(c), "True").otherwise("False") if c.startswith("is_") else F.col(c).cast("string")

    def as_map(**columns):
        return F.create_map(*[x for k, v in columns.items() for x in (F.lit(k), v)])

    types = node(model.types, "type_id", "Type", "full_name", as_map(
        typeKind=F.col("kind"), isAbstract=text("is_abstract"), fieldNames=F.to_json("fields"), dependsOnTypes=F.to_json("depends_on")))
    methods = node(model.methods, "method_id", "Method", "full_name", as_map(
        parameters=text("parameters"), sloc=text("sloc"), decisionPoints=text("decision_points"), maxNestingDepth=text("max_nesting"),
        calls=text("calls"), isPublic=text("is_public"), accessedFields=F.to_json("accessed_fields")))
    nodes = node(model.projects, "project_id", "Project", "name").unionByName(node(model.namespaces, "ns_id", "Namespace", "ns_name")).unionByName(types).unionByName(methods)

    def edge(df: DataFrame, a: str, b: str, kind: str) -> DataFrame:
        null = F.lit(None).cast("string")
        return df.select(F.col(a).alias("from_id"), F.col(b).alias("to_id"), F.lit(kind).alias("kind"), null.alias("label"), none.alias("attributes"), null.alias("evidence"), F.lit(1.0).alias("confidence"))

    ids = model.types.select("type_id", "full_name")
    references = model.type_edges.join(ids.select(F.col("full_name").alias("src"), F.col("type_id").alias("a")), "src").join(ids.select(F.col("full_name").alias("dst"), F.col("type_id").alias("b")), "dst")
    edges = (edge(model.namespaces, "project_id", "ns_id", "Contains").unionByName(edge(model.types, "ns_id", "type_id", "Contains"))
             .unionByName(edge(model.methods, "type_id", "method_id", "Contains")).unionByName(edge(references, "a", "b", "ReferencesType")))
    return Graph(nodes, edges)
