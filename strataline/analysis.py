"""From a source tree or an exported graph to metrics, integrations and reports."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import session
from .operators import components, integrations
from .operators.usage import first_parents, rolled_up
from .plans.graph import Graph, Model
from .sources import csharp, files, graph_json, settings
from .store import materialize


@dataclass(frozen=True)
class Snapshot:
    """One analysis: tables, computed when they are read."""

    graph: Graph
    model: Model
    candidates: DataFrame
    generated_at: datetime = field(default_factory=lambda: datetime.now(timezone.utc))

    def cycles(self) -> DataFrame:
        """Cycle groups of types, then of namespaces."""
        spaces = self.model.namespace_edges().select(F.col("src_ns").alias("src"), F.col("dst_ns").alias("dst"))
        return components.cycles(self.model.type_edges, "Type").unionByName(components.cycles(spaces, "Namespace"))

    def usage(self) -> DataFrame:
        """level, node_id, candidates: what methods use, rolled up to types, namespaces and projects."""
        # edges that keep no order count by their names
        order = F.col("position") if "position" in self.graph.edges.columns else F.lit(0).alias("position")
        contains = first_parents(self.graph.edges.where("kind = 'Contains'").select(F.col("from_id").alias("parent_id"), F.col("to_id").alias("child_id"), order))
        use = integrations.usage(self.candidates).select("node_id", "candidate_id")
        of_types = use.join(self.graph.of_kind("Type").select(F.col("id").alias("node_id")), "node_id", "left_semi")
        rows = rolled_up(use, [contains] * 3)
        # a type's own usage goes up beside its methods'
        above = rolled_up(of_types, [contains] * 3)
        shifted = {"method": "type", "type": "namespace", "namespace": "project"}
        above = above.where("level <> 'project'").withColumn("level", F.try_element_at(F.create_map(*[F.lit(x) for kv in shifted.items() for x in kv]), F.col("level")))
        kinds = self.graph.nodes.select(F.col("id").alias("node_id"), F.lower("kind").alias("kind"))
        both = rows.unionByName(above).join(kinds, "node_id").where((F.col("level") == F.col("kind")) | ((F.col("level") == "method") & (F.col("kind") == "type")))
        return both.groupBy("level", "node_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("candidates")))).alias("candidates"))


def snapshot(graph: Graph, signals: DataFrame | None = None, profile: str | None = "work") -> Snapshot:
    """Metrics and integrations of a graph; ``signals`` are those of its files."""
    every = integrations.graph_signals(graph.nodes if "snapshot_id" in graph.nodes.columns else graph.nodes.withColumn("snapshot_id", F.lit("")))
    if signals is not None:
        every = every.unionByName(signals)
    kinds, _ = integrations.profile(profile)
    found = integrations.in_profile(integrations.detect(every, kinds), profile)
    return Snapshot(graph, graph.model(), materialize(found, "candidates"))


def analyze(spark: SparkSession, path: str | None = None, repo_url: str | None = None, profile: str | None = "work", exclude: tuple[str, ...] = files.DEFAULT_EXCLUDES) -> Snapshot:
    """A source tree, a solution or project (its folder), an archive, an exported ``.json`` graph, or a repository to clone (``owner/repo`` too)."""
    files.check_request(path, repo_url)
    session.prepare(spark)
    integrations.profile(profile)
    path, repo_url = files.meant(spark, path, repo_url)
    if repo_url:
        with files.workdir() as folder:
            return _tree(spark, files.clone(repo_url, os.path.join(folder, "repo")), profile, exclude)
    if path.lower().endswith(".zip") and os.path.isfile(path):
        with files.workdir() as folder, open(path, "rb") as archive:
            files.unzip(archive.read(), folder)
            inside = os.listdir(folder)  # archives of repositories hold one folder
            root = os.path.join(folder, inside[0]) if len(inside) == 1 and os.path.isdir(os.path.join(folder, inside[0])) else folder
            return _tree(spark, root, profile, exclude)
    if path.lower().endswith(".json"):
        return snapshot(graph_json.read(spark, path), profile=profile)
    return _tree(spark, path, profile, exclude)


def _tree(spark: SparkSession, root: str, profile: str | None, exclude: tuple[str, ...]) -> Snapshot:
    if not os.path.isdir(root):
        raise FileNotFoundError(root)
    every = files.tree(spark, root, exclude=exclude)
    language = files.detected_language(every.select("path", F.lit(1).alias("all")), "all").first()
    if language is None or language["language"] is None:
        raise NotImplementedError("the files are of no language, or of more than one")
    if language["language"] != "csharp":
        raise NotImplementedError(f"no adapter reads {language['language']}")
    texts = files.texts(every.where(F.lower("path").endswith(".cs")))
    projects = every.where(F.lower("path").endswith(".csproj")).select(F.col("path").alias("project"))
    files.check_loaded(projects.limit(1).count() + texts.limit(1).count(), ["no project and no source file"], root)
    graph = csharp.tree_graph(texts, projects, os.path.basename(os.path.abspath(root)))
    graph = Graph(materialize(graph.nodes, "nodes"), materialize(graph.edges, "edges"))
    tag = F.lit("").alias("snapshot_id")
    signals = integrations.config_signals(settings.configuration(every).select(tag, "*")).unionByName(integrations.package_signals(settings.packages(every).select(tag, "*")))
    return snapshot(graph, signals, profile)


LANGUAGES = ("csharp",)
