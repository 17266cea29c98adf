"""Reports of an analysis: JSON, Markdown, CSV and SARIF. Only the one-row summaries come to the driver, but for JSON exports of one snapshot."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime, timezone
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics
from ..schema import EDGE_KINDS, EVIDENCE_KINDS, INTEGRATION_KINDS, NODE_KINDS

if TYPE_CHECKING:
    from ..analysis import Snapshot

TOOL, VERSION = "strataline", "0.1"


def counts(snapshot: Snapshot) -> list[tuple[str, int]]:
    """The six counts of every tabular report, in their order."""
    order = ("Namespaces", "Types", "Methods", "Projects", "NamespaceCoupling", "TypeCoupling")
    found = {r["name"]: r["count"] for r in metrics.report_counts(snapshot.model).collect()}  # six rows
    return [(k, found[k]) for k in order]


def _title(name: str) -> str:
    return "".join(p.capitalize() for p in name.split("_"))


def csv(snapshot: Snapshot) -> str:
    return "Name,Count\n" + "".join(f"{k},{n}\n" for k, n in counts(snapshot))


def markdown(snapshot: Snapshot) -> str:
    lines = [f"# {TOOL.capitalize()} Report", "", f"> Generated at: {snapshot.generated_at.isoformat()}", "", "## Summary"]
    lines += [f"- **{_title(k)}**: {v}" for k, v in metrics.summary(snapshot.model).first().asDict().items()]
    return "\n".join([*lines, "", "## Counts", *(f"- **{k}**: {n}" for k, n in counts(snapshot))]) + "\n"


def sarif(snapshot: Snapshot) -> str:
    run = {"tool": {"driver": {"name": TOOL, "version": VERSION}}, "properties": dict(counts(snapshot)),
           "invocations": [{"executionSuccessful": True, "startTimeUtc": datetime.now(timezone.utc).isoformat()}], "results": []}
    return json.dumps({"$schema": "https://schemastore.azurewebsites.net/schemas/json/sarif-2.1.0-rtm.5.json", "version": "2.1.0", "runs": [run]}, indent=2)


def _without_nulls(x):
    if isinstance(x, dict):
        return {k: _without_nulls(v) for k, v in x.items() if v is not None}
    return [_without_nulls(v) for v in x] if isinstance(x, list) else x


def document(snapshot: Snapshot) -> dict:
    """The whole snapshot as one document: kinds as numbers, nulls left out. For one repository, not for a batch of many."""
    def rows(df: DataFrame) -> list[dict]:
        return [r.asDict(recursive=True) for r in df.collect()]

    def keyed(df: DataFrame, key: str) -> dict:
        return {r.pop(key): {_title(k): v for k, v in r.items()} for r in rows(df.orderBy(key))}

    model, kinds = snapshot.model, {k: n for n, k in enumerate(NODE_KINDS)}
    nodes = {r["id"]: {"Id": r["id"], "Kind": kinds.get(r["kind"], r["kind"]), "Name": r["name"], "Attributes": r["attributes"], "Evidence": r["evidence"]} for r in rows(snapshot.graph.nodes.orderBy("id"))}
    order = F.array_position(F.array(*map(F.lit, EDGE_KINDS)), F.col("kind"))
    edges = [{"FromId": r["from_id"], "ToId": r["to_id"], "Kind": EDGE_KINDS.index(r["kind"]), "Label": r["label"], "Attributes": r["attributes"], "Evidence": r["evidence"], "Confidence": r["confidence"]}
             for r in rows(snapshot.graph.edges.orderBy("from_id", order, "to_id", "label"))]
    spaces = metrics.namespace_counts(model).select("ns_id", "noc", "nac")
    coupling = metrics.namespace_coupling(model).select("ns_id", "ca", "ce", F.col("i").alias("instability"), F.col("a").alias("abstractness"), F.col("d").alias("distance"))
    candidates = [{"Id": r["id"], "Kind": INTEGRATION_KINDS.index(r["kind"]), "Technology": r["technology"], "LogicalName": r["logical_name"], "Endpoint": r["endpoint"], "EndpointSource": r["endpoint_source"], "Confidence": r["confidence"],
                   "Evidence": [{"Kind": EVIDENCE_KINDS.index(e["kind"]), "FilePath": e["file_path"], "Line": e["line"], "Details": e["details"]} for e in r["evidence"]], "Attributes": r["attributes"] or None}
                  for r in rows(snapshot.candidates.orderBy("id"))]
    usage: dict[str, dict] = {"method": {}, "type": {}, "namespace": {}, "project": {}}
    for r in rows(snapshot.usage()):
        usage[r["level"]][r["node_id"]] = r["candidates"]
    cycles = [{"Nodes": r["members"].split(","), "Scope": r["scope"]} for r in rows(snapshot.cycles().orderBy(F.desc("scope"), "root"))]
    totals = metrics.dependency_totals(model).first()
    return _without_nulls({
        "Metadata": {"Tool": TOOL, "ToolVersion": VERSION, "GeneratedAt": snapshot.generated_at.isoformat(), "MetricsSchemaVersion": "1", "IntegrationsSchemaVersion": "3"},
        "Graph": {"Nodes": nodes, "Edges": edges},
        "Metrics": {"Summary": {_title(k): v for k, v in metrics.summary(model).first().asDict().items()}, "Projects": keyed(metrics.project_counts(model).drop("project"), "project_id"), "Namespaces": keyed(spaces, "ns_id"),
                    "NamespaceCoupling": keyed(coupling, "ns_id"), "Types": keyed(metrics.type_metrics(model), "type_id"), "TypeCoupling": keyed(metrics.type_coupling(model), "type_id"),
                    "Methods": keyed(metrics.method_metrics(model.methods), "method_id"), "Dependencies": {"TotalDependencies": totals["total_deps"], "InternalDependencies": totals["internal_deps"], "Cycles": cycles}},
        "Integrations": {"Candidates": candidates, "UsageByNodeId": usage["method"], "UsageByTypeId": usage["type"], "UsageByNamespaceId": usage["namespace"], "UsageByProjectId": usage["project"]}})


def to_json(snapshot: Snapshot) -> str:
    return json.dumps(document(snapshot), indent=2, ensure_ascii=False)


WRITERS: dict[str, Callable[[Snapshot], str]] = {"csv": csv, "json": to_json, "md": markdown, "sarif": sarif}


def register_sink(name: str, writer: Callable[[Snapshot], str]) -> None:
    """Adds a report format."""
    WRITERS[name.strip().lower()] = writer


def resolve(name: str | None) -> Callable[[Snapshot], str]:
    """The writer of a format, whatever its case."""
    key = (name or "").strip().lower()
    if not key:
        raise ValueError("a report format is needed")
    if key not in WRITERS:
        raise NotImplementedError(f"unknown report format {name!r}; there are: {', '.join(sorted(WRITERS))}")
    return WRITERS[key]


def tables(snapshot: Snapshot, folder: str) -> None:
    """Every metric table as Parquet below ``folder``: the form for batches of many repositories."""
    model = snapshot.model
    for name, df in (("methods", metrics.method_metrics(model.methods)), ("types", metrics.type_metrics(model)), ("namespaces", metrics.namespace_counts(model)), ("namespace_coupling", metrics.namespace_coupling(model)),
                     ("projects", metrics.project_counts(model)), ("summary", metrics.summary(model)), ("cycles", snapshot.cycles()), ("candidates", snapshot.candidates), ("usage", snapshot.usage())):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
