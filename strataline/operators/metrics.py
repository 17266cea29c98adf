"""The 44 metrics, as DataFrame plans over a model's views. Nothing here runs Python on rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.graph import Model


#: Metrics of types beyond the built-in ones: name -> (model -> type_id and a column of that name).
EXTRA: dict[str, Callable[[Model], DataFrame]] = {}


def register_metric(name: str, f: Callable[[Model], DataFrame]) -> None:
    """Adds a metric of types; ``f`` returns type_id and a column called ``name``."""
    EXTRA[name] = f


def _clamped(name: str) -> Column:
    return F.greatest(F.lit(0), F.col(name)).cast("bigint")


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).cast("bigint").alias(name)


def method_metrics(methods: DataFrame) -> DataFrame:
    return methods.select(
        "method_id", _clamped("sloc").alias("mloc"), (_clamped("decision_points") + 1).alias("cyclo"),
        _clamped("calls").alias("calls"), _clamped("max_nesting").alias("nbd"), _clamped("parameters").alias("params"))


def type_sizes(model: Model) -> DataFrame:
    """sloc, nom, npm, wmc by type, zero where a type has no methods."""
    sums = model.methods.groupBy("type_id").agg(
        F.sum(_clamped("sloc")).alias("sloc"), F.count(F.lit(1)).alias("nom"),
        F.count_if("is_public").alias("npm"), F.sum(_clamped("decision_points") + 1).alias("wmc"))
    return model.types.select("type_id").join(sums, "type_id", "left").select("type_id", *map(_zero, ("sloc", "nom", "npm", "wmc")))


def degrees(model: Model) -> tuple[DataFrame, DataFrame]:
    """Distinct internal out- and in-degrees by name, loops left out."""
    edges = model.type_edges.where("src <> dst")
    return (edges.groupBy(F.col("src").alias("full_name")).agg(F.countDistinct("dst").alias("fan_out")),
            edges.groupBy(F.col("dst").alias("full_name")).agg(F.countDistinct("src").alias("fan_in")))


def type_coupling(model: Model) -> DataFrame:
    """dep, i_dep, fan_in, fan_out by type. dep counts distinct dependencies, blanks and the type itself included."""
    out, in_ = degrees(model)
    rows = model.types.select("type_id", "full_name", F.size(F.array_distinct("depends_on")).cast("bigint").alias("dep"))
    rows = rows.join(out, "full_name", "left").join(in_, "full_name", "left")
    return rows.select("type_id", F.greatest("dep", F.lit(0)).alias("dep"), F.coalesce("fan_out", F.lit(0)).cast("bigint").alias("i_dep"), _zero("fan_in"), _zero("fan_out"))


def cohesion(model: Model) -> DataFrame:
    """noa and lcom3 by type.

    The methods that reach a field, summed over distinct fields, are the distinct own
    fields that a method reaches, summed over methods: no explode is needed.
    """
    types = model.types.select("type_id", "fields")
    used = model.methods.select("type_id", "accessed_fields").join(types, "type_id")
    used = used.groupBy("type_id").agg(F.count(F.lit(1)).alias("m"), F.sum(F.size(F.array_intersect("accessed_fields", "fields"))).alias("hits"))
    rows = types.select("type_id", F.greatest(F.size("fields"), F.lit(0)).alias("n")).join(used, "type_id", "left")
    lack = 1 - F.col("hits") / (F.col("m") * F.col("n")).cast("double")
    lcom3 = F.when((F.coalesce("m", F.lit(0)) <= 1) | (F.col("n") <= 1), F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), lack)))
    return rows.select("type_id", F.col("n").cast("bigint").alias("noa"), lcom3.alias("lcom3"))


def type_metrics(model: Model) -> DataFrame:
    rows = type_sizes(model).join(type_coupling(model), "type_id").join(cohesion(model), "type_id")
    for name, f in EXTRA.items():
        rows = rows.join(f(model).select("type_id", name), "type_id", "left")
    return rows


def namespace_counts(model: Model) -> DataFrame:
    """noc and nac by namespace; nac counts abstract classes and records."""
    counts = model.types.groupBy("project_id", "ns_id").agg(
        F.count(F.lit(1)).alias("noc"), F.count_if(F.col("is_abstract") & F.col("kind").isin("Class", "Record")).alias("nac"))
    rows = model.namespaces.join(counts, ["project_id", "ns_id"], "left")
    return rows.select("project_id", "ns_id", F.col("ns_name").alias("namespace"), _zero("noc"), _zero("nac"))


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def namespace_coupling(model: Model) -> DataFrame:
    """ca, ce, instability, abstractness and distance by namespace."""
    edges = model.namespace_edges()
    ce = edges.groupBy(F.col("src_ns").alias("ns_name")).agg(F.count(F.lit(1)).alias("ce"))
    ca = edges.groupBy(F.col("dst_ns").alias("ns_name")).agg(F.count(F.lit(1)).alias("ca"))
    kinds = model.types.groupBy("project_id", "ns_id").agg(
        F.count(F.lit(1)).alias("types"), F.count_if(F.col("is_abstract") | (F.col("kind") == "Interface")).alias("open_types"))
    rows = model.namespaces.join(kinds, ["project_id", "ns_id"], "left").join(ca, "ns_name", "left").join(ce, "ns_name", "left")
    rows = rows.select("project_id", "ns_id", F.col("ns_name").alias("namespace"), _zero("ca"), _zero("ce"), ratio(F.col("open_types"), F.col("types")).alias("a"))
    rows = rows.withColumn("i", ratio(F.col("ce"), F.col("ca") + F.col("ce")))
    return rows.withColumn("d", F.abs(F.col("a") + F.col("i") - 1))


def dependency_totals(model: Model) -> DataFrame:
    """Distinct dependencies (blanks dropped, external ones kept), and internal ones (loops dropped)."""
    every = model.types.select("full_name", F.explode("depends_on").alias("target")).where(F.trim("target") != "").distinct()
    internal = model.type_edges.where("src <> dst").distinct()
    return one_row(every.agg(F.count(F.lit(1)).alias("total_deps")), internal.agg(F.count(F.lit(1)).alias("internal_deps")))


def one_row(*rows: DataFrame) -> DataFrame:
    """Single rows of different columns, side by side, without a join."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return every.agg(*(F.max(c).alias(c) for c in every.columns))


def targets(model: Model, internal: bool) -> DataFrame:
    """Dependencies that are (or are not) types of the model, without a type's own name."""
    every = model.types.select("type_id", "full_name", F.explode(F.array_distinct("depends_on")).alias("target")).where(F.trim("target") != "")
    known = model.types.select(F.col("full_name").alias("target"))
    rows = every.join(known, "target", "left_semi" if internal else "left_anti")
    return (rows.where("target <> full_name") if internal else rows).select("type_id", "target")


def statistics(column: str) -> list[Column]:
    """Mean, median, population and sample deviation, all zero for no rows (the last for one row too)."""
    zero = F.lit(0.0)
    return [F.coalesce(f(column), zero) for f in (F.avg, F.median, F.stddev_pop, F.stddev_samp)]


def summary(model: Model) -> DataFrame:
    """The fifteen totals, means, medians and population deviations, in one row."""
    sizes = type_sizes(model)

    def four(c: str, name: str) -> list[Column]:
        mean, median, spread, _ = statistics(c)
        return [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(f"total_{name}"), mean.alias(f"avg_{name}"), median.alias(f"median_{name}"), spread.alias(f"stddev_{name}")]

    by_type = sizes.agg(F.count(F.lit(1)).alias("total_types"), *four("sloc", "sloc"), *four("nom", "methods"), *four("wmc", "complexity"))
    spaces = model.namespaces.agg(F.count(F.lit(1)).alias("total_namespaces"))
    every = (model.all_methods if model.all_methods is not None else model.methods.select("method_id")).agg(F.count(F.lit(1)).alias("every_method"))
    row = one_row(spaces, by_type, every)
    row = row.withColumn("mean_types_per_namespace", ratio(F.col("total_types"), F.col("total_namespaces")))
    row = row.withColumn("total_methods", F.when(F.col("every_method") > 0, F.col("every_method")).otherwise(F.col("total_methods")))
    return row.select("total_namespaces", "total_types", "mean_types_per_namespace", *(f"{k}_{n}" for n in ("sloc", "methods", "complexity") for k in ("total", "avg", "median", "stddev")))


def project_counts(model: Model) -> DataFrame:
    """Namespaces, types and methods by project, by containment; where the model knows its edges, repeated ones count again."""
    if model.counts is not None:
        return model.projects.join(model.counts, "project_id", "left").select("project_id", F.col("name").alias("project"), *map(_zero, ("namespaces", "types", "methods")))
    spaces = model.namespaces.groupBy("project_id").agg(F.count(F.lit(1)).alias("namespaces"))
    types = model.types.groupBy("project_id").agg(F.count(F.lit(1)).alias("types"))
    methods = model.methods.select("type_id").join(model.types.select("type_id", "project_id"), "type_id").groupBy("project_id").agg(F.count(F.lit(1)).alias("methods"))
    rows = model.projects
    for part in (spaces, types, methods):
        rows = rows.join(part, "project_id", "left")
    return rows.select("project_id", F.col("name").alias("project"), *map(_zero, ("namespaces", "types", "methods")))


def report_counts(model: Model) -> DataFrame:
    """(name, count) rows of the tabular report."""
    def one(name: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("count")).select(F.lit(name).alias("name"), "count")

    parts = (("Namespaces", model.namespaces), ("Types", model.types), ("Methods", model.methods), ("Projects", model.projects),
             ("NamespaceCoupling", model.namespaces), ("TypeCoupling", model.types))
    out = one(*parts[0])
    for part in parts[1:]:
        out = out.unionByName(one(*part))
    return out
