"""Ordered folds and reductions of weighted evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import EVIDENCE_KINDS


#: Rows of a rule table at most: it goes to every task.
MAX_RULES = 10_000


def clip(x: Column, low: Column, high: Column) -> Column:
    return F.least(high, F.greatest(low, x))


def added(x: Column, w: Column) -> Column:
    """A confidence after one more weight."""
    return clip(x + w, F.lit(0.0), F.lit(1.0))


def folded(ordered_weights: Column) -> Column:
    """What a run of weights does to any confidence: where it takes 0 and 1, and the weights if that leaves it open.

    Sums of doubles depend on their order, so a run cannot be summed apart. But each step keeps the order
    of any two confidences, rounding included: if 0 and 1 end in one place, so does whatever is between.
    """
    both = F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))
    ends = F.aggregate(ordered_weights, both, lambda f, w: F.struct(added(f["low"], w).alias("low"), added(f["high"], w).alias("high")))
    return F.struct(ends["low"].alias("low"), F.when(ends["low"] != ends["high"], ordered_weights).alias("open"))


def composed(ordered: Column) -> Column:
    """The runs of ``folded`` one after the other, from 0: step by step where a run is open."""
    return F.aggregate(ordered, F.lit(0.0), lambda x, f: F.when(f["open"].isNull(), f["low"]).otherwise(F.aggregate(f["open"], x, added)))


def nulls_last(*names: str) -> list[Column]:
    """The fields of a struct that sorts by ``names`` as SQL does."""
    return [c for n in names for c in (F.col(n).isNull().alias(f"_no_{n}"), F.col(n))]


def confidence(evidence: DataFrame, key: str, order: list[str], weight: str, chunk: Column | None = None) -> DataFrame:
    """The confidence of each candidate, clamped to [0, 1] at every step, where it is positive.

    It is the very double that adding the weights one by one gives; nulls in ``order`` come last.
    ``chunk`` must not fall along ``order`` and must be null where that is; with it a candidate's evidence
    is folded chunk by chunk in tasks of their own. Of a chunk only its result is gathered, or its
    weights if the result depends on what came before.
    """
    rows = evidence.select(key, *order, weight, (F.lit(0) if chunk is None else chunk).alias("_chunk"))
    packed = F.array_sort(F.collect_list(F.struct(*nulls_last(*order), weight)))
    parts = rows.groupBy(key, "_chunk").agg(packed.alias("ws")).select(key, "_chunk", folded(F.transform("ws", lambda x: x[weight])).alias("f"))
    whole = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*nulls_last("_chunk"), "f"))).alias("fs"))
    return whole.select(key, composed(F.transform("fs", lambda x: x["f"])).alias("confidence")).where("confidence > 0")


def kind_ordinal(kind: Column) -> Column:
    return (F.array_position(F.array(*map(F.lit, EVIDENCE_KINDS)), kind) - 1).cast("int")


def distinct_evidence(evidence: DataFrame, key: str) -> DataFrame:
    """Evidence without repeats by (kind, file_path, line, details), in its order within each candidate."""
    rows = evidence.dropDuplicates([key, "kind", "file_path", "line", "details"]).withColumn("ordinal", kind_ordinal(F.col("kind")))
    order = Window.partitionBy(key).orderBy("ordinal", F.asc_nulls_first("file_path"), F.asc_nulls_first("line"), "details")
    return rows.withColumn("position", F.row_number().over(order))


def first_match(signals: DataFrame, text: str, rules: DataFrame, keys: list[str]) -> DataFrame:
    """The least-priority rule whose pattern stands in ``text``, whatever the case.

    ``rules`` (priority, pattern, technology) is sent to every task, so more than ``MAX_RULES``
    are refused; the substring test is the join's condition.
    """
    if rules.limit(MAX_RULES + 1).count() > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    lowered = signals.withColumn("_text", F.lower(F.col(text)))
    hits = lowered.join(F.broadcast(rules.select("priority", F.lower("pattern").alias("_pattern"), "technology")), F.expr("contains(_text, _pattern)"))
    return hits.groupBy(*keys).agg(F.min_by("technology", "priority").alias("technology"))
