"""Rows of a large table by a set of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ids in a broadcast filter at most; beyond it the filter is a shuffled join.
BROADCAST_IDS = 1_000_000


def only(rows: DataFrame, ids: DataFrame, key: str = "doc_id", how: str = "left_semi") -> DataFrame:
    """The rows whose ``key`` is in ``ids`` (one column of that name; left_anti: is not), sent to every task only while few."""
    ids = ids.distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, key, how)
