"""Set operations: rule-output union, live-list merge, id union."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .views import latest_by_key


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    """UNION ALL by column name."""
    frames = list(frames)
    if not frames:
        raise ValueError("union_all needs at least one DataFrame")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def merge_live(new: DataFrame, held: DataFrame, key: str = "id") -> DataFrame:
    """Merge a fresh batch into the held list, one row per key; the held row wins.

    Implemented as a keyed aggregate (``latest_by_key`` on a priority column), which
    combines map-side, rather than a window over each key.
    """
    tagged = held.withColumn("_prio", F.lit(1)).unionByName(new.withColumn("_prio", F.lit(0)))
    return latest_by_key(tagged, key, "_prio").drop("_prio")


def union_ids(a: DataFrame, b: DataFrame, col: str = "endpoint_id") -> DataFrame:
    """Distinct ids appearing in either input."""
    return a.select(col).union(b.select(col)).distinct()
