"""Incremental upkeep of the summary views (M3) from streaming micro-batches.

Each micro-batch's rollup is stored once under its batch id (``sources.store``): a batch handled
again adds nothing.  Readers merge partials with a second-level ``groupBy`` (the summing-table
semantics); :func:`compact_rollup` puts one merged partial in place of the others from time to
time, in one step, so a reader counts every batch once at any moment.  The rollup builders and the
views derived from rollups live in ``operators.rollups``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.rollups import (  # noqa: F401  (re-exported)
    DETECTION_ROLLUP_KEYS,
    EVENT_ROLLUP_KEYS,
    detection_rollup,
    detection_summary,
    endpoint_details_view,
    endpoint_detections,
    endpoint_events,
    event_rollup,
    merge_detection_rollup,
    merge_event_rollup,
    user_details_view,
    user_detections,
    user_events,
    views_from_rollups,
)
from ..schema import DETECTIONS, EVENTS
from ..sources.store import Store


# ------------------------------------------------------------------ upkeep


def rollup_store(spark: SparkSession, path: str, kind: str = "events") -> Store:
    empty = event_rollup(spark.createDataFrame([], EVENTS)) if kind == "events" else detection_rollup(spark.createDataFrame([], DETECTIONS))
    return Store(spark, path, empty.schema, months=False)


def write_partial(rollup: DataFrame, path: str, batch_id: int, kind: str = "events") -> bool:
    """Store one micro-batch's rollup; False if that batch was stored before."""
    return rollup_store(rollup.sparkSession, path, kind).append(rollup, batch_id, "rollup")


def _merge(kind: str):
    return merge_event_rollup if kind == "events" else merge_detection_rollup


def read_rollup(spark: SparkSession, path: str, kind: str = "events") -> DataFrame:
    """The merged partials; an empty rollup where none has been written."""
    return _merge(kind)(rollup_store(spark, path, kind).read())


def compact_rollup(spark: SparkSession, path: str, batch_id: int, kind: str = "events", every: int = 50) -> bool:
    """M2: once ``every`` partials are live, put one in their place."""
    store = rollup_store(spark, path, kind)
    if len(store.state()["live"]) < every:
        return False
    return store.rewrite(None, _merge(kind), "fold")
