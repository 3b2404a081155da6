"""Joins of the store: hostname lookup, detection -> events, array zip.

Join strategy is left to the planner with AQE on: a side whose *measured* shuffle
size is under ``spark.sql.adaptive.autoBroadcastJoinThreshold`` is broadcast at run
time, anything larger stays a sort-merge join (with skew splitting).
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import EVENT_COLUMNS
from .filters import filter_time


def add_hostnames(df: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Add ``hostname`` by endpoint_id; missing or empty hostname -> 'Unknown'.

    The lookup is reduced to one row per endpoint (latest wins is not needed: any
    non-empty hostname) before the join, so duplicates cannot fan rows out.
    """
    lookup = endpoints.groupBy("endpoint_id").agg(
        F.max(F.nullif(F.col("hostname"), F.lit(""))).alias("_host")
    )
    joined = df.join(lookup, "endpoint_id", "left")
    return joined.withColumn("hostname", F.coalesce(F.col("_host"), F.lit("Unknown"))).drop("_host")


def detection_event_ids(det: DataFrame) -> DataFrame:
    """Distinct (detection_id, event_id) pairs of the comma-joined id lists
    (an empty list gives no pair, repeats count once, as ``IN`` ignores them)."""
    return (
        det.select(
            F.col("id").alias("detection_id"),
            F.explode(F.array_distinct(F.split("event_ids", ","))).alias("event_id"),
        )
        .where(F.col("event_id") != "")
        .distinct()
    )


PAGE_ROWS = 10_000


def held_page(det: DataFrame, limit: int) -> DataFrame:
    """A page of at most ``limit`` detections as a local table, evaluated once (pages over
    :data:`PAGE_ROWS` rows stay as they are)."""
    return det.sparkSession.createDataFrame(det.limit(limit).collect(), det.schema) if limit <= PAGE_ROWS else det


def events_between(det: DataFrame, events: DataFrame, within_ms: int) -> DataFrame:
    """The events that the detections can cite: from ``within_ms`` before the first detection to the
    last one (a detection has the time of its last event), as literal bounds that reach the scan."""
    span = det.agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last")).first()
    if span["first"] is None:
        return events.where(F.lit(False))
    return filter_time(events, span["first"] - timedelta(milliseconds=within_ms), span["last"])


def attach_events(
    det: DataFrame, events: DataFrame, fields: Sequence[str] = EVENT_COLUMNS, alias: str = "events", within_ms: int | None = None,
) -> DataFrame:
    """Each detection with the array of its events in time order.

    One plan instead of one lookup per detection: explode the id lists, join the events
    by id (AQE broadcasts the id list where its measured size allows), collect per detection (at most one entry per listed
    id), and left-join back.  Unknown ids vanish; an empty list gives ``[]``.

    ``within_ms``, the longest span of the rules that made the detections, bounds the scan of the
    events in time (the detections are then read once more, for the bounds).
    """
    if within_ms is not None:
        events = events_between(det, events, within_ms)
    cols = list(dict.fromkeys(["timestamp", "id", *fields]))
    ev = events.select(*cols)
    pairs = detection_event_ids(det)
    matched = ev.withColumnRenamed("id", "event_id").join(pairs, "event_id").withColumnRenamed("event_id", "id")
    per_det = matched.groupBy("detection_id").agg(
        F.array_sort(F.collect_list(F.struct(*cols))).alias(alias)
    )
    empty = F.array().cast(per_det.schema[alias].dataType)
    return (
        det.join(per_det, det["id"] == per_det["detection_id"], "left")
        .drop("detection_id")
        .withColumn(alias, F.coalesce(F.col(alias), empty))
    )


def zip_arrays(df: DataFrame, arrays: dict[str, str], out: str) -> DataFrame:
    """Positional zip of parallel array columns into one array of records.

    ``arrays`` maps output field name -> input array column.
    """
    zipped = F.arrays_zip(*[F.col(c).alias(name) for name, c in arrays.items()])
    return df.withColumn(out, zipped)
