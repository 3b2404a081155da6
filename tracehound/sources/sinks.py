"""Sinks (S3-S5, S7): stored tables, published detections, CSV export.

Stored tables are :class:`~tracehound.sources.store.Store` tables: Parquet folders by write and
``month`` (``year*100+month`` of ``date``), sorted by (endpoint_id, timestamp) inside each file, so
month filters prune directories and endpoint/time predicates skip row groups by their
statistics.  Streaming writes store a micro-batch once, under its batch id; small folders are
folded from time to time, beside the stream.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.parse import with_month
from ..schema import DETECTIONS, EVENTS
from .store import Store

SORT_KEYS = {"events": ("endpoint_id", "timestamp"), "detections": ("severity", "rule_id", "timestamp")}
SCHEMAS = {"events": EVENTS, "detections": DETECTIONS}


def table_store(spark: SparkSession, path: str, table: str) -> Store:
    """The stored events or detections at ``path``."""
    return Store(spark, path, SCHEMAS[table], sort=SORT_KEYS[table])


def prepared(df: DataFrame, table: str) -> DataFrame:
    """The table's columns and the month."""
    out = df if "month" in df.columns else with_month(df)
    return out.select(*SCHEMAS[table].fieldNames(), "month")


def write_table(df: DataFrame, path: str, table: str = "events", mode: str = "append") -> None:
    """Batch append (or overwrite) of events/detections into the stored table."""
    store = table_store(df.sparkSession, path, table)
    if mode == "overwrite":
        store.replace(prepared(df, table))
    elif mode == "append":
        store.append(prepared(df, table))
    else:
        raise ValueError("mode must be 'append' or 'overwrite'")


def write_batch(df: DataFrame, path: str, table: str, batch_id: int, writer: str) -> bool:
    """Store a micro-batch's rows once, and fold small folders; False if the batch was stored before."""
    store = table_store(df.sparkSession, path, table)
    stored = store.append(prepared(df, table), batch_id, writer)
    if stored:
        store.fold()
    return stored


def write_events(df: DataFrame, path: str, checkpoint: str | None = None, trigger: dict | None = None):
    """S3: store events.  Batch DataFrames are appended; streaming ones start a query
    (micro-batch = write batch; default trigger every 200 ms like the reference's
    flush interval)."""
    if not df.isStreaming:
        write_table(df, path, "events")
        return None
    return _stream_to(df, path, checkpoint, trigger or {"processingTime": "200 milliseconds"}, "events")


def write_detections(df: DataFrame, path: str, checkpoint: str | None = None, trigger: dict | None = None):
    """Store detections (same layout as S3)."""
    if not df.isStreaming:
        write_table(df, path, "detections")
        return None
    return _stream_to(df, path, checkpoint, trigger or {"processingTime": "200 milliseconds"}, "detections")


def _stream_to(df: DataFrame, path: str, checkpoint: str | None, trigger: dict, table: str) -> StreamingQuery:
    if not checkpoint:
        raise ValueError("a streaming sink needs a checkpoint location")
    writer = f"sink{hashlib.sha256(checkpoint.encode()).hexdigest()[:8]}"  # batch ids count within a checkpoint
    return (
        df.writeStream.foreachBatch(lambda batch, batch_id: write_batch(batch, path, table, batch_id, writer))
        .option("checkpointLocation", checkpoint).outputMode("append").trigger(**trigger).start()
    )


def detections_json(det: DataFrame) -> DataFrame:
    """S5 payload: one JSON text per detection with the wire field names
    (``ruleId``, ``endpointId``, ``eventIds``; ``timestamp`` in epoch ms)."""
    return det.select(
        F.col("id").alias("key"),
        F.to_json(
            F.struct(
                F.col("id").alias("id"),
                F.unix_millis("timestamp").alias("timestamp"),
                F.col("rule_id").alias("ruleId"),
                F.col("severity").alias("severity"),
                F.col("endpoint_id").alias("endpointId"),
                F.col("description").alias("description"),
                F.col("event_ids").alias("eventIds"),
            )
        ).alias("value"),
    )


def publish_detections(
    det: DataFrame, fmt: str = "text", path: str | None = None, checkpoint: str | None = None,
    trigger: dict | None = None, mode: str = "append", **options,
):
    """Publish detections as JSON text (at least once).

    ``fmt="kafka"`` writes ``key``/``value`` to a topic (connector jar required);
    ``fmt="text"`` writes one JSON line per detection to ``path``.
    """
    payload = detections_json(det)
    if fmt == "text":
        payload = payload.select("value")
    if det.isStreaming:
        w = payload.writeStream.format(fmt).options(**options)
        if path:
            w = w.option("path", path)
        if checkpoint:
            w = w.option("checkpointLocation", checkpoint)
        if trigger:
            w = w.trigger(**trigger)
        return w.start()
    w = payload.write.mode(mode).format(fmt).options(**options)
    return w.save(path) if path else w.save()


def export_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with a header; values containing commas or quotes are quoted (Spark's
    CSV writer).  Nested columns (the attached ``events`` list) are written as JSON
    text.  ``single_file`` coalesces to one file (for small, already-limited results)."""
    cols = []
    for f in df.schema.fields:
        if f.dataType.typeName() in ("array", "struct", "map"):
            cols.append(F.to_json(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    out = df.select(*cols)
    if single_file:
        out = out.coalesce(1)
    out.write.mode("overwrite").option("header", True).option("escape", "\"").csv(path)
