"""Table schemas of the event store (events, detections, endpoints)."""

from __future__ import annotations

from pyspark.sql import types as T

EVENT_TEXT_FIELDS = (
    "endpoint_id",
    "event_type",
    "status",
    "direction",
    "source_ip",
    "destination_ip",
    "process_name",
    "user",
)

EVENTS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("timestamp", T.TimestampType(), False),
        T.StructField("endpoint_id", T.StringType(), False),
        T.StructField("event_type", T.StringType(), False),
        T.StructField("status", T.StringType(), False),
        T.StructField("direction", T.StringType(), False),
        T.StructField("bytes", T.LongType(), False),
        T.StructField("source_ip", T.StringType(), False),
        T.StructField("destination_ip", T.StringType(), False),
        T.StructField("process_name", T.StringType(), False),
        T.StructField("user", T.StringType(), False),
        T.StructField("date", T.DateType(), False),
    ]
)

EVENT_COLUMNS = tuple(f.name for f in EVENTS.fields)

DETECTIONS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("timestamp", T.TimestampType(), False),
        T.StructField("rule_id", T.StringType(), False),
        T.StructField("severity", T.IntegerType(), False),
        T.StructField("endpoint_id", T.StringType(), False),
        T.StructField("description", T.StringType(), False),
        T.StructField("event_ids", T.StringType(), False),
        T.StructField("date", T.DateType(), False),
    ]
)

DETECTION_COLUMNS = tuple(f.name for f in DETECTIONS.fields)

ENDPOINTS = T.StructType(
    [
        T.StructField("endpoint_id", T.StringType(), False),
        T.StructField("hostname", T.StringType(), False),
        T.StructField("ip", T.StringType(), False),
        T.StructField("os", T.StringType(), False),
        T.StructField("last_seen", T.TimestampType(), False),
    ]
)

# Raw JSON event as published on the wire / written by the generator: one object per
# message; ``timestamp`` is epoch milliseconds.
RAW_EVENT_JSON = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("endpoint_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("source_ip", T.StringType()),
        T.StructField("destination_ip", T.StringType()),
        T.StructField("process_name", T.StringType()),
        T.StructField("user", T.StringType()),
        T.StructField("direction", T.StringType()),
    ]
)
