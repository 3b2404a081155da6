"""Builders for small hand-made event rows."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from tracehound.schema import EVENTS

BASE_MS = 1704067200000  # 2024-01-01 00:00:00 UTC


def ev(id_, ms, event_type="login", status="failed", endpoint="e1", user="u1",
       process_name="", direction="", bytes_=0):
    return (id_, ms, endpoint, event_type, status, direction, bytes_, "", "", process_name, user)


def events_df(spark, rows):
    cols = ["id", "ms", "endpoint_id", "event_type", "status", "direction", "bytes",
            "source_ip", "destination_ip", "process_name", "user"]
    df = spark.createDataFrame(rows, ",".join(f"{c} {'bigint' if c in ('ms', 'bytes') else 'string'}" for c in cols))
    df = df.withColumn("timestamp", F.timestamp_millis(F.col("ms") + BASE_MS)).withColumn("date", F.to_date("timestamp"))
    return df.select(*[f.name for f in EVENTS.fields])


def ts(ms):
    return datetime.fromtimestamp((BASE_MS + ms) / 1000, tz=timezone.utc).replace(tzinfo=None)
