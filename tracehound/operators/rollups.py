"""Rollups from which the summary views derive (M3, M4).

Every event view (A3, A4, A6, A7, A15) can be derived exactly from one rollup keyed by
(endpoint_id, user, date, event_type) holding count and first/last seen (fixed-width
buffers, so the aggregation over all events hashes); every detection view (A1, A2, A5) from a rollup keyed by (endpoint_id, date,
severity, rule_id).  Distinct counts stay exact because the distinct values are part
of the rollup key.  A rollup is far smaller than the table it summarises.

Batch plans build a rollup in one pass and write it once, so views that need several
aggregations (A6, A7, the dashboard) read the small rollup instead of the events
table several times.  Streaming upkeep (``streaming.rollups``) keeps per-batch
partial rollups and merges them on read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from .distinct import smallest_distinct

EVENT_ROLLUP_KEYS = ("endpoint_id", "user", "date", "event_type")
DETECTION_ROLLUP_KEYS = ("endpoint_id", "date", "severity", "rule_id")


def event_rollup(ev: DataFrame) -> DataFrame:
    return ev.groupBy(
        "endpoint_id", "user", F.to_date("timestamp").alias("date"), "event_type"
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
    )


def detection_rollup(det: DataFrame) -> DataFrame:
    return det.groupBy(
        "endpoint_id", F.to_date("timestamp").alias("date"), "severity", "rule_id"
    ).agg(F.count(F.lit(1)).alias("n"))


def merge_event_rollup(er: DataFrame) -> DataFrame:
    """M2 over partial event rollups (e.g. one per micro-batch)."""
    return er.groupBy(*EVENT_ROLLUP_KEYS).agg(
        F.sum("n").alias("n"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )


def merge_detection_rollup(dr: DataFrame) -> DataFrame:
    return dr.groupBy(*DETECTION_ROLLUP_KEYS).agg(F.sum("n").alias("n"))


# ------------------------------------------------------------------ views from rollups


def endpoint_events(er: DataFrame) -> DataFrame:
    """A3 from the event rollup."""
    return er.groupBy("endpoint_id", "date", "event_type").agg(
        F.sum("n").cast("bigint").alias("event_count"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.count_distinct("user").alias("unique_users"),
    )


def user_events(er: DataFrame) -> DataFrame:
    """A4 from the event rollup."""
    return (
        er.where(F.col("user") != "")
        .groupBy("user", "date", "event_type")
        .agg(
            F.sum("n").cast("bigint").alias("event_count"),
            F.min("first_seen").alias("first_seen"),
            F.max("last_seen").alias("last_seen"),
            F.count_distinct("endpoint_id").alias("unique_endpoints"),
        )
    )


def endpoint_totals(er: DataFrame) -> DataFrame:
    """A6 without its list of types."""
    return er.groupBy("endpoint_id").agg(
        F.min_by("user", F.struct("first_seen", "user")).alias("primary_user"),
        F.max("last_seen").alias("last_seen"),
        F.sum("n").cast("bigint").alias("total_events"),
        F.count_distinct("event_type").alias("unique_event_types"),
        F.count_distinct("user").alias("unique_users"),
    )


def endpoint_details_view(er: DataFrame, k: int = 10) -> DataFrame:
    """A6 from the event rollup."""
    types = smallest_distinct(er, "endpoint_id", "event_type", k, "recent_event_types")
    return endpoint_totals(er).join(types, "endpoint_id", "left")


def user_totals(er: DataFrame) -> DataFrame:
    """A7 without its list of endpoints."""
    return er.where(F.col("user") != "").groupBy("user").agg(
        F.max("last_seen").alias("last_seen"),
        F.sum("n").cast("bigint").alias("total_events"),
        F.count_distinct("event_type").alias("unique_event_types"),
        F.count_distinct("endpoint_id").alias("unique_endpoints"),
    )


def user_details_view(er: DataFrame, k: int = 10) -> DataFrame:
    """A7 from the event rollup."""
    eps = smallest_distinct(er.where(F.col("user") != ""), "user", "endpoint_id", k, "recent_endpoints")
    return user_totals(er).join(eps, "user", "left")


def detection_summary(dr: DataFrame) -> DataFrame:
    """A1 from the detection rollup."""
    return dr.groupBy("date", "rule_id", "severity").agg(
        F.sum("n").cast("bigint").alias("detection_count"),
        F.count_distinct("endpoint_id").alias("affected_endpoints"),
    )


def endpoint_detections(dr: DataFrame) -> DataFrame:
    """A2 from the detection rollup."""
    return dr.groupBy("endpoint_id", "date").agg(
        F.count_distinct("rule_id").alias("unique_rules"),
        F.sum("n").cast("bigint").alias("detection_count"),
        F.max("severity").alias("max_severity"),
    )


USERS_PER_SALT = 10_000


def fan_out(per_endpoint: DataFrame, pairs: DataFrame) -> GroupedData:
    """Groups of detections of an endpoint met with each user of it, by (user, date, severity, rule).

    Users of an endpoint are dealt to salts of about :data:`USERS_PER_SALT`; only the groups of an
    endpoint with more users are repeated, once a salt.  So an endpoint that a third of all users share
    is met in many tasks."""
    users = pairs.groupBy("endpoint_id").agg(F.greatest(F.ceil(F.count(F.lit(1)) / USERS_PER_SALT), F.lit(1)).cast("int").alias("_salts"))
    dealt = per_endpoint.join(users, "endpoint_id").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
    hot = users.where("_salts > 1")
    # few endpoints are hot (at most the pairs / USERS_PER_SALT); the planner measures them
    salted = pairs.join(hot, "endpoint_id", "left").withColumn("_salt", F.pmod(F.xxhash64("user"), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    return dealt.drop("_salts").join(salted, ["endpoint_id", "_salt"]).groupBy("user", "date", "severity", "rule_id")


def user_detections(dr: DataFrame, er: DataFrame) -> DataFrame:
    """A5 from both rollups: always the full join (later events of a user on an
    endpoint also count earlier detections there, D9)."""
    pairs = er.where(F.col("user") != "").select("user", "endpoint_id").distinct()
    per_endpoint = dr.groupBy(*DETECTION_ROLLUP_KEYS).agg(F.sum("n").alias("_n"))
    return fan_out(per_endpoint, pairs).agg(F.sum("_n").cast("bigint").alias("detection_count"))


def views_from_rollups(er: DataFrame, dr: DataFrame) -> dict[str, DataFrame]:
    return {
        "detection_summary": detection_summary(dr),
        "endpoint_detections": endpoint_detections(dr),
        "endpoint_events": endpoint_events(er),
        "user_events": user_events(er),
        "user_detections": user_detections(dr, er),
        "endpoint_details": endpoint_details_view(er),
        "user_details": user_details_view(er),
    }
