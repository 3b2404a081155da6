"""Summary tables of the store (detection/endpoint/user rollups, details, KPIs).

Every view is a ``groupBy().agg()`` with built-in aggregates, so Spark combines
map-side before the shuffle.  ``count(DISTINCT x)`` is planned by Catalyst as a
two-level aggregate on (key, x), which spreads a hot key over the value space.  The
"first 10 distinct values" lists use :func:`smallest_distinct`, which never gathers a
whole group in one place.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import rollups as RU
from .distinct import _keys, smallest_distinct  # noqa: F401  (smallest_distinct re-exported)

# ------------------------------------------------------------------ detections


def detection_summary(det: DataFrame) -> DataFrame:
    """A1: date, rule_id, severity -> detection_count, affected_endpoints."""
    return det.groupBy(F.to_date("timestamp").alias("date"), "rule_id", "severity").agg(
        F.count(F.lit(1)).alias("detection_count"),
        F.count_distinct("endpoint_id").alias("affected_endpoints"),
    )


def endpoint_detections(det: DataFrame) -> DataFrame:
    """A2: endpoint_id, date -> unique_rules, detection_count, max_severity."""
    return det.groupBy("endpoint_id", F.to_date("timestamp").alias("date")).agg(
        F.count_distinct("rule_id").alias("unique_rules"),
        F.count(F.lit(1)).alias("detection_count"),
        F.max("severity").alias("max_severity"),
    )


# ------------------------------------------------------------------ events


def endpoint_events(ev: DataFrame) -> DataFrame:
    """A3: endpoint_id, date, event_type -> count, first/last seen, distinct users."""
    return ev.groupBy("endpoint_id", F.to_date("timestamp").alias("date"), "event_type").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
        F.count_distinct("user").alias("unique_users"),
    )


def user_events(ev: DataFrame) -> DataFrame:
    """A4: user, date, event_type -> count, first/last seen, distinct endpoints (user != '')."""
    return (
        ev.where(F.col("user") != "")
        .groupBy("user", F.to_date("timestamp").alias("date"), "event_type")
        .agg(
            F.count(F.lit(1)).alias("event_count"),
            F.min("timestamp").alias("first_seen"),
            F.max("timestamp").alias("last_seen"),
            F.count_distinct("endpoint_id").alias("unique_endpoints"),
        )
    )


def user_endpoint_pairs(ev: DataFrame) -> DataFrame:
    """Distinct (user, endpoint_id) with a non-empty user."""
    return ev.where(F.col("user") != "").select("user", "endpoint_id").distinct()


def user_detections(det: DataFrame, ev: DataFrame) -> DataFrame:
    """Detections fanned out to every user seen on their endpoint.

    Detections are pre-aggregated to (endpoint, date, severity, rule) before the join,
    so the fan-out multiplies counts, not rows.
    """
    per_endpoint = det.groupBy(
        "endpoint_id", F.to_date("timestamp").alias("date"), "severity", "rule_id"
    ).agg(F.count(F.lit(1)).alias("_n"))
    return RU.fan_out(per_endpoint, user_endpoint_pairs(ev)).agg(F.sum("_n").alias("detection_count"))


def _rollup(ev: DataFrame, write: bool) -> DataFrame:
    er = RU.event_rollup(ev)
    return materialize(er, "event-rollup") if write else er


def endpoint_details_view(ev: DataFrame, k: int = 10, write_rollup: bool = True) -> DataFrame:
    """endpoint_id -> primary user (of the earliest event), last_seen, totals, first k types.

    One pass over the events builds the (endpoint, user, date, type) rollup, written
    once; the aggregates and the salted first-k list both read that small table.
    ``write_rollup=False`` skips the write for inputs already filtered to a few rows
    (one endpoint's events), where a second read is cheaper than an extra job.
    """
    return RU.endpoint_details_view(_rollup(ev, write_rollup), k)


def user_details_view(ev: DataFrame, k: int = 10, write_rollup: bool = True) -> DataFrame:
    """User -> last_seen, totals, distinct types/endpoints, first k endpoints (user != '').

    Built from the one-pass rollup, like :func:`endpoint_details_view`.
    """
    return RU.user_details_view(_rollup(ev, write_rollup), k)


# ------------------------------------------------------------------ second-level rollups


def _only(df: DataFrame, col: str, value: str | None) -> DataFrame:
    return df if value is None else df.where(F.col(col) == F.lit(value))


def endpoint_event_summary(a3: DataFrame, endpoint_id: str | None = None) -> DataFrame:
    """Per endpoint and type over all dates; unique_users is the sum of daily counts."""
    return (
        _only(a3, "endpoint_id", endpoint_id)
        .groupBy("endpoint_id", "event_type")
        .agg(
            F.sum("event_count").alias("event_count"),
            F.max("last_seen").alias("last_seen"),
            F.sum("unique_users").alias("unique_users"),
        )
    )


def endpoint_detection_summary(a2: DataFrame, endpoint_id: str | None = None) -> DataFrame:
    """A10: per endpoint: total detections and highest severity."""
    return (
        _only(a2, "endpoint_id", endpoint_id)
        .groupBy("endpoint_id")
        .agg(F.sum("detection_count").alias("detection_count"), F.max("max_severity").alias("max_severity"))
    )


def user_event_summary(a4: DataFrame, user: str | None = None) -> DataFrame:
    """Per user and type over all dates; unique_endpoints is the sum of daily counts."""
    return (
        _only(a4, "user", user)
        .groupBy("user", "event_type")
        .agg(
            F.sum("event_count").alias("event_count"),
            F.max("last_seen").alias("last_seen"),
            F.sum("unique_endpoints").alias("unique_endpoints"),
        )
    )


def user_detection_summary(a5: DataFrame, user: str | None = None) -> DataFrame:
    """Per user: highest severity, total detections, distinct rules."""
    return (
        _only(a5, "user", user)
        .groupBy("user")
        .agg(
            F.max("severity").alias("max_severity"),
            F.sum("detection_count").alias("detection_count"),
            F.count_distinct("rule_id").alias("unique_rules"),
        )
    )


def list_kpis(df: DataFrame, as_of: str | Column, last_seen: str = "last_seen", count_col: str = "event_count") -> DataFrame:
    """Number of rows, rows active on as_of's date, total of ``count_col``."""
    day = F.to_date(F.lit(as_of) if isinstance(as_of, str) else as_of)
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.to_date(last_seen) == day).alias("active_today"),
        F.coalesce(F.sum(count_col), F.lit(0)).cast("bigint").alias("total_events"),
    )


def pct_of_max(df: DataFrame, col: str = "count", alias: str = "pct_of_max") -> DataFrame:
    """``col / max(col) * 100``.

    Meant for top-k outputs (the dashboard's 10 event types): the window has no
    partition key, which is only safe because the input is bounded by k rows.
    """
    return df.withColumn(
        alias, F.col(col).cast("double") / F.max(col).over(Window.partitionBy()) * 100.0
    )


def event_type_counts(ev: DataFrame) -> DataFrame:
    """Number of events per event type."""
    return ev.groupBy("event_type").agg(F.count(F.lit(1)).alias("event_count"))


def table_health(tables: Mapping[str, DataFrame | None], min_rows: int = 1) -> DataFrame:
    """Rows and state per table: OK (>= min_rows), EMPTY, or MISSING (None).

    One global count per table (a partial count per partition, then a single-row
    merge), unioned into a small report.
    """
    parts = []
    spark = None
    for name, df in tables.items():
        if df is None:
            continue
        spark = df.sparkSession
        parts.append(
            df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        )
    missing = [name for name, df in tables.items() if df is None]
    if spark is None:
        raise ValueError("table_health needs at least one existing table")
    if missing:
        parts.append(
            spark.createDataFrame([(m, None) for m in missing], "table string, rows bigint")
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    state = (
        F.when(F.col("rows").isNull(), "MISSING")
        .when(F.col("rows") >= min_rows, "OK")
        .otherwise("EMPTY")
    )
    return out.withColumn("state", state)


# ------------------------------------------------------------------ merge semantics


def latest_by_key(df: DataFrame, keys: str | Sequence[str], version: str | Sequence[str]) -> DataFrame:
    """M1: the row with the greatest ``version`` per key (replacing-table semantics).

    ``max(struct(version, rest))`` is an ordinary aggregate with a map-side partial,
    so a hot key costs one value per task rather than a window over the whole group;
    ties on ``version`` are broken by the remaining columns, deterministically.
    """
    keys = _keys(keys)
    versions = _keys(version)
    rest = [c for c in df.columns if c not in keys and c not in versions]
    packed = F.struct(*[F.col(c) for c in versions + rest])
    return df.groupBy(*keys).agg(F.max(packed).alias("_latest")).select(
        *keys, *[F.col(f"_latest.{c}").alias(c) for c in versions + rest]
    ).select(*df.columns)


def merge_partials(
    df: DataFrame,
    keys: str | Sequence[str],
    sums: Iterable[str] = (),
    mins: Iterable[str] = (),
    maxs: Iterable[str] = (),
) -> DataFrame:
    """M2: fold partial rows of a summing view: add sums, keep min of mins, max of maxs."""
    aggs = [F.sum(c).alias(c) for c in sums]
    aggs += [F.min(c).alias(c) for c in mins]
    aggs += [F.max(c).alias(c) for c in maxs]
    return df.groupBy(*_keys(keys)).agg(*aggs)
