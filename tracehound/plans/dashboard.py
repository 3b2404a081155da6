"""Dashboard snapshot (A8) and its response form (Q5).

Each section is its own small plan over the summary views, computed relative to an
explicit ``as_of`` instant (the reference uses ``now()``).  The one-row snapshot is
assembled without joins: all sections are unioned into one narrow table tagged by
section (each section is a bounded top-k, so the union has at most ~150 rows) and a
single global aggregate collects one ordered array of records per section.  Records
come from one sort per section, so parallel fields cannot misalign.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import to_ts
from ..operators.filters import recent_days, recent_hours
from ..operators.joins import add_hostnames
from ..operators.sorting import latest, top_k
from ..operators import rollups as RU
from ..session import materialize
from .requests import Parts

Frame = DataFrame | Callable[[], DataFrame]

# Section sizes of the dashboard.
EVENT_TYPES_TOP = 10
ACTIVE_TOP = 50
RECENT_ROWS = 20


def _ranked(df: DataFrame, order) -> DataFrame:
    """Add a 1-based rank to a bounded top-k result (<= 50 rows: one small task)."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def total_events(a3: DataFrame, as_of) -> DataFrame:
    return recent_days(a3, as_of, 1).agg(F.sum("event_count").cast("bigint").alias("total_events"))


def total_detections(a2: DataFrame, as_of) -> DataFrame:
    return recent_days(a2, as_of, 1).agg(F.sum("detection_count").cast("bigint").alias("total_detections"))


def severity_distribution(a5: DataFrame, as_of) -> DataFrame:
    """Detections per severity over the trailing day, counted once per user of the
    endpoint (the user-detection view), severities ascending."""
    return (
        recent_days(a5, as_of, 1)
        .groupBy("severity")
        .agg(F.sum("detection_count").cast("bigint").alias("count"))
        .orderBy("severity")
    )


def event_type_distribution(a3: DataFrame, as_of, k: int = EVENT_TYPES_TOP) -> DataFrame:
    agg = recent_days(a3, as_of, 1).groupBy("event_type").agg(
        F.sum("event_count").cast("bigint").alias("count")
    )
    top = top_k(agg, k, "count", "event_type")
    return _ranked(top, [F.col("count").desc(), F.col("event_type")])


def active_endpoints(a6: DataFrame, as_of, k: int = ACTIVE_TOP) -> DataFrame:
    live = recent_hours(a6, as_of, 24)
    top = top_k(live, k, "total_events", "endpoint_id")
    return _ranked(top, [F.col("total_events").desc(), F.col("endpoint_id")]).select(
        "rank",
        "endpoint_id",
        F.col("primary_user").alias("user"),
        F.col("total_events").alias("event_count"),
    )


def active_users(a7: DataFrame, as_of, k: int = ACTIVE_TOP) -> DataFrame:
    live = recent_hours(a7, as_of, 24)
    top = top_k(live, k, "total_events", "user")
    return _ranked(top, [F.col("total_events").desc(), F.col("user")]).select(
        "rank",
        "user",
        F.col("total_events").alias("event_count"),
        "unique_endpoints",
    )


def recent_events(ev: DataFrame, n: int = RECENT_ROWS) -> DataFrame:
    top = latest(ev, n).select("id", "timestamp", "endpoint_id", "event_type", "user")
    return _ranked(top, [F.col("timestamp").desc(), F.col("id")])


def recent_detections(det: DataFrame, n: int = RECENT_ROWS) -> DataFrame:
    top = latest(det, n).select("id", "timestamp", "endpoint_id", "rule_id", "severity")
    return _ranked(top, [F.col("timestamp").desc(), F.col("id")])


SECTION_FIELDS = {
    "severity": ["severity", "count"],
    "event_types": ["event_type", "count"],
    "active_endpoints": ["endpoint_id", "user", "event_count"],
    "active_users": ["user", "event_count", "unique_endpoints"],
    "recent_events": ["id", "timestamp", "endpoint_id", "event_type", "user"],
    "recent_detections": ["id", "timestamp", "endpoint_id", "rule_id", "severity"],
}

_WIDE = T.StructType(
    [
        T.StructField("section", T.StringType()),
        T.StructField("rank", T.IntegerType()),
        T.StructField("severity", T.IntegerType()),
        T.StructField("count", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("endpoint_id", T.StringType()),
        T.StructField("user", T.StringType()),
        T.StructField("event_count", T.LongType()),
        T.StructField("unique_endpoints", T.LongType()),
        T.StructField("id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("rule_id", T.StringType()),
        T.StructField("total_events", T.LongType()),
        T.StructField("total_detections", T.LongType()),
    ]
)


def _widen(df: DataFrame, section: str) -> DataFrame:
    cols = []
    for f in _WIDE.fields:
        if f.name == "section":
            cols.append(F.lit(section).alias("section"))
        elif f.name in df.columns:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def snapshot_sections(ev: DataFrame, det: Frame, as_of, views: Mapping[str, DataFrame] | None = None) -> Mapping[str, DataFrame]:
    """The dashboard sections, each planned when it is asked for.  ``views`` may supply the summary
    views already kept up to date (e.g. from the streaming rollups); otherwise a section derives what it
    shows from ``ev`` or ``det`` (a frame, or a function that gives it) and nothing else."""
    frames: dict[str, DataFrame] = {}

    def detections() -> DataFrame:
        if "det" not in frames:
            frames["det"] = det if isinstance(det, DataFrame) else det()
        return frames["det"]

    given = views or {}
    a2 = lambda: given["endpoint_detections"] if given else RU.endpoint_detections(RU.detection_rollup(_since(detections(), as_of)))
    a3 = lambda: given["endpoint_events"] if given else RU.endpoint_events(RU.event_rollup(_since(ev, as_of)))
    a5 = lambda: given["user_detections"] if given else RU.user_detections(RU.detection_rollup(_since(detections(), as_of)), RU.event_rollup(ev))
    a6 = lambda: given["endpoint_details"] if given else RU.endpoint_totals(RU.event_rollup(ev))
    a7 = lambda: given["user_details"] if given else RU.user_totals(RU.event_rollup(ev))
    return Parts({
        "totals_events": lambda: total_events(a3(), as_of),
        "totals_detections": lambda: total_detections(a2(), as_of),
        "severity": lambda: _ranked(severity_distribution(a5(), as_of), [F.col("severity")]),
        "event_types": lambda: event_type_distribution(a3(), as_of),
        "active_endpoints": lambda: active_endpoints(a6(), as_of),
        "active_users": lambda: active_users(a7(), as_of),
        "recent_events": lambda: recent_events(ev),
        "recent_detections": lambda: recent_detections(detections()),
    })


def _since(df: DataFrame, as_of) -> DataFrame:
    """Rows of the trailing day and later, by the time column (and months, where there are some)."""
    first = F.date_sub(F.to_date(to_ts(as_of)), 1)
    recent = df.where(F.col("timestamp") >= first.cast("timestamp"))
    return recent.where(F.col("month") >= F.year(first) * 100 + F.month(first)) if "month" in df.columns else recent


def dashboard_section(name: str, ev: DataFrame, det: Frame, as_of, endpoints: DataFrame | None = None, views: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """One section of the response (Q5), planned alone: its records by rank, hostnames added to the
    recent events and detections."""
    rows = snapshot_sections(ev, det, as_of, views)[name].select("rank", *SECTION_FIELDS[name])
    if endpoints is not None and name in ("recent_events", "recent_detections"):
        rows = add_hostnames(rows, endpoints)
    return rows


def dashboard_totals(ev: DataFrame, det: Frame, as_of, views: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Snapshot time and the two totals, without the sections."""
    sections = snapshot_sections(ev, det, as_of, views)
    return _assembled({name: sections[name] for name in ("totals_events", "totals_detections")}, as_of, [])


def _drop_rank(fields):
    def project(r):
        return F.struct(*[r[c].alias(c) for c in fields])

    return project


def _assembled(sections: Mapping[str, DataFrame], as_of, names) -> DataFrame:
    """One row of a tagged union of (bounded) sections: no joins."""
    parts = [_widen(df, name) for name, df in sections.items()]
    wide = parts[0]
    for p in parts[1:]:
        wide = wide.unionByName(p)
    aggs = [
        F.coalesce(F.max("total_events"), F.lit(0)).cast("bigint").alias("total_events"),
        F.coalesce(F.max("total_detections"), F.lit(0)).cast("bigint").alias("total_detections"),
    ]
    for name in names:
        fields = SECTION_FIELDS[name]
        rec = F.struct(F.col("rank"), *[F.col(c) for c in fields])
        collected = F.array_sort(F.collect_list(F.when(F.col("section") == name, rec)))
        aggs.append(F.transform(collected, _drop_rank(fields)).alias(name))
    now = to_ts(as_of)
    head = [
        F.to_date(now).alias("snapshot_date"),
        F.hour(now).alias("snapshot_hour"),
        F.minute(now).alias("snapshot_minute"),
        now.alias("snapshot_timestamp"),
    ]
    return wide.agg(*aggs).select(*head, "*")


def dashboard_snapshot(
    ev: DataFrame, det: DataFrame, as_of: str | datetime, views: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """One row: snapshot time, totals, and one ordered array of records per section.

    Without ``views`` both rollups are built in one pass each and written once: all sections read those
    small tables, and the rows themselves only for the newest ones (top-k)."""
    if views is None:
        views = RU.views_from_rollups(materialize(RU.event_rollup(ev), "event-rollup"), materialize(RU.detection_rollup(det), "detection-rollup"))
    return _assembled(snapshot_sections(ev, det, as_of, views), as_of, SECTION_FIELDS)


def dashboard_stats(snapshot: DataFrame, endpoints: DataFrame) -> dict[str, DataFrame]:
    """Q5: response form of the newest snapshot: totals default 0, records per
    section, hostnames added to the recent events and detections."""
    newest = snapshot.orderBy(F.col("snapshot_timestamp").desc()).limit(1)
    out = {
        "totals": newest.select(
            F.coalesce("total_events", F.lit(0)).alias("eventCount"),
            F.coalesce("total_detections", F.lit(0)).alias("detectionCount"),
            F.col("snapshot_timestamp").alias("lastUpdated"),
        )
    }
    for name in SECTION_FIELDS:
        rows = newest.select(F.posexplode(name).alias("pos", "r")).select(
            (F.col("pos") + 1).alias("rank"), "r.*"
        )
        if name in ("recent_events", "recent_detections"):
            rows = add_hostnames(rows, endpoints)
        out[name] = rows
    return out
