"""Request-level queries of the investigation service (Q1-Q4, Q7-Q11).

Each request is one Spark plan (or a mapping of independent plans) over the stored
tables: filters reach the scan, paging is a top-k, and the detection -> events lookup
is a single join instead of one query per detection.  Per-entity requests filter the
events *before* aggregating, so a detail page reads one endpoint's or one user's rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import views as V
from ..operators.filters import filter_detections, filter_events
from ..operators.joins import attach_events, held_page
from ..operators.rules import RuleRegistry
from ..operators.sorting import latest, newest_first, page
from ..sources.store import Store

LIVE_ROWS = 20
DETAIL_ROWS = 20
WITHIN_MS = max(r.within_ms for r in RuleRegistry.default().rules)  # longest span of a detection's events


def _page_with_events(page_: DataFrame, ev: DataFrame, limit: int, within_ms: int) -> DataFrame:
    """A page of detections, evaluated once, with its events from the time that it spans."""
    return attach_events(held_page(page_, limit), ev, within_ms=within_ms)


def get_events(
    ev: DataFrame,
    limit: int = 100,
    offset: int = 0,
    endpoint_id: str | None = None,
    event_type: str | None = None,
    from_: str | datetime | None = None,
    to: str | datetime | None = None,
    username: str | None = None,
) -> DataFrame:
    """Q1: filtered events, newest first, paged."""
    df = filter_events(ev, endpoint_id, event_type, username, from_, to)
    return page(df, newest_first(), limit, offset)


def live_events(ev: DataFrame, n: int = LIVE_ROWS) -> DataFrame:
    """Q2: the newest ``n`` events (the live feed's poll)."""
    return latest(ev, n)


def get_detections(
    det: DataFrame,
    ev: DataFrame,
    limit: int = 100,
    offset: int = 0,
    severity: int | None = None,
    rule_id: str | None = None,
    endpoint_id: str | None = None,
    from_: str | datetime | None = None,
    to: str | datetime | None = None,
    username: str | None = None,
    with_events: bool = True,
    within_ms: int = WITHIN_MS,
) -> DataFrame:
    """Q3: filtered detections, newest first, paged, each with its events (``within_ms``: the longest
    span of the rules that made them)."""
    df = filter_detections(det, ev, severity, rule_id, endpoint_id, from_, to, username)
    out = page(df, newest_first(), limit, offset)
    return _page_with_events(out, ev, limit, within_ms) if with_events else out


def live_detections(det: DataFrame, ev: DataFrame, n: int = LIVE_ROWS, within_ms: int = WITHIN_MS) -> DataFrame:
    """Q4: the newest ``n`` detections with their events."""
    return _page_with_events(latest(det, n), ev, n, within_ms)


def newest_stored(store: Store, n: int = LIVE_ROWS, where: Column | None = None) -> DataFrame:
    """Q2 / W3 on a stored table: its newest ``n`` rows, from the last months that hold as many."""
    return store.newest(n, lambda rows: latest(rows.select(*store.schema.fieldNames()), n), where)


def list_endpoints(ev: DataFrame) -> DataFrame:
    """Q7: endpoint list from the details view, most recently seen first."""
    a6 = V.endpoint_details_view(ev)
    return a6.select(
        "endpoint_id",
        F.col("primary_user").alias("user"),
        "last_seen",
        F.col("total_events").alias("event_count"),
        "unique_users",
        "recent_event_types",
    ).orderBy(F.col("last_seen").desc(), F.col("endpoint_id"))


def list_users(ev: DataFrame) -> DataFrame:
    """Q9: user list from the details view, most recently seen first."""
    a7 = V.user_details_view(ev)
    return a7.select(
        "user",
        "last_seen",
        F.col("total_events").alias("event_count"),
        "unique_endpoints",
    ).orderBy(F.col("last_seen").desc(), F.col("user"))


class Parts(Mapping):
    """Named answers of one request; each is planned when it is asked for, so an answer that
    needs no detections plans (and runs) none."""

    def __init__(self, parts: dict[str, Callable[[], DataFrame]]):
        self._parts = parts

    def __getitem__(self, name: str) -> DataFrame:
        return self._parts[name]()

    def __iter__(self):
        return iter(self._parts)

    def __len__(self) -> int:
        return len(self._parts)


def _frame(df: DataFrame | Callable[[], DataFrame]) -> DataFrame:
    return df if isinstance(df, DataFrame) else df()


def endpoint_details(
    ev: DataFrame, det: DataFrame | Callable[[], DataFrame], endpoint_id: str, within_ms: int = WITHIN_MS,
) -> Mapping[str, DataFrame]:
    """Q8: details, eventSummary, events, detectionSummary, detections of one endpoint."""
    mine = ev.where(F.col("endpoint_id") == F.lit(endpoint_id))

    def my_det() -> DataFrame:
        return _frame(det).where(F.col("endpoint_id") == F.lit(endpoint_id))

    return Parts({
        "details": lambda: V.endpoint_details_view(mine, write_rollup=False).select(
            "endpoint_id",
            F.col("primary_user").alias("user"),
            "last_seen",
            F.col("total_events").alias("event_count"),
            "unique_event_types",
            "unique_users",
            "recent_event_types",
        ),
        "eventSummary": lambda: V.endpoint_event_summary(V.endpoint_events(mine)).orderBy(
            F.col("event_count").desc(), F.col("event_type")
        ),
        "events": lambda: latest(mine, DETAIL_ROWS),
        "detectionSummary": lambda: V.endpoint_detection_summary(V.endpoint_detections(my_det())),
        "detections": lambda: _page_with_events(latest(my_det(), DETAIL_ROWS), ev, DETAIL_ROWS, within_ms),
    })


def user_recent_endpoints(ev: DataFrame, user: str, k: int = 10) -> DataFrame:
    """J5 first hop: the (at most ``k``) endpoints listed for ``user``."""
    mine = ev.where((F.col("user") == F.lit(user)) & (F.col("user") != ""))
    return V.smallest_distinct(mine, "user", "endpoint_id", k, "recent_endpoints").select(
        F.explode("recent_endpoints").alias("endpoint_id")
    )


def user_details(
    ev: DataFrame, det: DataFrame | Callable[[], DataFrame], user: str, within_ms: int = WITHIN_MS,
) -> Mapping[str, DataFrame]:
    """Q10: details, eventSummary, events, detectionSummary, endpoints, detections of a user.

    The endpoint hop (J5) is a semi join against at most 10 endpoint ids.
    """
    mine = ev.where((F.col("user") == F.lit(user)) & (F.col("user") != ""))

    def detection_summary() -> DataFrame:
        # detections reach a user through every endpoint the user was seen on
        user_pairs = V.user_endpoint_pairs(mine)
        per_user = (
            _frame(det).join(user_pairs.select("endpoint_id"), "endpoint_id", "left_semi")  # this user's endpoints only
            .groupBy("endpoint_id", F.to_date("timestamp").alias("date"), "severity", "rule_id")
            .agg(F.count(F.lit(1)).alias("_n"))
            .join(user_pairs, "endpoint_id")
            .groupBy("user", "date", "severity", "rule_id")
            .agg(F.sum("_n").alias("detection_count"))
        )
        return V.user_detection_summary(per_user)

    def endpoints() -> DataFrame:
        ep_events = ev.join(F.broadcast(user_recent_endpoints(ev, user)), "endpoint_id", "left_semi")  # <= 10 ids
        return V.endpoint_details_view(ep_events, write_rollup=False).select(
            "endpoint_id",
            F.col("primary_user").alias("user"),
            "last_seen",
            F.col("total_events").alias("event_count"),
        )

    def detections() -> DataFrame:
        ep_det = _frame(det).join(F.broadcast(user_recent_endpoints(ev, user)), "endpoint_id", "left_semi")
        return _page_with_events(latest(ep_det, DETAIL_ROWS), ev, DETAIL_ROWS, within_ms)

    return Parts({
        "details": lambda: V.user_details_view(mine, write_rollup=False).select(
            "user",
            "last_seen",
            F.col("total_events").alias("event_count"),
            "unique_event_types",
            "unique_endpoints",
            "recent_endpoints",
        ),
        "eventSummary": lambda: V.user_event_summary(V.user_events(mine)).orderBy(
            F.col("event_count").desc(), F.col("event_type")
        ),
        "events": lambda: latest(mine, DETAIL_ROWS),
        "detectionSummary": detection_summary,
        "endpoints": endpoints,
        "detections": detections,
    })


# Q11: shortcuts by endpoint / by user


def events_by_endpoint(ev: DataFrame, endpoint_id: str, **params) -> DataFrame:
    return get_events(ev, endpoint_id=endpoint_id, **params)


def events_by_user(ev: DataFrame, username: str, **params) -> DataFrame:
    return get_events(ev, username=username, **params)


def detections_by_endpoint(det: DataFrame, ev: DataFrame, endpoint_id: str, **params) -> DataFrame:
    return get_detections(det, ev, endpoint_id=endpoint_id, **params)


def detections_by_user(det: DataFrame, ev: DataFrame, username: str, **params) -> DataFrame:
    return get_detections(det, ev, username=username, **params)
