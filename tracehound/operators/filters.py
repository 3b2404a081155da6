"""Row filters: optional equality/time-range conditions, IN lists, recency, search.

All values are bound as literals (never spliced into SQL text).  Filters on the stored
tables are plain predicates, so Catalyst pushes them into the Parquet scan; time-range
filters also add the ``month`` partition predicate when the input carries that column,
which prunes whole month directories.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import search as search_expr
from ..functions.scalars import to_ts, yyyymm


def _ts(v) -> Column:
    return to_ts(v)


def _month_bounds(df: DataFrame, from_, to) -> Column | None:
    if "month" not in df.columns:
        return None
    cond = None
    if from_:
        cond = F.col("month") >= yyyymm(_ts(from_))
    if to:
        c = F.col("month") <= yyyymm(_ts(to))
        cond = c if cond is None else cond & c
    return cond


def filter_time(df: DataFrame, from_, to, col: str = "timestamp") -> DataFrame:
    """inclusive time range, with the months it lies in where ``df`` has them."""
    if from_:
        df = df.where(F.col(col) >= _ts(from_))
    if to:
        df = df.where(F.col(col) <= _ts(to))
    months = _month_bounds(df, from_, to)
    return df if months is None else df.where(months)


def multi_filter(df: DataFrame, filters: Mapping[str, object]) -> DataFrame:
    """AND of ``col == value`` for every truthy value (empty/0/None means no filter)."""
    for col, value in filters.items():
        if value:
            df = df.where(F.col(col) == F.lit(value))
    return df


def filter_events(
    ev: DataFrame,
    endpoint_id: str | None = None,
    event_type: str | None = None,
    username: str | None = None,
    from_: str | datetime | None = None,
    to: str | datetime | None = None,
) -> DataFrame:
    """optional equality on endpoint, type, user; inclusive time range."""
    df = multi_filter(ev, {"endpoint_id": endpoint_id, "event_type": event_type, "user": username})
    return filter_time(df, from_, to)


def filter_detections(
    det: DataFrame,
    events: DataFrame | None = None,
    severity: int | None = None,
    rule_id: str | None = None,
    endpoint_id: str | None = None,
    from_: str | datetime | None = None,
    to: str | datetime | None = None,
    username: str | None = None,
) -> DataFrame:
    """Detections filtered like events; ``username`` keeps detections on
    endpoints where that user has any event (left semi join)."""
    df = multi_filter(det, {"severity": severity, "rule_id": rule_id, "endpoint_id": endpoint_id})
    df = filter_time(df, from_, to)
    if username:
        if events is None:
            raise ValueError("username filter needs the events table")
        eps = events.where(F.col("user") == F.lit(username)).select("endpoint_id").distinct()
        df = df.join(eps, "endpoint_id", "left_semi")
    return df


def filter_in(df: DataFrame, col: str, values: Iterable | DataFrame) -> DataFrame:
    """``col IN (values)``.  A literal list is a predicate that is pushed to the scan
    (Spark plans a long one as a set lookup); values in a DataFrame, however many, are the
    right side of a left semi join."""
    if isinstance(values, DataFrame):
        right = values.select(F.col(values.columns[0]).alias(col)).distinct()
        return df.join(right, col, "left_semi")
    vals = list(dict.fromkeys(values))
    return df.where(F.col(col).isin(vals)) if vals else df.where(F.lit(False))


def recent_days(df: DataFrame, as_of: str | datetime | date, days: int = 1, col: str = "date") -> DataFrame:
    """F8: ``date >= to_date(as_of) - days``."""
    return df.where(F.col(col) >= F.date_sub(F.to_date(_ts(as_of)), days))


def recent_hours(df: DataFrame, as_of: str | datetime, hours: int = 24, col: str = "last_seen") -> DataFrame:
    """``col >= as_of - hours`` (the bound itself is kept)."""
    return df.where(F.col(col) >= _ts(as_of) - F.expr(f"INTERVAL {int(hours)} HOURS"))


def search_rows(df: DataFrame, term: str | None, cols: Sequence[str]) -> DataFrame:
    """case-insensitive substring search over ``cols`` (OR)."""
    return df.where(search_expr(cols, term))


def get_by_id(df: DataFrame, id_value: str, col: str = "id") -> DataFrame:
    """point lookup."""
    return df.where(F.col(col) == F.lit(id_value))
