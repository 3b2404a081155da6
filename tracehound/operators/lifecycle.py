"""Data lifecycle: retention, truncation, compaction of replaced rows."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import to_ts
from .views import latest_by_key

# Retention of the stored tables in days.
EVENTS_TTL_DAYS = 30
DETECTIONS_TTL_DAYS = 90


def apply_retention(df: DataFrame, days: int, as_of: str | datetime, col: str = "date") -> DataFrame:
    """L1: keep rows whose expiry (midnight of ``date + days``) is not before ``as_of``.

    The predicate compares the bare column with one day, so it prunes row groups; with a
    ``month`` partition column it also skips every month before the first kept day's.
    """
    first_kept = first_kept_day(days, as_of)
    keep = F.col(col) >= first_kept
    if "month" in df.columns:
        keep = keep & (F.col("month") >= _month(first_kept))
    return df.where(keep)


def first_kept_day(days: int, as_of: str | datetime) -> Column:
    """The earliest date whose midnight ``days`` later is not before ``as_of``."""
    return F.date_sub(F.to_date(to_ts(as_of) + F.expr("INTERVAL 1 DAY - INTERVAL 1 MICROSECOND")), days)


def _month(day: Column) -> Column:
    return F.year(day) * 100 + F.month(day)


def expire(spark: SparkSession, path: str, days: int, as_of: str | datetime, table: str = "events") -> list[int]:
    """L1 on a stored table: take wholly expired months out of it, in one step; returns those months.

    Expired days of the first kept month stay stored until the month has expired and are
    left out by :func:`apply_retention`."""
    from ..sources.sinks import table_store

    limit = spark.range(1).select(_month(first_kept_day(days, as_of))).first()[0]
    return table_store(spark, path, table).drop_months(limit)


def truncate_tables(spark: SparkSession, tables: Mapping[str, str | DataFrame] | Iterable[tuple[str, str | DataFrame]], fmt: str = "parquet") -> None:
    """L2: empty every table, keeping its schema: stored tables (path -> "events" or "detections") in one
    step each, plain folders (path -> a frame of its schema) by an empty one with its months."""
    from ..sources.sinks import table_store

    for path, table in tables.items() if isinstance(tables, Mapping) else tables:
        if isinstance(table, str):
            table_store(spark, path, table).create().truncate()
            continue
        writer = spark.createDataFrame([], table.schema).write.mode("overwrite").option("partitionOverwriteMode", "static").format(fmt)
        (writer.partitionBy("month") if "month" in table.columns else writer).save(path)


def compact(
    df: DataFrame,
    keys: str | Sequence[str],
    version: str | Sequence[str],
    out_path: str | None = None,
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """L3: collapse replaced rows (latest version per key) and optionally write them.

    Output goes to a new location: Spark cannot overwrite the path it is reading.  Use
    :func:`compact_months` for a stored table.
    """
    out = latest_by_key(df, keys, version)
    if out_path:
        w = out.write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(out_path)
    return out


def compact_months(
    spark: SparkSession, path: str, table: str, keys: str | Sequence[str], version: str | Sequence[str], months: Sequence[int],
) -> bool:
    """L3 on a stored table: collapse replaced rows of the given months and put one sorted folder in
    place of theirs, in one step.

    May run beside writers and readers: rows stored meanwhile stay as they are, and queries that
    follow the table see no row again.  False if another rewrite of these months came first."""
    from ..sources.sinks import table_store

    return table_store(spark, path, table).rewrite(list(months), lambda rows: latest_by_key(rows, keys, version), "compact")
