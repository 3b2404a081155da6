"""Ordering, paging and top-k.

``orderBy(...).offset(n).limit(m)`` and ``orderBy(...).limit(m)`` plan as
``TakeOrderedAndProject``: each task keeps its own top ``n + m`` rows and only those
reach the final merge, so a top-k never sorts the table.  Every order ends with a
unique key so results are reproducible.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordinal import Key


def _order(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def newest_first(time_col: str = "timestamp", key: str = "id") -> list[Column]:
    return [F.col(time_col).desc(), F.col(key).asc()]


def page(df: DataFrame, order: Sequence[str | Column], limit: int = 100, offset: int = 0) -> DataFrame:
    """``ORDER BY order LIMIT limit OFFSET offset``."""
    out = df.orderBy(*_order(order))
    if offset:
        out = out.offset(int(offset))
    return out.limit(int(limit))


def latest(df: DataFrame, n: int = 20, time_col: str = "timestamp", key: str = "id") -> DataFrame:
    """The ``n`` newest rows (ties by key)."""
    return df.orderBy(*newest_first(time_col, key)).limit(int(n))


def top_k(df: DataFrame, k: int, by: str, key: str | Sequence[str]) -> DataFrame:
    """``k`` rows with the largest ``by``; ties by key ascending."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.orderBy(F.col(by).desc(), *[F.col(c).asc() for c in keys]).limit(int(k))


def sort_nulls_last(df: DataFrame, col: str, ascending: bool = True, key: str | None = None) -> DataFrame:
    """Sort one column either way with missing values last in both directions."""
    return df.orderBy(*nulls_last(df, col, ascending, key))


def nulls_last(df: DataFrame, col: str, ascending: bool = True, key: str | None = None) -> list[Column]:
    """The order of :func:`sort_nulls_last`; text is compared as a reader expects (letters before
    case and accents), not by code point."""
    c = F.collate(F.col(col), "UNICODE") if dict(df.dtypes)[col] == "string" else F.col(col)
    return [c.asc_nulls_last() if ascending else c.desc_nulls_last(), *([F.col(key).asc()] if key else [])]


def nulls_last_keys(df: DataFrame, col: str, ascending: bool = True, key: str | None = None) -> list[Key]:
    """The same order for :func:`operators.ordinal.with_ordinal`."""
    c = F.collate(F.col(col), "UNICODE") if dict(df.dtypes)[col] == "string" else F.col(col)
    return [Key(F.col(col).isNull()), Key(c, ascending), *([Key(F.col(key))] if key else [])]


def after(keys: Sequence[Key], cursor: Sequence) -> Column:
    """Condition: the row comes after ``cursor`` (the key values of the last row seen).

    The part on the first key alone stands beside the full comparison, so that it reaches the scan."""
    if len(keys) != len(cursor):
        raise ValueError("a cursor has one value for each key")
    if cursor[0] is None and keys[0].ascending:
        bound = F.lit(True)
    elif cursor[0] is None:
        bound = keys[0].column.isNull()
    elif keys[0].ascending:
        bound = keys[0].column >= F.lit(cursor[0])
    else:
        bound = (keys[0].column <= F.lit(cursor[0])) | keys[0].column.isNull()
    rest = F.lit(False)
    for key, value in reversed(list(zip(keys, cursor, strict=True))):
        mine, theirs = F.struct(key.column.alias("k")), F.struct(F.lit(value).alias("k"))  # compare nulls, too
        if value is None:  # nulls come first if ascending, last if descending
            later, same = (key.column.isNotNull() if key.ascending else F.lit(False)), key.column.isNull()
        else:
            later, same = (mine > theirs if key.ascending else mine < theirs), key.column.eqNullSafe(F.lit(value))
        rest = later | (same & rest)
    return bound & rest


def page_after(df: DataFrame, keys: Sequence[Key], cursor: Sequence | None = None, limit: int = 100) -> DataFrame:
    """W8 for deep pages: the ``limit`` rows behind ``cursor`` in the order of ``keys`` (which end with
    a unique one), from the start if there is none.

    No row before the cursor is held, sorted or sent: each task keeps its next ``limit`` rows, whatever
    the page.  A ``month`` column is bounded with a leading timestamp."""
    rows = df
    if cursor is not None:
        rows = df.where(after(keys, cursor))
        if "month" in df.columns and isinstance(cursor[0], datetime):
            month = F.lit(cursor[0].year * 100 + cursor[0].month)
            rows = rows.where(F.col("month") >= month if keys[0].ascending else F.col("month") <= month)
    return rows.orderBy(*[k.order() for k in keys]).limit(int(limit))


def newest_keys(time_col: str = "timestamp", key: str = "id") -> list[Key]:
    """The order of :func:`newest_first` for cursors."""
    return [Key(F.col(time_col), False), Key(F.col(key))]


def page_count(df: DataFrame, size: int = 10) -> DataFrame:
    """Number of pages of ``size`` rows (one-row result)."""
    return df.agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("bigint").alias("pages"))


def page_number(df: DataFrame, order: Sequence[str | Column], page_no: int, size: int = 10) -> DataFrame:
    """Rows of 1-based page ``page_no``."""
    return page(df, order, limit=size, offset=(page_no - 1) * size)


def first_n(col: str | Column, n: int = 5) -> Column:
    """The first ``n`` elements of an array column."""
    c = F.col(col) if isinstance(col, str) else col
    return F.slice(c, 1, n)
