"""Scalar Column functions (X1-X17): labels, dates, text helpers.  All built-in
expressions, so they stay inside whole-stage codegen."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def to_ts(value) -> Column:
    """Literal or column to a timestamp (text is parsed, ms precision kept)."""
    if isinstance(value, Column):
        return value
    if isinstance(value, datetime):
        return F.lit(value).cast("timestamp")
    if isinstance(value, date):
        return F.lit(value).cast("timestamp")
    if isinstance(value, (int, float)):
        return F.timestamp_millis(F.lit(int(value)))
    return F.to_timestamp(F.lit(str(value)))


def yyyymm(ts: str | Column) -> Column:
    """``toYYYYMM`` = year * 100 + month."""
    c = _c(ts)
    return (F.year(c) * 100 + F.month(c)).cast("int")


def severity_name(col: str | Column) -> Column:
    """1 Low, 2-3 Medium, 4 High, 5 Critical, anything else Unknown."""
    s = _c(col)
    # Severity labels.
    return (
        F.when(s == 1, "Low")
        .when(s.isin(2, 3), "Medium")
        .when(s == 4, "High")
        .when(s == 5, "Critical")
        .otherwise("Unknown")
    )


def title_words(col: str | Column) -> Column:
    """``snake_case`` -> ``Snake Case`` (first letter of each word upper, rest
    unchanged); empty or null -> ``Unknown``."""
    c = _c(col)
    words = F.split(c, "_")
    titled = F.array_join(
        F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))),
        " ",
    )
    return F.when(c.isNull() | (c == ""), "Unknown").otherwise(titled)


def date_label(col: str | Column) -> Column:
    """X11: ``MMM dd, yyyy HH:mm:ss``; null -> Unknown."""
    return F.coalesce(F.date_format(_c(col), "MMM dd, yyyy HH:mm:ss"), F.lit("Unknown"))


def short_id(col: str | Column, n: int = 8) -> Column:
    """First ``n`` characters of an id; empty/null -> Unknown."""
    c = _c(col)
    return F.when(c.isNull() | (c == ""), "Unknown").otherwise(F.substring(c, 1, n))


def truncate_text(col: str | Column, n: int = 30) -> Column:
    """Text longer than ``n`` is cut to ``n`` and ``...`` appended; null -> ''."""
    c = _c(col)
    return (
        F.when(c.isNull(), "")
        .when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("...")))
        .otherwise(c)
    )


def url_host(col: str | Column) -> Column:
    """Host of a URL: the third ``/`` piece when ``//`` occurs, else the first;
    then cut at ``:`` and ``?``.  Empty/null -> ''."""
    c = _c(col)
    piece = F.when(c.contains("//"), F.split(c, "/", -1).getItem(2)).otherwise(
        F.split(c, "/", -1).getItem(0)
    )
    host = F.split(F.split(F.coalesce(piece, F.lit("")), ":", -1).getItem(0), r"\?", -1).getItem(0)
    return F.when(c.isNull() | (c == ""), "").otherwise(host)


def default(col: str | Column, value) -> Column:
    """JS-style fallback ``x || value``: null, '' or 0 give ``value``."""
    c = _c(col)
    falsy = c.isNull()
    if isinstance(value, str):
        falsy = falsy | (c.cast("string") == "")
    else:
        falsy = falsy | (c == 0)
    return F.when(falsy, F.lit(value)).otherwise(c)


def elapsed_seconds(col: str | Column, as_of) -> Column:
    """Whole seconds from ``col`` to ``as_of``."""
    diff = F.unix_micros(to_ts(as_of)) - F.unix_micros(_c(col))
    # exact integer division truncating toward zero, like timestampdiff(SECOND, ...)
    return ((diff - diff % 1000000) / 1000000).cast("bigint")
