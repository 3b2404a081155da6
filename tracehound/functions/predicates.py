"""Column predicates used by the rules and the query filters."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The suspicious-process watch list of the detection rules (matched as
# case-insensitive substrings of the process name).
SUSPICIOUS_PROCESSES = ("mimikatz", "psexec", "powershell.exe", "cmd.exe", "rundll32.exe")


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def is_suspicious_process(col: str | Column, names: Iterable[str] = SUSPICIOUS_PROCESSES) -> Column:
    """True when the lower-cased name contains any watch-list entry; null gives false.

    A fixed short list compiles to an OR of ``contains`` inside codegen.  For a large
    watch list see ``operators.watchlist.on_watch_list``.
    """
    low = F.lower(_c(col))
    expr = None
    for name in names:
        hit = low.contains(name.lower())
        expr = hit if expr is None else expr | hit
    if expr is None:
        return F.lit(False)
    return F.coalesce(expr, F.lit(False))


def contains_ci(col: str | Column, term: str) -> Column:
    """Case-insensitive substring test; null gives false."""
    return F.coalesce(F.lower(_c(col)).contains(term.lower()), F.lit(False))


def search(cols: Iterable[str | Column], term: str | None) -> Column:
    """OR of case-insensitive ``contains`` over ``cols``; an empty term keeps all rows."""
    if not term:
        return F.lit(True)
    expr = None
    for c in cols:
        hit = contains_ci(c, term)
        expr = hit if expr is None else expr | hit
    return expr if expr is not None else F.lit(True)
