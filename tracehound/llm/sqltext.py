"""Column helpers shared by the operators that stay in DataFrame expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALNUM_SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def quoted(name: str) -> str:
    """A column's name as a reference that also holds dots and backticks."""
    return "`" + name.replace("`", "``") + "`"


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; null becomes the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def alnum_words(text: Column) -> Column:
    """Array of the alphanumeric words (ASCII letters and digits, any non-ASCII) in lower case."""
    return F.array_remove(F.split(ascii_lower(text), ALNUM_SEPARATOR), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where ``body`` uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


BLOCK = 256


def running_max(values: Column) -> Column:
    """For each entry of an array the largest of those before it (0 for the first); entries are at least 0.

    Blocks make the work grow with n times the block, not with n squared."""

    def top(xs: Column) -> Column:
        return F.coalesce(F.array_max(xs), F.lit(0))

    def before(vs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(vs) - 1) / BLOCK).cast("int")), lambda b: top(F.slice(vs, b * BLOCK + 1, F.lit(BLOCK))))
        upto = let(blocks, lambda bs: F.transform(bs, lambda x, i: top(F.slice(bs, F.lit(1), i))))
        block = lambda i: F.floor(i / BLOCK).cast("int")
        return let(upto, lambda us: F.transform(vs, lambda x, i: F.greatest(F.element_at(us, block(i) + 1), top(F.slice(vs, block(i) * BLOCK + 1, i % BLOCK)))))

    return let(values, lambda vs: F.when(F.size(vs) > 0, before(vs)).otherwise(vs))


def match_starts(gaps: Column, lengths: Column) -> Column:
    """Start of each match from the text lengths before it (``gaps``) and its own length.

    Prefix sums are taken in blocks, so that the work grows with n * sqrt-like blocks and not
    with n squared."""

    def total(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0), lambda a, x: a + x)

    def starts(g: Column, step: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.expr("0") + F.floor((F.size(step) - 1) / BLOCK).cast("int")),
            lambda b: total(F.slice(step, b * BLOCK + 1, F.lit(BLOCK))),
        )
        return let(
            blocks,
            lambda bs: F.transform(
                g,
                lambda x, i: x
                + total(F.slice(bs, F.lit(1), F.floor(i / BLOCK).cast("int")))
                + total(F.slice(step, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK)),
            ),
        )

    return let(
        F.struct(gaps.alias("g"), F.zip_with(gaps, lengths, lambda a, b: a + b).alias("s")),
        lambda both: starts(both["g"], both["s"]),
    )
