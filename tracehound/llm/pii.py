"""Personal data: patterns propose spans, checksums confirm them, context words score them.

Everything is a Column expression over one row (no shuffle, no Python).  Kinds:

* ``email``, ``ip`` (parts at most 255), ``card`` (16 to 19 digits passing Luhn), ``phone``
  (8 to 15 digits): leftmost non-overlapping matches; a match that fails its check is dropped.
* added by this method: ``iban`` (passes mod-97) and ``ssn`` (issuable number groups, kept
  only where a context word stands near it).

A span's score is its kind's base value plus a bonus when one of the kind's context words
stands in the 40 characters before it; spans below ``THRESHOLD`` are left out.

Null and empty texts have no spans.  Rows are independent, so ties, repeated rows and
repeated ids need no rule; extra columns pass through, one named like the result is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sqltext import let, match_starts, quoted, running_max

THRESHOLD = 0.5
CONTEXT_CHARS = 40
CONTEXT_BONUS = 0.2
SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def small_parts(match: Column) -> Column:
    """Every dotted part is a number up to 255, leading zeros allowed."""
    part = lambda p: let(F.ltrim(p, F.lit("0")), lambda s: (F.length(s) <= 3) & (F.coalesce(s.try_cast("int"), F.lit(0)) <= 255))
    return F.forall(F.split(match, r"\."), part)


def luhn(match: Column) -> Column:
    """16 to 19 digits whose Luhn sum is a multiple of 10."""

    def doubled(d: Column) -> Column:
        return F.when(d > 4, d * 2 - 9).otherwise(d * 2)

    def total(s: Column) -> Column:
        return F.aggregate(
            F.transform(
                F.split(F.reverse(s), ""),
                lambda c, i: F.when(i % 2 == 1, doubled(c.try_cast("int"))).otherwise(c.try_cast("int")),
            ),
            F.lit(0),
            lambda a, x: a + F.coalesce(x, F.lit(0)),
        )

    return let(digits(match), lambda s: F.when(F.length(s).between(16, 19), total(s) % 10 == 0).otherwise(False))


def phone_length(match: Column) -> Column:
    return F.length(digits(match)).between(8, 15)


def mod97(match: Column) -> Column:
    """ISO 7064 mod 97-10 over the account number with its first four characters moved last."""

    def rest(s: Column) -> Column:
        chars = F.split(F.concat(F.substr(s, F.lit(5)), F.substr(s, F.lit(1), F.lit(4))), "")
        value = lambda c: F.ascii(c) - F.when(c >= "A", 55).otherwise(48)
        return F.aggregate(
            F.filter(chars, lambda c: c != ""),
            F.lit(0),
            lambda a, c: (F.when(c >= "A", a * 100).otherwise(a * 10) + value(c)) % 97,
        )

    return let(F.replace(match, F.lit(" "), F.lit("")), lambda s: F.length(s).between(15, 34) & (rest(s) == 1))


def issuable_ssn(match: Column) -> Column:
    area = F.substr(match, F.lit(1), F.lit(3))
    return (
        ~area.isin("000", "666") & ~area.startswith("9")
        & (F.substr(match, F.lit(5), F.lit(2)) != "00") & (F.substr(match, F.lit(8)) != "0000")
    )


@dataclass(frozen=True)
class Kind:
    """``pattern`` is what is found; ``java`` is the same language written so that the JVM's
    matcher needs neither deep recursion nor repeated scans of one long run."""

    name: str
    pattern: str
    java: str
    needs: str
    check: object
    base: float
    context: tuple[str, ...]


# The patterns, their checks and the context words.  In `java`, a match starts
# at a run's first character or directly behind the last match, and runs are possessive.
KINDS = (
    Kind("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
         r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         "@", None, 0.7, ("mail", "contact", "write")),
    Kind("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
         ".", small_parts, 0.5, ("ip", "host", "server", "address")),
    Kind("card", r"[0-9]([\x20-]?[0-9])+",
         r"[0-9](?:[\x20-]?[0-9])++",
         "", luhn, 0.7, ("card", "visa", "credit", "payment")),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]",
         r"\+[0-9][\x20().0-9-]+[0-9]",
         "+", phone_length, 0.6, ("phone", "call", "tel", "mobile")),
    Kind("iban", r"[A-Z]{2}[0-9]{2}( ?[A-Z0-9]{4}){2,7}( ?[A-Z0-9]{1,3})?",
         r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
         "", mod97, 0.8, ("iban", "account", "bank")),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
         r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
         "-", issuable_ssn, 0.4, ("ssn", "social security")),
)
BASE_KINDS = tuple(k.name for k in KINDS[:4])


def kind_spans(text: Column, kind: Kind) -> Column:
    """Confirmed and scored spans of one kind in ``text`` (not null), by start."""
    found = F.regexp_extract_all(text, F.lit(kind.java), F.lit(0))

    def confirmed(matches: Column) -> Column:
        gaps = F.transform(F.split(text, kind.java, -1), lambda p: F.length(p))
        lengths = F.transform(matches, lambda m: F.length(m))
        spans = let(
            match_starts(F.slice(gaps, F.lit(1), F.size(matches)), lengths),
            lambda starts: F.zip_with(matches, starts, lambda m, s: F.struct(m.alias("m"), s.alias("s"))),
        )
        if kind.check is not None:
            spans = F.filter(spans, lambda x: kind.check(x["m"]))

        def scored(x: Column) -> Column:
            before = F.lower(F.substr(text, F.greatest(x["s"] - CONTEXT_CHARS + 1, F.lit(1)), F.least(x["s"], F.lit(CONTEXT_CHARS))))
            near = F.lit(False)
            for word in kind.context:
                near = near | before.contains(word)
            return F.struct(
                F.lit(kind.name).alias("kind"),
                x["s"].cast("int").alias("start"),
                (x["s"] + F.length(x["m"])).cast("int").alias("end"),
                F.round(F.lit(kind.base) + F.when(near, CONTEXT_BONUS).otherwise(0.0), 6).alias("score"),
            )

        return F.filter(F.transform(spans, scored), lambda x: x["score"] >= THRESHOLD)

    spans = let(found, lambda ms: F.when(F.size(ms) > 0, confirmed(ms)).otherwise(F.array().cast(SPAN)))
    if kind.needs:
        return F.when(F.contains(text, F.lit(kind.needs)), spans).otherwise(F.array().cast(SPAN))
    return spans


def find_pii(df: DataFrame, text_col: str = "text", out_col: str = "pii") -> DataFrame:
    """Add ``out_col``: all spans (kind, start, end in code points, score), by kind as listed
    in ``KINDS``, then by start."""
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    return df.withColumn(out_col, F.concat(*[kind_spans(text, k) for k in KINDS]))


def redact(df: DataFrame, text_col: str = "text", spans_col: str = "pii") -> DataFrame:
    """Replace every span by its kind in brackets; overlapping spans become one, named after
    the first.  Texts without spans, null ones included, stay as they are."""
    text, spans = F.col(quoted(text_col)), F.col(quoted(spans_col))

    def merged(xs: Column) -> Column:
        """Spans that start behind all earlier ones open a group; its end is the largest end before the next."""
        ends = F.transform(xs, lambda x: x["end"])
        marked = F.zip_with(xs, running_max(ends), lambda x, reach: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), reach.alias("before"), (x["start"] >= reach).alias("opens")))
        last = F.array_max(ends)
        return let(
            F.filter(marked, lambda x: x["opens"]),
            lambda heads: F.concat(
                F.array_join(F.transform(heads, lambda h: F.concat(F.substr(text, h["before"] + 1, h["start"] - h["before"]), F.lit("["), F.upper(h["kind"]), F.lit("]"))), ""),
                F.substr(text, last + 1, F.greatest(F.length(text) - last, F.lit(0))),
            ),
        )

    by_start = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return df.withColumn(text_col, F.when(F.size(spans) > 0, let(by_start, merged)).otherwise(text))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
