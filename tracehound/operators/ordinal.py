"""Global order without a single-task window, in one exchange.

``Window.orderBy(...)`` with no ``partitionBy`` moves every row into one task.  The
functions here give the same answers from buckets of consecutive rows:

1. :func:`split_keys` takes the bounds of the buckets once, from a sample of the *unique*
   key: about the same number of rows falls between any two, even if one endpoint or one
   millisecond holds a third of the data.  The number of buckets follows the number of rows.
2. The bounds are literals of the plan, so a row's bucket is an expression of its key
   (a binary search): every use of the plan, and every repeated task, deals a row alike.
   ``repartitionById`` sends bucket ``b`` to task ``b``: the one exchange.
3. :func:`next_rows` runs ``lead`` inside the buckets.  What follows a bucket's last rows are
   the first rows of the next ones; they are found in the same exchange and come back as
   one small row a bucket (:data:`MAX_BUCKETS` at most, so the broadcast is bounded).
4. :func:`with_ordinal` adds the rows of the buckets before to the place in the bucket.

Nothing is written or kept between the steps.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 500_000
ROWS_PER_SMALL_BUCKET = 20_000  # while there are fewer buckets than cores
MAX_BUCKETS = 100_000
KEYS_PER_BUCKET = 64
MAX_KEYS = 400_000  # sampled keys that reach the driver


@dataclass(frozen=True)
class Key:
    """One part of an order: nulls first if ascending, last if descending."""

    column: Column
    ascending: bool = True

    def order(self) -> Column:
        return self.column.asc() if self.ascending else self.column.desc()


def _keys(order_cols: Sequence[str | Column | Key]) -> list[Key]:
    return [c if isinstance(c, Key) else Key(F.col(c) if isinstance(c, str) else c) for c in order_cols]


def bucket_count(rows: int, cores: int) -> int:
    """Buckets for a number of rows: enough for the cores, then of a fixed size, then of a fixed number."""
    small = min(cores, -(-rows // ROWS_PER_SMALL_BUCKET))
    return max(1, min(MAX_BUCKETS, max(small, -(-rows // ROWS_PER_BUCKET))))


def split_keys(df: DataFrame, keys: Sequence[Key], buckets: int | None = None) -> list[tuple]:
    """First keys of all buckets but the first, ascending in the order of ``keys``."""
    named = [f"k{i}" for i in range(len(keys))]
    narrow = df.select(*[k.column.alias(n) for k, n in zip(keys, named, strict=True)])
    rows = narrow.count()
    if buckets is None:
        buckets = bucket_count(rows, df.sparkSession.sparkContext.defaultParallelism)
    if buckets <= 1 or not rows:
        return []
    share = min(1.0, 1.2 * min(KEYS_PER_BUCKET * buckets, MAX_KEYS) / rows)
    order = [F.col(n).asc() if k.ascending else F.col(n).desc() for k, n in zip(keys, named, strict=True)]
    sample = (narrow if share == 1.0 else narrow.sample(share, seed=1)).repartition(1).sortWithinPartitions(*order).collect()
    picked = [tuple(sample[len(sample) * b // buckets]) for b in range(1, buckets)] if sample else []
    return list(dict.fromkeys(picked))


def _literal(value) -> str:
    """SQL text of a value of a key."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, int):
        return f"{value}L"
    if isinstance(value, float):
        return f"double('{value!r}')"
    if isinstance(value, dt.datetime):
        zone = value if value.tzinfo else value.astimezone()
        return f"timestamp_micros({round((zone - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) / dt.timedelta(microseconds=1))}L)"
    if isinstance(value, dt.date):
        return f"date_from_unix_date({(value - dt.date(1970, 1, 1)).days})"
    if isinstance(value, str):
        return f"decode(X'{value.encode().hex()}', 'UTF-8')" if value else "''"
    raise TypeError(f"a key of type {type(value).__name__} cannot bound a bucket")


def bucket_of(df: DataFrame, keys: Sequence[Key], splits: Sequence[tuple]) -> Column:
    """Number of splits at or before a row's key: a binary search in a literal array."""
    if not splits:
        return F.lit(0)
    kinds = [f.dataType.simpleString() for f in df.select(*[k.column.alias(f"k{i}") for i, k in enumerate(keys)]).schema]
    rows = ", ".join("named_struct(" + ", ".join(f"'k{i}', cast({_literal(v)} as {kind})" for i, (v, kind) in enumerate(zip(s, kinds, strict=True))) + ")" for s in splits)
    array = F.expr(f"array({rows})")
    mine = [F.struct(k.column.alias("k")) for k in keys]  # structs compare nulls, too: before all values

    def before(split: Column) -> Column:
        """split <= row, part by part"""
        out = F.lit(True)
        for i in range(len(keys) - 1, -1, -1):
            theirs = F.struct(split[f"k{i}"].alias("k"))
            first, second = (theirs, mine[i]) if keys[i].ascending else (mine[i], theirs)
            out = (first < second) | ((first == second) & out)
        return out

    def step(found: Column, _) -> Column:
        middle = F.floor((found["lo"] + found["hi"]) / 2).cast("int")
        take = (found["lo"] < found["hi"]) & before(F.element_at(array, middle + 1))
        return F.struct(
            F.when(take, middle + 1).otherwise(found["lo"]).alias("lo"),
            F.when(take | (found["lo"] >= found["hi"]), found["hi"]).otherwise(middle).alias("hi"),
        )

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(splits)).alias("hi"))
    steps = F.sequence(F.lit(1), F.lit(len(splits).bit_length()))
    return F.aggregate(steps, start, step, lambda found: found["lo"])


def _bucketed(df: DataFrame, keys: Sequence[Key], buckets: int | None) -> tuple[DataFrame, int]:
    """``df`` with its bucket ``_b``, not yet exchanged, and the number of buckets."""
    splits = split_keys(df, keys, buckets)
    return df.withColumn("_b", bucket_of(df, keys, splits)), len(splits) + 1


def with_ordinal(
    df: DataFrame,
    order_cols: Sequence[str | Column | Key],
    name: str = "_ord",
    num_partitions: int | None = None,
) -> DataFrame:
    """Add a dense 0-based row number in ``order_cols`` order (key must be unique).

    Equivalent to ``row_number() over (order by order_cols) - 1`` but without pulling
    the table into one task.  The rows before a bucket are a table of one row a bucket.
    """
    keys = _keys(order_cols)
    rows, n = _bucketed(df, keys, num_partitions)
    counts = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))  # combined before the exchange
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy(*[k.order() for k in keys]))
    return (
        rows.repartitionById(n, "_b").withColumn(name, place)
        .join(F.broadcast(starts), "_b")
        .withColumn(name, F.col("_start") + F.col(name) - 1)
        .drop("_b", "_start")
    )


def next_rows(
    df: DataFrame,
    order_cols: Sequence[str],
    k: int,
    payload: Sequence[str],
    partition_cols: Sequence[str] = (),
    prefix: str = "_next",
    num_partitions: int | None = None,
) -> DataFrame:
    """For every row, structs of the next ``k`` rows (``{prefix}1`` … ``{prefix}k``).

    The order is ``partition_cols + order_cols`` (must be unique).  With
    ``partition_cols`` a following row with another partition key is not a successor
    and gives null, exactly as ``lead`` over ``partitionBy(partition_cols)``, but a hot
    partition key is spread over many balanced buckets instead of one task.
    """
    names = [*partition_cols, *order_cols]
    rows, n = _bucketed(df, _keys(names), num_partitions)
    fields = list(dict.fromkeys([*partition_cols, *payload]))
    row = F.struct(*[F.col(c) for c in fields])
    bucketed = rows.repartitionById(n, "_b")
    within = Window.partitionBy("_b").orderBy(*names)
    leads = [f"_lead{i}" for i in range(1, k + 1)]
    found = bucketed.select("*", *[F.lead(row, i).over(within).alias(c) for i, c in enumerate(leads, 1)])
    if n == 1:
        nexts = [F.col(c) for c in leads]
    else:
        # the first k rows of a bucket, then for each bucket those of the (non-empty) ones behind it
        first = bucketed.withColumn("_r", F.row_number().over(within)).where(F.col("_r") <= k)
        heads = first.groupBy("_b").agg(F.array_sort(F.collect_list(F.struct("_r", row.alias("row")))).alias("_heads"))
        behind = Window.orderBy("_b").rowsBetween(1, k)
        after = heads.select("_b", F.flatten(F.collect_list(F.transform("_heads", lambda h: h["row"])).over(behind)).alias("_after"))
        found = found.join(F.broadcast(after), "_b", "left")
        left = sum(F.col(c).isNotNull().cast("int") for c in leads)  # rows behind this one in its bucket, k at most
        nexts = [F.coalesce(F.col(c), F.get("_after", F.lit(i - 1) - left)) for i, c in enumerate(leads, 1)]
    if partition_cols:
        same = lambda x: [x[c].eqNullSafe(F.col(c)) for c in partition_cols]
        nexts = [F.when(_all(same(x)), x) for x in nexts]
    return found.select(*df.columns, *[x.alias(f"{prefix}{i}") for i, x in enumerate(nexts, 1)])


def _all(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def next_rows_single_window(
    df: DataFrame,
    order_cols: Sequence[str],
    k: int,
    payload: Sequence[str],
    partition_cols: Sequence[str] = (),
    prefix: str = "_next",
) -> DataFrame:
    """Reference form of :func:`next_rows` with a plain ``lead`` window.

    With no ``partition_cols`` this runs in one task: kept for tests that prove the
    bucketed form equal, not for production use.
    """
    fields = list(dict.fromkeys(list(partition_cols) + list(payload)))
    w = Window.orderBy(*order_cols)
    if partition_cols:
        w = Window.partitionBy(*partition_cols).orderBy(*order_cols)
    row = F.struct(*[F.col(c) for c in fields])
    return df.select("*", *[F.lead(row, i).over(w).alias(f"{prefix}{i}") for i in range(1, k + 1)])
