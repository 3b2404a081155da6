"""Bounded "first k distinct values per key" without gathering a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _keys(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


SALT_BUCKETS = 32


def smallest_distinct(
    df: DataFrame, keys: str | Sequence[str], value: str, k: int = 10, alias: str | None = None,
    salts: int = SALT_BUCKETS,
) -> DataFrame:
    """Per key, the ``k`` smallest distinct values as a sorted array.

    Distinct (key, value) pairs are ranked inside (key, salt) groups, salt = hash(value)
    mod ``salts``; at most ``k`` survive per salt, so the final per-key list is built
    from at most ``k * salts`` values even for a key holding a third of the table.
    """
    keys = _keys(keys)
    alias = alias or value
    pairs = df.select(*keys, value).distinct()
    salted = pairs.withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(salts)))
    w = Window.partitionBy(*keys, "_salt").orderBy(value)
    top = salted.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    return top.groupBy(*keys).agg(
        F.slice(F.array_sort(F.collect_list(value)), 1, k).alias(alias)
    )
