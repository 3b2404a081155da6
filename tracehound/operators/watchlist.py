"""F11 with a long list: rows whose text contains any of many patterns, in one pass.

A list of a few names is an OR of ``contains`` (``functions.predicates``).  For a table of
patterns each is found by its end: its last n characters, for the longest n of ``LEVELS`` that it
has.  A name that contains a pattern contains that end, so only names with the end among their
n-grams are candidates, and ``contains`` decides; a pattern as long as a level is its own end, so
its candidates are its hits.  Work is on distinct names; a name that fills a third of the rows is
looked up once.

Names have many n-grams and patterns few: a bit map of fixed size over the hashes of all ends goes
to every task, and n-grams that miss it are never exchanged.  Nothing else is broadcast: Spark
takes the exploded n-grams for as small as the file they come from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

LEVELS = (*range(1, 9), 12, 16, 24, 32, 48, 64, 96, 128, 192, 256)
BITS = 1 << 24  # of the bit map, in words of 64


def _grams(text: Column, n: Column) -> Column:
    """Distinct n-grams of a text, none if it is shorter."""
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, n)))


def _word(gram: Column) -> Column:
    return F.floor(F.pmod(F.xxhash64(gram), F.lit(BITS)) / 64).cast("int")


def _bit(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(64)).cast("int")


def candidates(names: DataFrame, ends: DataFrame) -> DataFrame:
    """(name, gram): the n-grams of each ``name`` that may be among the ``gram`` of ``ends``, n being any ``level`` of these."""
    levels = ends.agg(F.collect_set("level").alias("levels"))  # one row
    marks = ends.groupBy(_word(F.col("gram")).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(pmod(xxhash64(gram), 64) AS INT))")).alias("bits"))
    grams = names.crossJoin(F.broadcast(levels)).select("name", F.explode(F.flatten(F.transform("levels", lambda n: _grams(F.col("name"), n)))).alias("gram"))
    return (
        grams.withColumn("word", _word(F.col("gram"))).join(F.broadcast(marks), "word")  # at most BITS / 64 rows
        .where(F.getbit("bits", _bit(F.col("gram"))) == 1).select("name", "gram")
    )


def matching_names(names: DataFrame, patterns: DataFrame) -> DataFrame:
    """(name, pattern): for each distinct lower-case ``name`` the least pattern that it contains.

    ``names`` and ``patterns`` have one text column; nulls match nothing, nor does an empty pattern."""
    low = lambda df: df.select(F.lower(df.columns[0]).alias("t")).where("t IS NOT NULL").distinct()
    n, p = low(names).withColumnRenamed("t", "name"), low(patterns).withColumnRenamed("t", "pattern").where("pattern <> ''")
    level = F.array_max(F.filter(F.array(*map(F.lit, LEVELS)), lambda x: x <= F.length("pattern")))
    # written once: read for the levels, the bit map and the join
    ends = materialize(p.withColumn("level", level).select("pattern", "level", F.expr("substr(pattern, -level)").alias("gram")), "watch-list")
    # both sides grow: a sort-merge join at every size
    hits = candidates(n, ends).join(ends.hint("merge"), "gram").where(F.contains("name", "pattern"))
    return hits.groupBy("name").agg(F.min("pattern").alias("pattern"))


def on_watch_list(df: DataFrame, col: str, patterns: DataFrame, out_col: str = "watch_pattern") -> DataFrame:
    """``df`` with ``out_col``: the least pattern that the text of ``col`` contains, whatever the case, else null."""
    found = matching_names(df.select(col), patterns).withColumnRenamed("pattern", out_col).withColumnRenamed("name", "_watch_name")
    return df.withColumn("_watch_name", F.lower(col)).join(found.hint("merge"), "_watch_name", "left").drop("_watch_name")
