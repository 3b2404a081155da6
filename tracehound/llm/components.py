"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


SALTS = 4  # a node with many edges meets its minimum in this many tasks


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges (a, b) with the minimum ``m`` of ``a``: a node's edges are dealt by their other end."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return edges.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).join(least.withColumn("salt", salts), ["a", "salt"]).drop("salt")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _with_least(both.where("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return (
        _with_least(edges, least).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        .unionByName(least.select("a", F.col("m").alias("b"))).distinct()
    )


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, component) for every node of an undirected edge, component = its smallest node.

    ``edges`` has two bigint columns.  The number of steps grows with the logarithm of the
    longest path; each is two joins on a node and its minimum, and is written to the scratch
    folder, so a lost executor costs one step."""
    x, y = edges.columns
    norm = edges.where(F.col(x) != F.col(y)).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct()
    state = scratch.keep(name, norm)
    while True:
        # done when every node points at one root and no root points anywhere
        loose = state.groupBy("a").agg(F.count("*").alias("n"))
        open_ends = loose.where("n > 1").select("a").unionByName(state.select(F.col("b").alias("a")).join(loose, "a", "left_semi")).limit(1).count()
        if not open_ends:
            break
        state = scratch.keep(name, _small_star(_large_star(state)))
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        state.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
