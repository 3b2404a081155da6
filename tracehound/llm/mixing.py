"""Mixing sources to target weights by temperature.

The token share p of each source is raised to an exponent a in [0, 1] and normalised: w = p^a /
sum(p^a).  The exponent is bisected: the largest one whose weights still have the target entropy
(a share ``entropy`` of the logarithm of the number of sources), but no smaller than the one
at which the source repeated most stays within ``repetition`` passes.  A round evaluates 15
exponents in one aggregate over the table of sources and returns 15 rows, four bisection steps.

Weights become whole-document schedules: with ``budget`` tokens, source i gets round(budget *
w_i) tokens, as full passes over the source, each in a permutation of its own, and the
beginning of one more permutation, up to the last document that fits.  The cut of that last pass
is a prefix sum in two levels (hash ranges of about ``RANGE_DOCS`` documents, then within a
range), so a source with a third of all rows is spread over many tasks.  Without a budget, the
smallest one that passes over every source at least once is taken, and no document is left out.
A document's place within its source's passes gives its block, so each block holds the sources
in the target proportions; ``slot`` orders a block.

A document counts at least one token, so null and empty texts are scheduled as well.  A null
source is a source.  Rows that share an id get the same places, and repeated rows are scheduled
together (a last pass takes all of them or none).  An empty table has an empty schedule.  Other
columns pass through; those named like a result column are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .sqltext import quoted

ENTROPY = 0.97
REPETITION = 4.0
BLOCK_TOKENS = 1_000_000
RANGE_DOCS = 4096
SEED = 17
ROUNDS = 6  # four binary digits of the exponent each
KEY_SPACE = 1 << 60
RESULTS = ("tokens", "pass", "block", "slot")


def token_count(text: Column) -> Column:
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")
    return F.greatest(F.size(words), F.lit(1)).cast("long")


def order_key(seed: int, number: Column, id_: Column) -> Column:
    """Uniform 60-bit number from the seed, a pass number (or name) and the id."""
    text = F.concat_ws(":", F.lit(str(seed)), number.cast("string"), F.coalesce(id_.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def measures(shares: DataFrame, exponents: list[float]) -> dict[float, tuple[float, float, float]]:
    """exponent -> (entropy, largest / smallest passes, largest passes at a budget of all tokens)."""
    a = F.explode(F.array(*[F.lit(x) for x in exponents])).alias("a")
    q = F.pow("p", "a")
    rows = shares.select("p", a).groupBy("a").agg(
        F.sum(q).alias("z"), F.sum(q * F.log("p")).alias("e"), F.max(F.pow("p", F.col("a") - 1)).alias("hi"), F.min(F.pow("p", F.col("a") - 1)).alias("lo"),
    ).select("a", (F.log("z") - F.col("a") * F.col("e") / F.col("z")).alias("entropy"), (F.col("hi") / F.col("lo")).alias("spread"), (F.col("hi") / F.col("z")).alias("most")).collect()
    return {r["a"]: (r["entropy"], r["spread"], r["most"]) for r in rows}


def bisect(shares: DataFrame, holds, low_side: bool) -> float:
    """Where ``holds`` changes on [0, 1]; the side on which it holds is the low one or the high one."""
    if holds(measures(shares, [1.0])[1.0] if low_side else measures(shares, [0.0])[0.0]):
        return 1.0 if low_side else 0.0
    lo, hi = 0.0, 1.0
    for _ in range(ROUNDS):
        points = [lo + (hi - lo) * i / 16 for i in range(17)]
        at = measures(shares, points[1:-1])
        good = [holds(at[x]) for x in points[1:-1]]
        cut = sum(good) if low_side else 15 - sum(good)
        lo, hi = points[cut], points[cut + 1]
    return lo if low_side else hi


def mixture_weights(
    counts: DataFrame, source_col: str, scratch: Scratch, entropy: float | None, repetition: float | None, budget: int | None,
) -> tuple[DataFrame, int]:
    """(source, docs, tokens, weight, quota) from (source, docs, tokens), and the budget."""
    total, sources = counts.agg(F.sum("tokens"), F.count("*")).first()
    if not sources:
        return counts.select(source_col, "docs", "tokens", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("quota")), 0
    shares = counts.select((F.col("tokens") / F.lit(float(total))).alias("p"))
    a = 1.0
    if entropy is not None:
        a = bisect(shares, lambda m: m[0] >= entropy * math.log(sources), low_side=True)
    if repetition is not None:
        if budget is not None and budget > repetition * total:
            raise ValueError("the budget needs more passes than the repetition limit allows, whatever the weights")
        passes = (lambda m: m[1]) if budget is None else (lambda m: m[2] * budget / total)
        a = max(a, bisect(shares, lambda m: passes(m) <= repetition, low_side=False))
    raised = F.pow(F.col("tokens") / F.lit(float(total)), F.lit(a))
    z = counts.agg(F.sum(raised)).first()[0]
    weighted = counts.withColumn("weight", raised / F.lit(z))
    if budget is None:
        budget = weighted.agg(F.max(F.ceil(F.col("tokens") / F.col("weight") - 0.5))).first()[0]
    quota = F.round(F.lit(float(budget)) * F.col("weight")).cast("long")
    return scratch.keep("weights", weighted.select(source_col, "docs", "tokens", "weight", quota.alias("quota"))), int(budget)


def last_pass_cuts(docs: DataFrame, plan: DataFrame, source: str) -> DataFrame:
    """(source, cut): the largest key of the last, partial pass that is still inside the quota."""
    left = plan.where("rest > 0").select(F.col(source).alias("s"), "rest", "full", F.ceil(F.col("docs") / RANGE_DOCS).cast("long").alias("ranges"))
    keyed = docs.join(left, F.col(source).eqNullSafe(F.col("s"))).withColumn("key", order_key(SEED, F.col("full"), F.col("id")))
    width = F.expr(f"({KEY_SPACE} + ranges - 1) div ranges")
    keyed = keyed.withColumn("width", width).withColumn("range", F.expr("key div width"))
    units = keyed.groupBy("s", "rest", "range", "key").agg(F.sum("tokens").alias("tokens"))
    ranges = units.groupBy("s", "range").agg(F.sum("tokens").alias("t"))
    before = ranges.select(F.col("s").alias("bs"), F.col("range").alias("br"), F.coalesce(
        F.sum("t").over(Window.partitionBy("s").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = units.join(before, F.col("s").eqNullSafe(F.col("bs")) & (F.col("range") == F.col("br")) & (F.col("before") < F.col("rest")))
    upto = F.col("before") + F.sum("tokens").over(Window.partitionBy("s", "range").orderBy("key"))
    return placed.withColumn("upto", upto).where("upto <= rest").groupBy("s").agg(F.max("key").alias("cut"))


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", entropy: float | None = ENTROPY,
    repetition: float | None = REPETITION, budget: int | None = None, block_tokens: int = BLOCK_TOKENS, keep_text: bool = False,
) -> DataFrame:
    """The schedule: a row for each document and pass, with tokens, pass, block and slot.

    Sorted by (block, slot) it is the order of training."""
    scratch = Scratch(docs.sparkSession, "mixing")
    docs = docs.drop(*[c for c in RESULTS if c not in (id_col, text_col, source_col)])
    sized = docs.withColumn("tokens", token_count(F.col(quoted(text_col))))
    narrow = scratch.keep("sizes", sized.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(source_col)).alias("src"), "tokens"))
    counts = narrow.groupBy("src").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"))
    weights, budget = mixture_weights(scratch.keep("counts", counts), "src", scratch, entropy, repetition, budget)
    plan = weights.withColumn("full", F.expr("quota div tokens")).withColumn("rest", F.expr("quota % tokens"))
    cuts = last_pass_cuts(narrow, plan, "src")
    plan = scratch.keep("plan", plan.join(cuts, F.col("src").eqNullSafe(F.col("s")), "left").select(
        F.col("src").alias("_mix_source"), F.col("tokens").alias("_mix_tokens"), F.col("quota").alias("_mix_quota"), F.col("full").alias("_mix_full"),
        F.col("cut").alias("_mix_cut")))
    scratch.drop("plan")
    rows = sized if keep_text else sized.drop(text_col)
    joined = rows.join(plan, F.col(quoted(source_col)).eqNullSafe(F.col("_mix_source")))
    passes = F.sequence(F.lit(0).cast("long"), F.col("_mix_full"))
    scheduled = joined.withColumn("pass", F.explode(passes)).withColumn("_mix_key", order_key(SEED, F.col("pass"), F.col(quoted(id_col))))
    scheduled = scheduled.where((F.col("pass") < F.col("_mix_full")) | (F.col("_mix_key") <= F.col("_mix_cut")))
    blocks = max(1, -(-budget // block_tokens))
    place = (F.col("pass") + F.col("_mix_key") / F.lit(float(KEY_SPACE))) * F.col("_mix_tokens") / F.col("_mix_quota")
    block = F.least(F.floor(place * F.lit(float(blocks))), F.lit(blocks - 1)).cast("long")
    slot = order_key(SEED, F.concat(F.lit("slot"), F.col("pass").cast("string")), F.col(quoted(id_col)))
    return scheduled.withColumn("block", block).withColumn("slot", slot).drop("_mix_source", "_mix_tokens", "_mix_quota", "_mix_full", "_mix_cut", "_mix_key")
