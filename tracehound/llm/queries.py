"""Registered queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure, scratch_table_path
from . import conversations, decontam, licenses, lines, merkle, mixing, near_dup, neighbours, oracles, pii, quality, substring, toxicity, warc
from .scratch import Scratch
from .sqltext import ascii_lower

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return deco


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


@register("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    scored = toxicity.score_toxicity(docs.withColumn("held_out", toxicity.held_out()), model)
    return scored.select(
        "doc_id",
        "held_out",
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
        toxicity.toxic_by_language(model, F.col("toxicity"), F.col("lang")).alias("toxic_by_language"),
    )


@register("op2_warc", oracles.WARC)
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_table_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages", "page_id", "url", "html"), out)
    return warc.read_archive(spark, out, keep_payload=False).select(
        F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to",
    )


@register("op3_substring_dedup", oracles.SUBSTRING)
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"), keep_text=False)
    return kept.withColumnRenamed("id", "doc_id")


@register("op4_decontaminate", oracles.DECONTAM)
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    benchmark = table(spark, sf_dir, "benchmark", "item_id", "text")
    found = decontam.find_contamination(docs, benchmark, keep_text=False)
    c = F.col("contamination")
    return found.select(
        "doc_id",
        c["n_words"].alias("n_words"),
        c["n_hit"].alias("n_hit"),
        F.size(c["item_ids"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(c["item_ids"], ","), 256).alias("items_sha256"),
        (c["n_hit"] > 0).alias("contaminated"),
    )


@register("op5_pii", oracles.PII)
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "pii")
    of = lambda kind: F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("pii", lambda x: x["kind"].isin(*pii.BASE_KINDS))
    return found.select(
        "doc_id",
        *[of(kind) for kind in pii.BASE_KINDS],
        F.sha2(pii.spans_text(base), 256).alias("base_sha256"),
        pii.spans_text(F.col("pii")).alias("spans"),
    )


@register("op6_nearest")
def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return neighbours.nearest(vectors, F.col("vec_id") % 50 == 0)


@register("op7_licenses", oracles.LICENSES)
def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents", "doc_id", "text"))
    base = F.array_sort(F.array_distinct(F.transform("places", lambda x: x["label"])))
    every = F.array_sort(F.array_union(base, F.coalesce("method_labels", F.array().cast("array<string>"))))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda x: x["place"])).alias("first_word"),
        F.array_max(F.transform("places", lambda x: x["place"])).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.round(F.greatest(F.coalesce("coverage", F.lit(0.0)), F.when(F.size("places") > 0, 1.0).otherwise(0.0)), 6).alias("score"),
    )


@register("op9_quality")
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    scored = quality.score_quality(docs.withColumn("held_out", toxicity.held_out()), model, out_col="score")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@register("op10_near_duplicates", oracles.NEAR_DUPLICATES)
def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), words=3, threshold_pct=85)
    return found.select(
        F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


@register("op8_mixing", oracles.MIXING)
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return mixed.select("doc_id", "source", "tokens", "pass", "block", "slot")


@register("op11_line_dedup", oracles.LINES)
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    scratch = Scratch(spark, "lines")
    bitmaps = scratch.keep("bitmaps", lines.line_bitmaps(docs, scratch))
    scratch.drop("bitmaps")
    left = lines.drop_lines(docs, bitmaps)
    return left.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2("lines.text", 256).alias("kept_sha256"))


@register("op12_conversations", oracles.CONVERSATIONS)
def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.damage(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    scratch = Scratch(spark, "conversations")
    report = scratch.keep("report", conversations.repair(rows, scratch))
    scratch.drop("report")
    return report.withColumnRenamed("conv", "conv_id")


@register("op13_merkle", oracles.MERKLE)
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", *merkle.FIELDS)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    low = F.when(F.col("text").isNotNull(), ascii_lower(F.col("text")))
    changed = F.when(tampered, low).otherwise(F.col("text"))
    claim = merkle.leaf_digest([changed if c == "text" else F.col(c) for c in merkle.FIELDS])
    scratch = Scratch(spark, "merkle")
    leaves = scratch.keep("digests", merkle.leaves_of(docs, claim))
    proofs = scratch.keep("proofs", merkle.prove(merkle.build_manifest(leaves, scratch), scratch))
    scratch.drop("proofs")
    return proofs.withColumnRenamed("id", "doc_id")
