"""A training corpus from ``documents``: toxicity, near duplicates, benchmark passages,
personal data, source mixture.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next one's ``docs``.  A stage begins by releasing what the driver still holds of the
one before.  All but the last return the columns of documents.  Null and empty texts pass every
filter; a row without an id is never a duplicate; repeated rows and texts of equal shingles keep
their smallest id; very long texts are read whole; an empty table stays empty; extra columns are
kept, whatever their names (those that begin with ``_pipeline`` are the stages' own).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracehound.llm import decontam, mixing, near_dup, pii, toxicity
from tracehound.llm.scratch import Scratch, release
from tracehound.llm.sqltext import quoted
from tracehound.session import configure

WORK = "_pipeline"  # prefix of columns that a stage adds and drops again


def columns(docs: DataFrame) -> list:
    """References to all columns, whatever their names."""
    return [F.col(quoted(c)) for c in docs.columns]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches their language's cut go."""
    release(spark)
    model = toxicity.fit_toxicity(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model, out_col=f"{WORK}_score")
    lang = F.col("lang") if "lang" in docs.columns else F.lit("")
    return scored.where(~F.coalesce(toxicity.toxic_by_language(model, F.col(f"{WORK}_score"), lang), F.lit(False))).select(*columns(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked at 0.8 over five-word shingles the smallest id stays, one text of it;
    of rows that share id and text the first by their columns stays.  Texts that only share an id are not
    linked, so each group keeps a row."""
    release(spark)
    scratch = Scratch(spark, "pipeline-texts")
    order = [F.col(quoted(c)) for c, kind in docs.dtypes if not any(x in kind for x in ("map<", "variant", "interval"))]
    # the row limit is applied before the exchange, too: a task sends one row of an id and text
    first = docs.where("doc_id IS NOT NULL").withColumn(f"{WORK}_row", F.row_number().over(Window.partitionBy("doc_id", "text").orderBy(*order)))
    # numbers are read from the written table, as another computation could deal them otherwise
    rows = scratch.keep("rows", first.where(F.col(f"{WORK}_row") == 1).drop(f"{WORK}_row").withColumn(f"{WORK}_key", F.monotonically_increasing_id()))
    found = near_dup.near_duplicates(rows.select(f"{WORK}_key", "text"), id_col=f"{WORK}_key", words=5, threshold_pct=80)
    named = rows.select(F.col(f"{WORK}_key").alias("id"), F.struct("doc_id", F.xxhash64("text").alias("hash"), F.col(f"{WORK}_key").alias("key")).alias("place"))
    stays = found.join(named, "id").groupBy("component_id").agg(F.min("place").alias("place")).select(F.col("place.key").alias(f"{WORK}_key"))
    # kept texts grow with the corpus: a sort-merge join at every size
    return rows.join(stays.hint("merge"), f"{WORK}_key", "left_semi").select(*columns(docs)).unionByName(docs.where("doc_id IS NULL"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    release(spark)
    found = decontam.find_contamination(docs, read(spark, sf_dir, "benchmark"), result=f"{WORK}_hits")
    return found.where(F.col(f"{WORK}_hits")["n_hit"] == 0).select(*columns(docs))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind; n_chars follows the new text."""
    release(spark)
    found = pii.find_pii(docs, out_col=f"{WORK}_pii")
    clean = pii.redact(found, spans_col=f"{WORK}_pii")
    if "n_chars" in docs.columns:
        length = F.when(F.size(f"{WORK}_pii") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        clean = clean.withColumn("n_chars", length)
    return clean.select(*columns(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The schedule of what is left: doc_id, source, tokens, pass, block, slot."""
    release(spark)
    return mixing.mix_sources(docs).select("doc_id", "source", "tokens", "pass", "block", "slot")


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("mixture", mix),
]

# A trained classifier decides the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written to the shared folder and read again."""
    scratch = Scratch(configure(spark), "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.keep(name, stage(spark, docs, sf_dir))
        scratch.drop(name)  # the stage before is no longer read
    return docs
