"""Event sources (S1, S2, S6): raw message streams, generator files, stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.parse import parse_variant_events
from ..session import configure
from .sinks import SCHEMAS, table_store


def read_raw_events(
    spark: SparkSession,
    path: str | None = None,
    fmt: str = "text",
    stream: bool = True,
    **options,
) -> DataFrame:
    """Raw event messages as one string column ``value``.

    ``fmt="kafka"`` reads a broker topic from the earliest offset (the Kafka connector
    jar must be on the classpath; options such as ``kafka.bootstrap.servers`` and
    ``subscribe`` are passed through).  ``fmt="text"`` reads files with one JSON
    message per line, the same contract without a broker.
    """
    configure(spark)
    reader = spark.readStream if stream else spark.read
    if fmt == "kafka":
        opts = {"startingOffsets": "earliest", **options}
        return reader.format("kafka").options(**opts).load().select(F.col("value").cast("string").alias("value"))
    if fmt == "text":
        src = reader.options(**options)
        return src.text(path) if path is not None else src.format("text").load()
    raise ValueError(f"unsupported raw event format {fmt!r}")


def read_event_file(spark: SparkSession, path: str, default_ts_ms=None) -> DataFrame:
    """Generator files holding one (pretty-printed) JSON array of events each.

    Each array element becomes one VARIANT row (``singleVariantColumn``), which the
    common parser then coerces exactly like stream messages.  A multi-line JSON file is
    read by one task; parallelism comes from the number of files.
    """
    configure(spark)
    raw = (
        spark.read.option("multiLine", True)
        .option("singleVariantColumn", "value")
        .json(path)
    )
    v = F.col("value")
    elements = F.when(
        F.schema_of_variant(v).startswith("ARRAY"), F.variant_get(v, "$", "array<variant>")
    ).otherwise(F.array(v))
    records = raw.select(F.explode(elements).alias("value"))
    return parse_variant_events(records, "value", default_ts_ms)


def load_table(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """A stored table; filters on ``month`` prune directories, other predicates are pushed into
    the Parquet reader.  Parquet folders that another program wrote are read as they are."""
    configure(spark)
    if name in SCHEMAS:
        store = table_store(spark, path, name)
        if store.exists():
            return store.read()
        # fixed schema: no inference pass over the files
        return spark.read.schema(T.StructType([*SCHEMAS[name].fields, T.StructField("month", T.IntegerType())])).parquet(path)
    return spark.read.parquet(path)
