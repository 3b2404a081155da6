"""Raw JSON text -> stored event (P1-P9): parse, coerce, quarantine, normalise.

Parsing uses Spark's VARIANT functions, so one JSON parse per record serves all eleven
fields and everything stays in the JVM.  Coercion follows the reference parser:

* text fields: missing -> ``''``; JSON null -> the text ``null``; object or array ->
  ``''``; numbers and booleans -> their text;
* ``bytes`` and ``timestamp``: numbers (fractions truncated) and numeric text are read
  as longs; anything else falls back to the default (0, resp. ``default_ts_ms``);
* ``id``: missing or null -> a deterministic id derived from the raw text (a replay
  then yields the same id, unlike a random UUID);
* text that is not JSON at all is split off into a quarantine frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import EVENT_COLUMNS

TEXT_FIELDS = (
    "endpoint_id",
    "event_type",
    "status",
    "direction",
    "source_ip",
    "destination_ip",
    "process_name",
    "user",
)

NORMALISED_FIELDS = ("event_type", "status", "direction", "process_name")


def _field(v: Column, name: str) -> Column:
    return F.variant_get(v, f"$.{name}", "variant")


def _text_from_node(node: Column) -> Column:
    kind = F.schema_of_variant(node)
    return (
        F.when(node.isNull(), F.lit(""))
        .when(F.is_variant_null(node), F.lit("null"))
        .when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.lit(""))
        .otherwise(F.coalesce(F.try_variant_get(node, "$", "string"), F.lit("")))
    )


def _id_from_node(node: Column, id_default: Column) -> Column:
    kind = F.schema_of_variant(node)
    return (
        F.when(node.isNull() | F.is_variant_null(node), id_default)
        .when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.lit(""))
        .otherwise(F.coalesce(F.try_variant_get(node, "$", "string"), id_default))
    )


def _long_from_node(node: Column, default: Column) -> Column:
    """A whole number, or numeric text ("12.7", "1.7e12"), whose fraction is cut off."""
    text = F.try_variant_get(node, "$", "string").try_cast("double")
    return F.coalesce(F.try_variant_get(node, "$", "bigint"), text.try_cast("bigint"), default)


def _node_columns(df: DataFrame, v: Column, active: Column | None = None) -> DataFrame:
    """One projection extracting each field's VARIANT node (``_n_<field>``), so the
    per-field logic below stays small (large generated methods are not JIT-compiled)."""
    cols = []
    for name in ("id", "timestamp", *TEXT_FIELDS, "bytes"):
        node = _field(v, name)
        cols.append((node if active is None else F.when(active, node)).alias(f"_n_{name}"))
    return df.select("*", *cols)


def _fields_from_nodes(raw: Column, default_ts_ms: Column | None) -> dict[str, Column]:
    if default_ts_ms is None:
        default_ts_ms = F.unix_millis(F.current_timestamp())
    id_default = F.concat(F.lit("gen-"), F.sha2(raw, 256))
    out = {
        "id": _id_from_node(F.col("_n_id"), id_default),
        "timestamp": F.timestamp_millis(_long_from_node(F.col("_n_timestamp"), default_ts_ms)),
    }
    for name in TEXT_FIELDS:
        out[name] = _text_from_node(F.col(f"_n_{name}"))
    out["bytes"] = _long_from_node(F.col("_n_bytes"), F.lit(0).cast("bigint"))
    return out


# Fast path: one ``from_json`` tokenizer pass with the expected types.  A record uses
# it only when it parsed cleanly (no corrupt-record flag) and every text field is
# present, non-null and not object/array text; everything else (missing or null
# fields, type mismatches, non-objects, malformed text) goes through the VARIANT
# path, which distinguishes those cases.  Both paths give identical results.
_FAST_SCHEMA = T.StructType(
    [T.StructField("id", T.StringType()), T.StructField("timestamp", T.LongType())]
    + [T.StructField(f, T.StringType()) for f in TEXT_FIELDS]
    + [T.StructField("bytes", T.LongType()), T.StructField("_corrupt", T.StringType())]
)


def _simple_text(c: Column) -> Column:
    return c.isNotNull() & ~c.startswith("{") & ~c.startswith("[")


def _prepare(raw: DataFrame, col: str) -> DataFrame:
    fast = F.from_json(F.col(col), _FAST_SCHEMA, {"columnNameOfCorruptRecord": "_corrupt"})
    # produced by a generator so later filters are not pushed below it (a pushed
    # filter would re-run the JSON parse once per referenced field)
    staged = raw.select("*", F.inline(F.array(F.struct(fast.alias("_f")))))
    f = F.col("_f")
    ok = f.isNotNull() & f["_corrupt"].isNull() & f["timestamp"].isNotNull() & f["bytes"].isNotNull()
    ok = ok & _simple_text(f["id"])
    for name in TEXT_FIELDS:
        ok = ok & _simple_text(f[name])
    return staged.withColumn("_fast", F.coalesce(ok, F.lit(False))).withColumn(
        "_v", F.when(~F.col("_fast"), F.try_parse_json(F.col(col)))
    )


def split_corrupt(raw: DataFrame, col: str = "value") -> tuple[DataFrame, DataFrame]:
    """(parsable rows, rows that are not JSON).  Parsable rows carry the fast-path
    struct ``_f``, the flag ``_fast`` and, off the fast path, a VARIANT ``_v``."""
    return split_staged(stage(raw, col))


def stage(raw: DataFrame, col: str = "value") -> DataFrame:
    """One parse of each message; :func:`split_staged` and :func:`parse_staged` use it several times."""
    return _prepare(raw, col)


def split_staged(staged: DataFrame) -> tuple[DataFrame, DataFrame]:
    good = staged.where(F.col("_fast") | F.col("_v").isNotNull())
    bad = staged.where(~F.col("_fast") & F.col("_v").isNull()).drop("_f", "_fast", "_v")
    return good, bad


def parse_events(raw: DataFrame, col: str = "value", default_ts_ms: Column | None = None) -> DataFrame:
    """JSON text -> events with the store schema (malformed rows dropped;
    use :func:`parse_events_with_quarantine` to keep them)."""
    good, _ = split_corrupt(raw, col)
    return _from_staged(good, F.col(col), default_ts_ms)


def parse_staged(staged: DataFrame, col: str = "value", default_ts_ms: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, messages that are not JSON) of a staged frame."""
    good, bad = split_staged(staged)
    return _from_staged(good, F.col(col), default_ts_ms), bad


def parse_events_with_quarantine(
    raw: DataFrame, col: str = "value", default_ts_ms: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    good, bad = split_corrupt(raw, col)
    return _from_staged(good, F.col(col), default_ts_ms), bad


def _from_staged(df: DataFrame, raw: Column, default_ts_ms) -> DataFrame:
    nodes = _node_columns(df, F.col("_v"), ~F.col("_fast"))
    slow = _fields_from_nodes(raw, default_ts_ms)
    fast = F.col("_f")
    out = []
    for name, expr in slow.items():
        quick = F.timestamp_millis(fast["timestamp"]) if name == "timestamp" else fast[name]
        out.append(F.when(F.col("_fast"), quick).otherwise(expr).alias(name))
    return with_date(nodes.select(*out)).select(*EVENT_COLUMNS)


def parse_variant_events(df: DataFrame, col: str = "value", default_ts_ms: Column | None = None) -> DataFrame:
    """Events from an already-parsed VARIANT column (e.g. a JSON file source read with
    ``singleVariantColumn``)."""
    return _from_variant(df, col, F.to_json(F.col(col)), default_ts_ms)


def _from_variant(df: DataFrame, vcol: str, raw: Column, default_ts_ms) -> DataFrame:
    nodes = _node_columns(df, F.col(vcol))
    fields = _fields_from_nodes(raw, default_ts_ms)
    return with_date(nodes.select(*[c.alias(n) for n, c in fields.items()])).select(*EVENT_COLUMNS)


def normalize_events(df: DataFrame) -> DataFrame:
    """Lower-case event_type, status, direction and process_name (null stays null);
    ids, users and addresses are untouched."""
    return df.select(
        *[F.lower(F.col(c)).alias(c) if c in NORMALISED_FIELDS else F.col(c) for c in df.columns]
    )


def with_date(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """``date = to_date(timestamp)``."""
    return df.withColumn("date", F.to_date(ts))


def with_month(df: DataFrame, date_col: str = "date") -> DataFrame:
    """Month partition key ``year * 100 + month``."""
    return df.withColumn("month", (F.year(date_col) * 100 + F.month(date_col)).cast("int"))
