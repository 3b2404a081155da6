"""Line deduplication: range-partitioned hashes, sorted by document and position, read as a stream.

Each long line is one narrow row (128-bit hash of its key, document, text, position).  The rows are
range-partitioned and sorted by (hash, document descending, position), so that one frequent line is
cut into as many ranges as its rows need.  Each range is then read once, in order: the first document
of a hash keeps its lines, and once ``min_docs`` documents were met the lines of the others go.  Only
the first and the last hash of a range can go on in a neighbour; such rows are settled by a table of at
most two rows a range.  The result is a compressed bitmap for each text that loses lines, not the text.

Defined results: a null or empty text is one empty line; rows of one id count as one document, each with
its own bitmap (rows of equal id and text share one); a row without an id counts as no document and
loses every line that repeats in ``min_docs`` others; very long texts and lines travel as hashes only;
an empty table gives no bitmaps; extra columns pass through unread, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch
from .sqltext import ascii_lower, quoted

MIN_CHARS = 40
MIN_DOCS = 5
# Fixed values: [\x20\x09-\x0D]
BLANKS = " \t\n\x0b\x0c\r"
GONE, OPEN, EDGE = 0, 1, 2
MARKS = "kind int, h1 bigint, h2 bigint, id bigint, text_hash bigint, pos int, docs array<bigint>"


def long_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """One row a line whose key has at least ``min_chars`` code points."""
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    lines = docs.select(
        F.col(quoted(id_col)).cast("bigint").alias("id"), F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n")).alias("pos", "line"),
    )
    keys = lines.withColumn("line", F.btrim("line", F.lit(BLANKS))).where(F.length("line") >= min_chars).withColumn("line", ascii_lower(F.col("line")))
    return keys.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "id", "text_hash", "pos")


class _Hash:
    """The hash whose rows are being read: its first document, some distinct documents, rows held back."""

    def __init__(self, h1: int, h2: int, leads: bool, top: int | None):
        self.key, self.leads, self.top = (h1, h2), leads, top
        self.seen: list[int] = []
        self.held: list[tuple[np.ndarray, ...]] = []


def _reader(min_docs: int):
    """Arrow function over the sorted rows of one range; holds no more than one batch and the rows of
    ``min_docs - 1`` documents of one hash."""
    schema = pa.schema([
        ("kind", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("id", pa.int64()), ("text_hash", pa.int64()), ("pos", pa.int32()),
        ("docs", pa.list_(pa.int64())),
    ])

    def marks(kind: int, key, rows: tuple[np.ndarray, ...], docs=None) -> pa.RecordBatch:
        ids, known, texts, pos = rows
        n = len(ids)
        h1, h2 = (pa.array(np.full(n, k), pa.int64()) for k in key) if key else (pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()))
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(n, kind, np.int32)), h1, h2, pa.array(ids, pa.int64(), mask=~known), pa.array(texts, pa.int64()), pa.array(pos, pa.int32()),
            pa.array(docs, pa.list_(pa.int64())) if docs is not None else pa.nulls(n, pa.list_(pa.int64())),
        ], schema=schema)

    def edge(group: _Hash) -> pa.RecordBatch:
        blank = (np.zeros(1, np.int64), np.zeros(1, bool), np.zeros(1, np.int64), np.zeros(1, np.int32))
        return marks(EDGE, group.key, blank, [group.seen])

    def extend(group: _Hash, rows: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        ids, known = rows[0], rows[1]
        if len(group.seen) < min_docs:
            distinct = ids[known][np.append(True, np.diff(ids[known]) != 0)] if known.any() else ids[:0]
            group.seen = list(dict.fromkeys([*group.seen, *distinct[: min_docs + 1].tolist()]))[:min_docs]
        if group.leads:  # the documents before these may be in the range before
            yield marks(OPEN, group.key, rows)
            return
        other = ~known if group.top is None else ~known | (ids != group.top)
        rows = tuple(x[other] for x in rows)
        if len(group.seen) < min_docs:
            group.held.append(rows)
            return
        for held in [*group.held, rows]:
            yield marks(GONE, None, held)
        group.held = []

    def close(group: _Hash | None, last: bool) -> Iterator[pa.RecordBatch]:
        if group is None or not (group.leads or last):
            return
        for held in group.held:
            yield marks(OPEN, group.key, held)
        yield edge(group)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: _Hash | None = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            h1, h2, texts, pos = (col[c].to_numpy(zero_copy_only=False) for c in ("h1", "h2", "text_hash", "pos"))
            known = ~np.asarray(col["id"].is_null())
            ids = col["id"].fill_null(0).to_numpy(zero_copy_only=False)
            opens = np.flatnonzero(np.append(True, (np.diff(h1) != 0) | (np.diff(h2) != 0)))
            ends = np.append(opens[1:], n)

            def part(a: int, b: int) -> tuple[np.ndarray, ...]:
                return ids[a:b], known[a:b], texts[a:b], pos[a:b]

            for number in [0] if len(opens) == 1 else [0, len(opens) - 1]:
                a, b = int(opens[number]), int(ends[number])
                key = (int(h1[a]), int(h2[a]))
                if group is None or group.key != key:
                    yield from close(group, last=False)
                    group = _Hash(*key, leads=group is None, top=int(ids[a]) if known[a] else None)
                if number and len(opens) > 2:  # the hashes between lie wholly in this batch
                    lo, hi = int(ends[0]), a
                    first = opens[1:-1]
                    of = np.repeat(np.arange(len(first)), np.diff(np.append(first, hi)))
                    new = known[lo:hi].copy()
                    new[1:] &= (of[1:] != of[:-1]) | (ids[lo + 1 : hi] != ids[lo : hi - 1])
                    enough = np.bincount(of, weights=new, minlength=len(first)) >= min_docs
                    gone = enough[of] & (~known[lo:hi] | (ids[lo:hi] != ids[first][of]))
                    yield marks(GONE, None, tuple(x[gone] for x in part(lo, hi)))
                yield from extend(group, part(a, b))
        yield from close(group, last=True)

    return read


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Positions that go -> zlib-compressed bits, 1 for a line that stays, up to the last that goes."""
    for batch in batches:
        dropped, bitmaps = [], []
        for positions in batch.column("positions"):
            gone = np.unique(np.asarray(positions.values))
            keep = np.ones((int(gone[-1]) // 8 + 1) * 8, np.uint8)  # whole bytes: the rest of the last one stays, too
            keep[gone] = 0
            dropped.append(len(gone))
            bitmaps.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("text_hash"), pa.array(dropped, pa.int64()), pa.array(bitmaps, pa.binary())], names=["id", "text_hash", "n_dropped", "keep"],
        )


def line_bitmaps(
    docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
    partitions: int | None = None,
) -> DataFrame:
    """(id, text_hash, n_dropped, keep): a row for each text that loses a line.

    Lines whose key (stripped, A-Z lowered) has at least ``min_chars`` code points and is found in at
    least ``min_docs`` documents go, except in the largest id that holds the key."""
    order = ["h1", "h2", F.col("id").desc_nulls_last(), "pos"]
    rows = long_lines(docs, id_col, text_col, min_chars)
    ranges = (rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)).sortWithinPartitions(*order)
    marked = scratch.keep("marks", ranges.mapInArrow(_reader(min_docs), MARKS))
    # at most two rows a range, each with at most min_docs ids: bounded by the number of ranges
    edges = marked.where(F.col("kind") == EDGE).groupBy("h1", "h2").agg(F.array_distinct(F.flatten(F.collect_list("docs"))).alias("docs"))
    repeated = edges.where(F.size("docs") >= min_docs).select("h1", "h2", F.array_max("docs").alias("top"))
    settled = (
        marked.where(F.col("kind") == OPEN).join(F.broadcast(repeated), ["h1", "h2"])
        .where(~F.col("id").eqNullSafe(F.col("top"))).select("id", "text_hash", "pos")
    )
    gone = marked.where(F.col("kind") == GONE).select("id", "text_hash", "pos").unionByName(settled)
    texts = gone.groupBy("id", "text_hash").agg(F.collect_list("pos").alias("positions"))
    return texts.mapInArrow(_pack, "id bigint, text_hash bigint, n_dropped bigint, keep binary")


@F.pandas_udf(T.StringType())
def _kept(text: pd.Series, keep: pd.Series) -> pd.Series:
    def one(t, bitmap):
        if bitmap is None or t is None:
            return None
        lines = t.split("\n")
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[: len(lines)]
        return "\n".join([line for line, bit in zip(lines, bits, strict=False) if bit] + lines[len(bits) :])

    return pd.Series([one(t, b) for t, b in zip(text, keep, strict=True)], dtype=object)


def drop_lines(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_col: str = "lines") -> DataFrame:
    """``docs`` with ``out_col``: struct of n_lines (before), n_dropped and the text that stays.

    Only texts that lose lines pass through Python."""
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    right = bitmaps.select(
        F.col("id").alias("_lines_id"), F.col("text_hash").alias("_lines_hash"), F.col("n_dropped").alias("_lines_dropped"), F.col("keep").alias("_lines_keep"),
    )
    same = F.col(quoted(id_col)).cast("bigint").eqNullSafe(F.col("_lines_id")) & (F.xxhash64(text) == F.col("_lines_hash"))
    kept = F.coalesce(_kept(F.when(F.col("_lines_keep").isNotNull(), text), F.col("_lines_keep")), text)
    lines = F.struct(
        (F.length(text) - F.length(F.translate(text, "\n", "")) + 1).cast("bigint").alias("n_lines"),
        F.coalesce("_lines_dropped", F.lit(0)).cast("bigint").alias("n_dropped"),
        kept.alias("text"),
    )
    names = [F.col(quoted(c)) for c in docs.columns if c != out_col]
    return docs.join(right, same, "left").select(*names, lines.alias(out_col))
