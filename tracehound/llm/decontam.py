"""Benchmark decontamination as a prefix-filtered set join.

A benchmark item is cut into windows of ``window`` consecutive words (an item with fewer, but
not none, is one window).  A window is the set of its word shingles; since a document must
hold all of them, one shingle is the necessary prefix, and the rarest in the corpus is taken
(shingle counts come from a first pass over all documents).  The second pass probes each
document's rolling shingles with the prefixes, applies the positional and length bounds (the
window must lie inside the document) and verifies every word of the candidate window.

Documents are never shuffled: windows go to the tasks in blocks of at most ``block_windows``
(window, item) pairs, one pass over the documents a block, so what is broadcast has a fixed
bound however large the benchmark is, and a passage in a third of all documents costs each of
them the same.

Null and empty texts have no words and no hits; items without words have no windows; an item
whose id is null hits but is listed nowhere; repeated items count once; rows are independent,
so repeated documents get equal results.  Other columns pass through; one named like the
result column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import map_rows, shared
from .sqltext import quoted
from .textkit import ALNUM_SEPARATORS, rolling, slices, window_starts, words_of

SHINGLE = 3
WINDOW = 10
BLOCK_WINDOWS = 400_000
RESULT = "struct<n_words:bigint,n_hit:bigint,starts:array<int>,ends:array<int>,item_ids:array<string>>"


def item_windows(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(words, item): each distinct window of each item, words as packed 64-bit word hashes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                w = words_of(batch.column(1), ALNUM_SEPARATORS)
                items, packed, owner = batch.column(0).to_pylist(), [], []
                for i, (a, b) in enumerate(zip(w.offsets[:-1], w.offsets[1:], strict=True)):
                    for s in range(a, max(b - window, a) + 1 if b > a else a):
                        packed.append(w.hash[s : min(s + window, b)].tobytes())
                        owner.append(items[i])
                yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), pa.array(owner, pa.string())], ["words", "item"])

    return benchmark.select(F.col(quoted(id_col)).cast("string").alias("item"), F.col(quoted(text_col)).alias("text")).mapInArrow(cut, "words binary, item string").distinct()


class Block:
    """One block of windows, ready for probing."""

    def __init__(self, rows: list, window: int):
        windows = sorted({bytes(r["words"]) for r in rows})
        number = {w: i for i, w in enumerate(windows)}
        self.items: list[list[str]] = [[] for _ in windows]
        for r in rows:
            if r["item"] is not None:
                self.items[number[bytes(r["words"])]].append(r["item"])
        self.length = np.array([len(w) // 8 for w in windows], dtype=np.int64)
        self.words = np.zeros((len(windows), window), np.uint64)
        for i, w in enumerate(windows):
            self.words[i, : len(w) // 8] = np.frombuffer(w, np.uint64)
        self.probes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}

    def size_of(self, i: int) -> int:
        return min(SHINGLE, int(self.length[i]))

    def shingles(self) -> dict[int, np.ndarray]:
        """Shingle size -> sorted distinct hashes."""
        out: dict[int, list[np.ndarray]] = {}
        for i in range(len(self.length)):
            out.setdefault(self.size_of(i), []).append(rolling(self.words[i, : self.length[i]], self.size_of(i)))
        return {k: np.unique(np.concatenate(v)) for k, v in out.items()}

    def choose(self, counts: dict[tuple[int, int], int]) -> None:
        """Take each window's rarest shingle (the first of equals) as its prefix."""
        found: dict[int, list[tuple[int, int, int]]] = {}
        for i in range(len(self.length)):
            k = self.size_of(i)
            hs = [int(h) for h in rolling(self.words[i, : self.length[i]], k)]
            at = min(range(len(hs)), key=lambda j: (counts.get((k, hs[j]), 0), j))
            found.setdefault(k, []).append((hs[at], i, at))
        for k, xs in found.items():
            xs.sort()
            h, i, at = (np.array(c, dtype=kind) for c, kind in zip(zip(*xs, strict=True), (np.uint64, np.int64, np.int64), strict=True))
            distinct, first = np.unique(h, return_index=True)
            self.probes[k] = (distinct, np.append(first, len(h)), i, at)


def shingle_counts(texts: DataFrame, held) -> DataFrame:
    """(size, hash, n): how often each benchmark shingle stands in the documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held()
        sums = {k: np.zeros(len(v), np.int64) for k, v in known.items()}
        for whole in batches:
            for batch in slices(whole, "text"):
                w = words_of(batch.column(0), ALNUM_SEPARATORS)
                for k, v in known.items():
                    starts, _ = window_starts(w.offsets, k)
                    r = rolling(w.hash, k)[starts]
                    at = np.minimum(np.searchsorted(v, r), len(v) - 1)
                    np.add.at(sums[k], at[v[at] == r], 1)
        for k, v in known.items():
            some = np.flatnonzero(sums[k])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(some), k, np.int32)), pa.array(v[some].view(np.int64)), pa.array(sums[k][some])], ["size", "hash", "n"])

    return texts.mapInArrow(count, "size int, hash bigint, n bigint").groupBy("size", "hash").agg(F.sum("n").alias("n"))


def row_hits(block: Block, h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(global word index, window number) of every verified window in the batch."""
    starts, numbers = [], []
    for k, (distinct, first, number, inside) in block.probes.items():
        at, rows = window_starts(offsets, k)
        r = rolling(h, k)[at]
        found = np.minimum(np.searchsorted(distinct, r), len(distinct) - 1)
        hit = np.flatnonzero(distinct[found] == r)
        if not len(hit):
            continue
        found = found[hit]
        times = first[found + 1] - first[found]
        pick = np.repeat(first[found], times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        begin, row, n = np.repeat(at[hit], times) - inside[pick], np.repeat(rows[hit], times), number[pick]
        inside_row = (begin >= offsets[row]) & (begin + block.length[n] <= offsets[row + 1])
        begin, n = begin[inside_row], n[inside_row]
        good = np.ones(len(begin), bool)
        for j in range(block.words.shape[1]):
            within = j < block.length[n]
            good &= ~within | (h[np.minimum(begin + j, len(h) - 1)] == block.words[n, j])
        starts.append(begin[good])
        numbers.append(n[good])
    empty = np.zeros(0, np.int64)
    return (np.concatenate(starts), np.concatenate(numbers)) if starts else (empty, empty)


def scan_block(docs: DataFrame, text_col: str, result: str, held, last: bool, keep_text: bool) -> DataFrame:
    """Add (or extend) ``result`` by the hits of one block."""
    names = [n for n in docs.columns if n != result and (keep_text or not last or n != text_col)]
    schema = T.StructType([docs.schema[n] for n in names] + [T.StructField(result, T._parse_datatype_string(RESULT))])
    earlier = result in docs.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = held()
        for whole in batches:
            for batch in slices(whole, text_col):
                at = {n: batch.schema.get_field_index(n) for n in batch.schema.names}
                w = words_of(batch.column(at[text_col]), ALNUM_SEPARATORS)
                begin, number = row_hits(block, w.hash, w.offsets)
                mask = np.zeros(len(w.hash) + 1, np.int64)
                np.add.at(mask, begin, 1)
                np.add.at(mask, begin + block.length[number], -1)
                mask = np.cumsum(mask)[:-1] > 0
                row = np.searchsorted(w.offsets, begin, side="right") - 1
                named: dict[int, set[str]] = {}
                for r, n in set(zip(row.tolist(), number.tolist(), strict=True)):
                    named.setdefault(r, set()).update(block.items[n])
                old = batch.column(at[result]).to_pylist() if earlier else None
                out = []
                touched = set(row.tolist())
                for i in range(batch.num_rows):
                    a, b = w.offsets[i], w.offsets[i + 1]
                    own = mask[a:b] if i in touched else None
                    items = named.get(i, set())
                    if old and old[i]["n_hit"]:
                        own = np.zeros(b - a, bool) if own is None else own.copy()
                        for s, e in zip(old[i]["starts"], old[i]["ends"], strict=True):
                            own[s:e] = True
                        items = items | set(old[i]["item_ids"])
                    if own is None:
                        out.append({"n_words": b - a, "n_hit": 0, "starts": [], "ends": [], "item_ids": []})
                        continue
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
                    out.append({"n_words": b - a, "n_hit": int(own.sum()), "starts": edge[::2].tolist(), "ends": edge[1::2].tolist(), "item_ids": sorted(items)})
                kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("item_ids", pa.list_(pa.string()))])
                yield pa.RecordBatch.from_arrays([batch.column(at[n]) for n in names] + [pa.array(out, kind)], [*names, result])

    return map_rows(docs, scan, schema)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_windows: int = BLOCK_WINDOWS,
    result: str = "contamination",
    keep_text: bool = True,
) -> DataFrame:
    """Add ``result``: n_words, n_hit, hit word ranges (starts, ends exclusive) and the ids
    (as strings, sorted) of the items with a window in the text."""
    spark = docs.sparkSession
    docs = docs.drop(result)
    texts = docs.select(F.col(quoted(text_col)).alias("text"))  # of the table itself, without the scans of earlier blocks
    pairs = item_windows(benchmark, item_id_col, item_text_col, window)
    blocks = max(1, -(-pairs.count() // block_windows))
    for b in range(blocks):
        block = Block(pairs.where(F.pmod(F.xxhash64("words", "item"), F.lit(blocks)) == b).collect(), window)
        shingles = block.shingles()
        counted = shingle_counts(texts, shared(spark, shingles)).collect() if shingles else []
        block.choose({(r["size"], int(np.int64(r["hash"]).view(np.uint64))): r["n"] for r in counted})
        docs = scan_block(docs, text_col, result, shared(spark, block), b == blocks - 1, keep_text)
    return docs
