"""Substring deduplication with fixed-block anchors.

Words are taken unchanged.  The reference index holds the non-overlapping blocks of ``BLOCK``
words of every document; every rolling window of ``BLOCK`` words probes it.  With windows of
``window`` = 2 * ``BLOCK`` words, any shared window holds a whole reference block of the other
document, so each repeat has an anchor.  Documents are cut in runs of some MB.  Blocks and
probes meet by hash range: a run sends each of its distinct hashes once, with the first place
(a partial minimum) as packed arrays (a few bytes a window instead of a row each, and the ids of the
documents that these windows are in), and a task takes one range of all runs' hashes and answers
each one that other documents share with its first place in the corpus: the smallest document, then
run and place in the run.  A hash in any number of places is
one entry a run there, so a range holds its even share of the windows and at most one entry a
run more for each frequent hash.  Answers go back to their run, which holds the other places.

A hit is then extended along its diagonal: a document's window of 2 * ``BLOCK`` words repeats an
earlier document where its two halves point to places ``BLOCK`` words apart in one and the
same text, and consecutive such windows are one maximal exact repeat.  Halves that point to
different texts (the first places of the halves need not be in the first document with both)
are settled by a second exchange keyed by both places, which is exact: two windows are equal
if and only if both halves have the same first places.

Windows are judged on the input.  The smallest id keeps its words; a text is compared with
smaller ids only, not with itself or with rows of the same id.  Null and empty texts have no
words.  Rows without an id neither remove nor lose words.  Rows that share an id are judged one
by one (repeated rows equally).  Columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .sqltext import quoted
from .textkit import PLAIN_SEPARATORS, mix64, rolling, slices, window_starts, words_of

WINDOW = 50
RUN_BYTES = 4 << 20  # text bytes cut at once
RANGE_BYTES = 12 << 20  # text bytes whose windows one hash range takes
LOW = np.uint64((1 << 48) - 1)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays one behind the other, compressed; each is stored as its own bytes."""
    body = b"".join(a.tobytes() for a in arrays)
    return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def unpacked(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)


def gaps(x: np.ndarray) -> np.ndarray:
    """First differences, which pack well for rising numbers."""
    return np.diff(x, prepend=x.dtype.type(0))


def first_places(h: np.ndarray, row: np.ndarray, pos: np.ndarray, doc: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the first place of each distinct hash, its flags, and of every place the index of its hash's first):
    flag 1 says that a place is a reference block, 2 that several documents hold the hash.  Places come in
    the order of their documents."""
    order = np.argsort(h, kind="stable")
    new = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
    times = np.diff(np.append(new, len(h)))
    anchor = np.maximum.reduceat((pos[order] % block == 0).astype(np.uint8), new)
    several = doc[row[order[new]]] != doc[row[order[new + times - 1]]]
    ref = np.empty(len(h), np.int64)
    ref[order] = np.repeat(order[new], times)
    return order[new], anchor + np.uint8(2) * several.astype(np.uint8), ref


def narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers in 1 or 2 bytes where they fit, else in 8."""
    low, high = (int(x.min()), int(x.max())) if len(x) else (0, 0)
    return x.astype(np.uint8 if high < 256 else np.uint16) if low >= 0 and high < 1 << 16 else x.astype(np.int64)


def probes(texts: DataFrame, block: int, ranges: int) -> DataFrame:
    """(range, run, blob): distinct windows of a run of documents whose hash falls in the range, with
    their first places in the run and the ids of just the documents of these; and once a run, to ranges
    from ``ranges`` on, its documents and further places.  So what a run sends grows with its windows,
    however many ranges there are."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, number = TaskContext.get(), 0
        for whole in batches:
            for batch in slices(whole, "text", RUN_BYTES):
                ids, marks = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 1))
                order = np.lexsort((marks, ids))
                if (np.diff(order) < 0).any():
                    batch, ids, marks = batch.take(pa.array(order)), ids[order], marks[order]
                w = words_of(batch.column(2), PLAIN_SEPARATORS, lower=False)
                at, rows = window_starts(w.offsets, block)
                if not len(at):
                    continue
                run, number = (context.partitionId() << 32) + number, number + 1
                offsets = np.asarray(w.offsets[:-1], dtype=np.int64)
                h = rolling(w.hash, block)[at]
                row = np.searchsorted(offsets, at, side="right") - 1
                first, flag, ref = first_places(h, row, at - offsets[row], ids, block)
                more = np.flatnonzero(ref != np.arange(len(ref)))
                own = packed(np.array([len(ids), len(more)], np.int64), gaps(ids), marks, gaps(offsets), gaps(at[more].astype(np.int64)), gaps(at[ref[more]].astype(np.int64)))
                # rows of one id in a run are told apart by their number among these
                new_id = np.append(True, np.diff(ids) != 0)
                twin = np.arange(len(ids)) - np.flatnonzero(new_id)[np.cumsum(new_id) - 1]
                by_place = np.argsort(first)
                first, flag = first[by_place], flag[by_place]
                h, at, row = h[first], at[first], row[first]
                part = ((h >> np.uint64(40)) % np.uint64(ranges)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                h, at, part, flag, row = h[order] & LOW, at[order], part[order], flag[order], row[order]
                starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
                ends = np.append(starts[1:], len(part))
                blobs = []
                for a, b in zip(starts, ends, strict=True):
                    low = h[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                    held, local = np.unique(row[a:b], return_inverse=True)
                    step, names, twins = narrow(gaps(at[a:b])), narrow(gaps(ids[held])), narrow(twin[held])
                    docs = gaps(local.astype(np.int64)).astype(np.uint8)  # 0 or 1, as windows come by document
                    head = np.array([len(held), b - a, step.itemsize, names.itemsize, twins.itemsize], np.int32)
                    blobs.append(packed(head, names, twins, docs, step, np.ascontiguousarray(low), flag[a:b]))
                to = np.append(part[starts], ranges + run % ranges).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(np.full(len(to), run, np.int64)), pa.array([*blobs, own], pa.binary())], ["range", "run", "blob"])

    return texts.mapInArrow(cut, "range int, run long, blob binary")


def read_probes(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, its number among the run's rows of that id, place in the run, flags) of each window of a blob of ``probes``."""
    body = unpacked(blob)
    docs, n, *sizes = (int(x) for x in np.frombuffer(body, np.int32, 5))
    kinds, at = {1: np.uint8, 2: np.uint16, 8: np.int64}, 20
    step, names, twin = ((kinds[size], count, size) for count, size in zip((n, docs, docs), sizes, strict=True))

    def take(kind, count: int, size: int) -> np.ndarray:
        nonlocal at
        at += count * size
        return np.frombuffer(body, kind, count, at - count * size)

    ids, twins, local, place = np.cumsum(take(*names), dtype=np.int64), take(*twin), np.cumsum(take(np.uint8, n, 1), dtype=np.int64), np.cumsum(take(*step), dtype=np.int64)
    low = np.zeros((n, 8), np.uint8)
    low[:, :6] = take(np.uint8, 6 * n, 1).reshape(n, 6)
    flag = take(np.uint8, n, 1)
    return low.reshape(-1).view("<u8"), ids[local], twins[local].astype(np.int32), place.astype(np.int32), flag


def read_places(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(documents, marks, offsets; further places and the first places of their hashes) of a run."""
    body = unpacked(blob)
    docs, n = (int(x) for x in np.frombuffer(body, np.int64, 2))
    ids, marks, offsets = (np.frombuffer(body, np.int64, docs, 16 + 8 * docs * j) for j in range(3))
    at, first = (np.cumsum(np.frombuffer(body, np.int64, n, 16 + 24 * docs + 8 * n * j)) for j in range(2))
    return np.cumsum(ids), marks, np.cumsum(offsets), at, first


def coded(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of the columns, and the number of each row's among them."""
    order = np.lexsort(columns[::-1])
    first = np.zeros(len(order), bool)
    for c in columns:
        first[1:] |= c[order][1:] != c[order][:-1]
    first[:1] = True
    number = np.empty(len(order), np.int32)
    number[order] = np.cumsum(first) - 1
    return [c[order[first]] for c in columns], number


def answers(ranges: int):
    """Group function: one range's probes -> (run, kind, blob) of shared windows with their first places,
    by run; the runs' own places pass through."""

    def answer(table: pa.Table) -> pa.Table:
        names = ["run", "kind", "blob"]
        runs = table.column("run").to_numpy()
        if table.column("range")[0].as_py() >= ranges:
            return pa.table([pa.array(runs), pa.array(np.ones(len(runs), np.int32)), table.column("blob")], names)
        columns: list[list] = [[] for _ in range(6)]
        for number, blob in enumerate(b for chunk in table.column("blob").chunks for b in chunk):
            got = read_probes(blob.as_py())
            for column, value in zip(columns, (*got, np.full(len(got[0]), number, np.int32)), strict=True):
                column.append(value)
        h, doc, twin, place, flag, sender = (np.concatenate(x) for x in columns)
        del columns
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        # a hash that one document of one run holds is not shared
        order = order[np.append(False, same) | np.append(same, False) | (flag[order] > 1)]
        h, doc, twin, place, flag, sender = (x[order] for x in (h, doc, twin, place, flag, sender))
        out_runs, blobs = [], []
        if len(h):
            run = runs[sender]
            order = np.lexsort((place, run, doc, h))
            h, doc, twin, place, flag, sender, run = (x[order] for x in (h, doc, twin, place, flag, sender, run))
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            times = np.diff(np.append(first, len(h)))
            shared = np.repeat((doc[first] != doc[first + times - 1]) | (np.maximum.reduceat(flag, first) > 1), times)
            anchor = np.repeat(np.maximum.reduceat(flag & 1, first), times)[shared]
            ref = np.repeat(first, times)[shared]
            to_place, to = place[shared], sender[shared]
            order = np.lexsort((to_place, to))
            to_place, to, ref, anchor = to_place[order], to[order], ref[order], anchor[order]
            cuts = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else []
            for a, b in zip(cuts, np.append(cuts[1:], len(to)), strict=True) if len(to) else []:
                refs, number = coded(doc[ref[a:b]], run[ref[a:b]], twin[ref[a:b]].astype(np.int64))
                out_runs.append(int(runs[to[a]]))
                blobs.append(packed(
                    np.array([len(refs[0]), b - a], np.int64), *refs,
                    gaps(number), gaps(to_place[a:b].astype(np.int32)), gaps(place[ref[a:b]].astype(np.int32)), anchor[a:b].astype(np.uint8)))
        return pa.table([pa.array(out_runs, pa.int64()), pa.array(np.zeros(len(blobs), np.int32)), pa.array(blobs, pa.binary())], names)

    return answer


def read_answers(blob: bytes) -> list[np.ndarray]:
    """(place in the run; document, run, number and place of the reference, anchor flag) of a blob."""
    body = unpacked(blob)
    refs, n = (int(x) for x in np.frombuffer(body, np.int64, 2))
    r_doc, r_run, r_twin = (np.frombuffer(body, np.int64, refs, 16 + 8 * refs * j) for j in range(3))
    at = 16 + 24 * refs
    ref, place, r_place = (np.cumsum(np.frombuffer(body, np.int32, n, at + 4 * n * j), dtype=np.int64) for j in range(3))
    return [place, r_doc[ref], r_run[ref], r_twin[ref], r_place, np.frombuffer(body, np.uint8, n, at + 12 * n)]


REPEATS = "doc long, mark long, start int, end int, key1 long, key2 long"


def extended(block: int):
    """Group function: the shared windows of one run's documents -> repeats of earlier documents as
    word ranges, and undecided windows, which have keys of both halves' first places."""

    def extend(table: pa.Table) -> pa.Table:
        parts, own = [], None
        for kind, blob in zip(table.column("kind").to_pylist(), table.column("blob"), strict=True):
            if kind:
                own = blob
            else:
                parts.append(read_answers(blob.as_py()))
        if not parts:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())], [c.split()[0] for c in REPEATS.split(", ")])
        answered = [np.concatenate(x) for x in zip(*parts, strict=True)]
        del parts
        ids, marks, offsets, more, first = read_places(own.as_py())
        # the other places of an answered hash have the same answer
        answered = [x[np.argsort(answered[0])] for x in answered]
        at = np.minimum(np.searchsorted(answered[0], first), len(answered[0]) - 1)
        hit = answered[0][at] == first
        place = np.concatenate([answered[0], more[hit]])
        r_doc, r_run, r_twin, r_place, flag = (np.concatenate([x, x[at[hit]]]) for x in answered[1:])
        row = np.searchsorted(offsets, place, side="right") - 1
        doc, mark, pos = ids[row], marks[row], place - offsets[row]
        order = np.lexsort((pos, mark, doc))
        doc, mark, pos, r_doc, r_run, r_twin, r_place, flag = (x[order] for x in (doc, mark, pos, r_doc, r_run, r_twin, r_place, flag))
        # equal rows of one id send the same windows
        once = np.append(True, (pos[1:] != pos[:-1]) | (mark[1:] != mark[:-1]) | (doc[1:] != doc[:-1]))
        doc, mark, pos, r_doc, r_run, r_twin, r_place, flag = (x[once] for x in (doc, mark, pos, r_doc, r_run, r_twin, r_place, flag))
        text = np.cumsum(np.append(0, (mark[1:] != mark[:-1]) | (doc[1:] != doc[:-1])))
        place = text * (1 << 32) + pos
        j = np.searchsorted(place, place + block)
        i = np.flatnonzero(place[np.minimum(j, len(place) - 1)] == place + block)
        j = j[i]
        anchors = np.cumsum(flag, dtype=np.int64)
        held = anchors[j] - anchors[i] + flag[i] > 0
        i, j = i[held], j[held]
        diagonal = (r_doc[i] == r_doc[j]) & (r_run[i] == r_run[j]) & (r_twin[i] == r_twin[j]) & (r_place[i] + block == r_place[j])
        sure = i[diagonal & (r_doc[i] < doc[i])]
        # consecutive or overlapping windows are one repeat
        new = np.append(True, np.diff(place[sure]) > 2 * block)[: len(sure)]
        first, last = sure[new], sure[np.append(np.flatnonzero(new)[1:] - 1, len(sure) - 1)] if len(sure) else sure
        k, m = i[~diagonal], j[~diagonal]
        keys = []
        for salt in (1, 2):
            key = np.zeros(len(k), np.uint64)
            for column in (r_run[k], r_place[k], r_run[m], r_place[m]):
                key = mix64(key ^ column.view(np.uint64), salt)
            keys.append(pa.array(np.append(np.zeros(len(first), np.int64), key.view(np.int64)), mask=np.arange(len(first) + len(k)) < len(first)))
        at = np.append(first, k)
        ends = np.append(pos[last], pos[k]) + 2 * block
        return pa.table([pa.array(doc[at]), pa.array(mark[at]), pa.array(pos[at].astype(np.int32)), pa.array(ends.astype(np.int32)), *keys], [c.split()[0] for c in REPEATS.split(", ")])

    return extend


def find_repeats(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc, mark, start, end): word ranges of each text that repeat a document with a smaller id.

    ``mark`` is xxhash64 of the text, which tells rows of one id apart.  ``window`` must be even."""
    block = window // 2
    texts = docs.where(F.col(quoted(id_col)).isNotNull()).select(F.col(quoted(id_col)).cast("long").alias("id"), F.xxhash64(F.col(quoted(text_col))).alias("mark"), F.col(quoted(text_col)).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, -(-size // RANGE_BYTES))
    hits = probes(texts, block, ranges).groupBy("range").applyInArrow(answers(ranges), "run long, kind int, blob binary")
    repeats = scratch.keep("repeats", hits.groupBy("run").applyInArrow(extended(block), REPEATS))
    sure = repeats.where("key1 IS NULL").select("doc", "mark", "start", "end")
    undecided = repeats.where("key1 IS NOT NULL")
    least = undecided.groupBy("key1", "key2").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").drop("last")
    settled = undecided.join(least, ["key1", "key2"]).where("doc > first").select("doc", "mark", "start", "end")
    return sure.unionByName(settled)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep_text: bool = True) -> DataFrame:
    """Per row: id, n_words, n_removed, kept_sha256, and (``keep_text``) the kept words joined by one space."""
    scratch = Scratch(docs.sparkSession, "substring")
    ranges = find_repeats(docs, scratch, id_col, text_col, window).groupBy("doc", "mark").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("cuts"))
    texts = docs.select(F.col(quoted(id_col)).alias("id"), F.xxhash64(F.col(quoted(text_col))).alias("text_mark"), F.col(quoted(text_col)).alias("text"))
    joined = texts.join(ranges, (F.col("id") == F.col("doc")) & (F.col("text_mark") == F.col("mark")), "left").select("id", "text", F.col("cuts.start").alias("starts"), F.col("cuts.end").alias("ends"))
    names = ["id", "n_words", "n_removed", "kept_sha256", *(["kept"] if keep_text else [])]
    kinds = ["long", "long", "long", "string", *(["string"] if keep_text else [])]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = []
                for text, starts, ends in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                    words, n, at, left = (text or "").encode().split(), 0, 0, []
                    n = len(words)
                    if starts:
                        for s, e in zip(starts, ends, strict=True):
                            left += words[at:max(s, at)]
                            at = max(at, e)
                        words = left + words[at:]
                    kept = b" ".join(words)
                    rows.append((n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode()))
                out = [pa.array(c) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *out[: len(names) - 1]], names)

    return joined.mapInArrow(keep, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))
