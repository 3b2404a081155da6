"""Whole-batch tokenisation and hashing with numpy, for tasks that map over Arrow batches.

Words are runs of bytes outside a separator set, found on the UTF-8 buffer of a whole
Arrow column at once; hashes are 64-bit polynomial sums over random byte codes, finished
by a bijective mixer.  Nothing here is per word or per character in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
# Fixed values: [\x20\x09-\x0D] separates "plain" words; everything outside 0-9, a-z, A-Z
# and non-ASCII bytes separates "alphanumeric" words.
PLAIN_SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
ALNUM_SEPARATORS = tuple([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
SEGMENT_BYTES = 1 << 21


def _code_table(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 2**63, size=256, dtype=np.uint64) * U64(2) + U64(1)


def mix64(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix constants)."""
    with np.errstate(over="ignore"):
        x = x + U64((salt * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & (2**64 - 1))
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), U64(base), dtype=np.uint64)
    out[0] = U64(1)
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def _lut(separators: tuple[int, ...], lower: bool) -> np.ndarray:
    """byte -> byte, 0xFF for separators (0xFF never occurs in UTF-8)."""
    t = np.arange(256, dtype=np.uint8)
    if lower:
        t[65:91] += 32
    t[list(separators)] = 0xFF
    return t


class Words:
    """The words of a batch: ``hash`` per word, ``offsets`` (len = rows + 1) into it, the byte
    range of each word relative to its own text, and hashes of word beginnings if asked for."""

    __slots__ = ("hash", "offsets", "start", "end", "prefixes")

    def __init__(self, hash_: np.ndarray, offsets: np.ndarray, start: np.ndarray, end: np.ndarray, prefixes: list[np.ndarray]):
        self.hash, self.offsets, self.start, self.end, self.prefixes = hash_, offsets, start, end, prefixes


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls have empty ranges."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]] if len(column) else raw[:0], offsets - (offsets[0] if len(column) else 0)


def words_of(column: pa.Array, separators: tuple[int, ...] = PLAIN_SEPARATORS, lower: bool = True, seed: int = 1, prefixes: tuple[int, ...] = ()) -> Words:
    """All words of a string column, hashed; ``prefixes`` also hashes their first so many bytes."""
    raw, offsets = text_buffers(column)
    lut, codes = _lut(separators, lower), _code_table(seed)
    hashes, starts, ends, begun = [], [], [], [[] for _ in prefixes]
    row_starts = offsets[:-1]
    at, n = 0, len(raw)
    while at < n:
        stop = min(n, at + SEGMENT_BYTES)
        if stop < n:  # cut behind a separator or at a row's end, so that no word is split
            cut = stop
            while cut < n and lut[raw[cut]] != 0xFF:
                nxt = row_starts[np.searchsorted(row_starts, cut)] if cut <= row_starts[-1] else n
                seps = np.flatnonzero(lut[raw[cut : min(cut + 65536, n)]] == 0xFF)
                sep = cut + int(seps[0]) if len(seps) else min(cut + 65536, n)
                if nxt <= sep:
                    cut = int(nxt)
                    break
                cut = sep
            stop = cut
        seg = lut[raw[at:stop]]
        word = seg != 0xFF
        first = word.copy()
        first[1:] &= ~word[:-1]
        lo, hi = np.searchsorted(row_starts, [at, stop])
        inner = row_starts[lo:hi] - at
        first[inner] = word[inner]
        s = np.flatnonzero(first)
        if len(s):
            keep = np.flatnonzero(word)
            first_kept = np.searchsorted(keep, s)
            lengths = np.diff(np.append(first_kept, len(keep)))
            pos = np.arange(len(keep), dtype=np.int64) - np.repeat(first_kept, lengths)
            with np.errstate(over="ignore"):
                v = codes[seg[keep]] * _powers(0x9DDFEA08EB382D69, int(lengths.max()))[pos]
                h = np.add.reduceat(v, first_kept) + lengths.astype(np.uint64)
                for out, k in zip(begun, prefixes, strict=True):
                    out.append(mix64(np.add.reduceat(np.where(pos < k, v, U64(0)), first_kept), seed + 100 + k))
            hashes.append(mix64(h, seed))
            starts.append(s + at)
            ends.append(s + at + lengths)
        at = stop
    cat = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
    h, s, e = cat(hashes, np.uint64), cat(starts, np.int64), cat(ends, np.int64)
    word_offsets = np.searchsorted(s, offsets).astype(np.int64)
    base = np.repeat(offsets[:-1], np.diff(word_offsets))
    return Words(h, word_offsets, s - base, e - base, [cat(x, np.uint64) for x in begun])


def rolling(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of each run of ``k`` consecutive entries (len(h) - k + 1 of them)."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64)
    base = 0xD6E8FEB86659FD93
    with np.errstate(over="ignore"):
        if k <= 12:
            out = h[: n - k + 1].copy()
            for j in range(1, k):
                out = out * U64(base) + h[j : n - k + 1 + j]
            return mix64(out, salt + k)
        # prefix sums of h[i] * base^-i: one subtraction and one multiplication a window
        inverse = pow(base, -1, 2**64)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(h * _powers(inverse, n), out=total[1:])
        return mix64((total[k:] - total[: n - k + 1]) * _powers(base, n)[: n - k + 1], salt + k)


def window_starts(offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(global index of each window start, its row) for windows of ``k`` words inside one row."""
    counts = np.maximum(np.diff(offsets) - k + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(counts)
    inner = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)
    return offsets[:-1][rows] + inner, rows


def slices(batch: pa.RecordBatch, column: str, budget: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts hold about ``budget`` bytes (one row at least)."""
    _, offsets = text_buffers(batch.column(batch.schema.get_field_index(column)))
    at, n = 0, batch.num_rows
    while at < n:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + budget, side="right")) - 1)
        yield batch.slice(at, stop - at)
        at = stop
