"""Quality classifier by positive-unlabelled learning.

Trusted positives (label 1) and unlabelled web text train a small network under the
non-negative unbiased risk

    prior * E_p[loss(g)] + max(0, E_u[loss(-g)] - prior * E_p[loss(-g)])

with the logistic loss, so that its sigmoid estimates the probability of label 1.  Rows with
label 0 are never used as such; they are part of the unlabelled text.  The class prior is
estimated from the two samples: a first model ranks texts, and the prior is the smallest
ratio, over upper tails of the score, of the unlabelled share to the positive share (with
an allowance for the sample size).

Features are counts over the whole text (symbols, repetition, lines, word shapes), taken from
the text's bytes in numpy.  The fit reads at most ``max_positive`` positives and
``max_unlabelled`` documents, taken by the hash of their id; scoring maps over all texts.

Null and empty texts have all counts 0 and get that score.  Rows are scored one by one, so
ties and repeated rows are equal; a null label is no label; without any positive every score
is 0.  Other columns pass through; one named like the result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import map_rows, shared
from .sqltext import quoted
from .textkit import PLAIN_SEPARATORS, rolling, slices, text_buffers, window_starts, words_of

MAX_POSITIVE = 6_000
MAX_UNLABELLED = 12_000
HIDDEN = 16
STEPS = 2_500
BATCH = 256
LINE_SEPARATORS = (0x0A, 0x0D)
N_FEATURES = 23


def features(column: pa.Array) -> np.ndarray:
    """(texts, N_FEATURES) from the whole texts."""
    raw, offsets = text_buffers(column)
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)

    filled = np.flatnonzero(size)

    def per_text(flags: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        if len(filled):
            out[filled] = np.add.reduceat(flags, offsets[filled], dtype=np.int64)
        return out

    space = np.isin(raw, PLAIN_SEPARATORS)
    upper = (raw >= 65) & (raw <= 90)
    lower = (raw >= 97) & (raw <= 122)
    digit = (raw >= 48) & (raw <= 57)
    high = raw >= 128
    stop = (raw == 46) | (raw == 44)
    symbol = ~(space | upper | lower | digit | high | stop)
    again = np.zeros(len(raw), bool)
    again[1:] = (raw[1:] == raw[:-1]) & ~space[1:]
    w = words_of(column, PLAIN_SEPARATORS, lower=True)
    words = np.diff(w.offsets).astype(float)
    row = np.repeat(np.arange(n), np.diff(w.offsets))
    length = w.end - w.start
    symbols_before = np.zeros(len(raw) + 1, np.int32)
    np.cumsum(symbol, out=symbols_before[1:])
    base = np.repeat(offsets[:-1], np.diff(w.offsets))
    marked = symbols_before[base + w.end] > symbols_before[base + w.start]

    def distinct(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distinct values, largest count of one value) by text."""
        kinds, most = np.zeros(n), np.zeros(n)
        if len(hashes):
            order = np.lexsort((hashes, rows))
            h, r = hashes[order], rows[order]
            first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])))
            times = np.diff(np.append(first, len(h)))
            kinds += np.bincount(r[first], minlength=n)
            np.maximum.at(most, r[first], times)
        return kinds, most

    def mean(values: np.ndarray) -> np.ndarray:
        return np.bincount(row, weights=values, minlength=n) / np.maximum(words, 1)

    repeated = np.zeros(len(w.hash), bool)
    repeated[1:] = (w.hash[1:] == w.hash[:-1]) & (row[1:] == row[:-1])
    kinds, most = distinct(w.hash, row)
    at, rows3 = window_starts(w.offsets, 3)
    kinds3, most3 = distinct(rolling(w.hash, 3)[at], rows3)
    lines = words_of(column, LINE_SEPARATORS, lower=False)
    n_lines = np.diff(lines.offsets).astype(float)
    line_kinds, line_most = distinct(lines.hash, np.repeat(np.arange(n), np.diff(lines.offsets)))
    n3 = np.maximum(np.maximum(words - 2, 0), 1)
    some, bytes_ = np.maximum(words, 1), np.maximum(size, 1)
    letters = np.maximum(per_text(upper | lower | high), 1)
    x = np.column_stack([
        np.log1p(words), np.log1p(n_lines), np.log1p(words / np.maximum(n_lines, 1)),
        per_text(symbol) / bytes_, per_text(digit) / bytes_, per_text(upper) / letters, per_text(high) / bytes_,
        per_text(stop) / some, per_text(again) / bytes_, per_text(raw == 124) / some, per_text(raw == 33) / some, per_text(space) / bytes_,
        mean(marked.astype(float)), mean(length.astype(float)), np.sqrt(np.maximum(mean(length.astype(float) ** 2) - mean(length.astype(float)) ** 2, 0)),
        kinds / some, most / some, kinds3 / n3, most3 / n3,
        line_kinds / np.maximum(n_lines, 1), line_most / np.maximum(n_lines, 1), mean((length <= 3).astype(float)), mean(repeated.astype(float)),
    ])
    return x


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 5, steps: int = STEPS) -> Model:
    """Adam on the non-negative risk; when its negative part falls below 0 the step climbs it."""
    rng = np.random.default_rng(seed)
    every = np.concatenate([positive, unlabelled])
    mean, scale = every.mean(axis=0), every.std(axis=0) + 1e-6
    m = Model(mean, scale, rng.normal(0, 1 / np.sqrt(every.shape[1]), (every.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), 0.0, prior)
    p, u = (np.clip((x - mean) / scale, -6, 6) for x in (positive, unlabelled))
    size = m.w1.size + m.b1.size + m.w2.size + 1
    first, second = np.zeros(size), np.zeros(size)
    for step in range(1, steps + 1):
        xp, xu = p[rng.integers(0, len(p), BATCH)], u[rng.integers(0, len(u), BATCH)]
        x = np.concatenate([xp, xu])
        h = np.tanh(x @ m.w1 + m.b1)
        g = h @ m.w2 + m.b2
        s = sigmoid(g)
        # d loss(g)/dg = s - 1 for label 1, s for label 0
        negative = np.logaddexp(0, g[BATCH:]).mean() - prior * np.logaddexp(0, g[:BATCH]).mean()
        d_neg = np.concatenate([-prior * s[:BATCH], s[BATCH:]]) / BATCH
        d_pos = np.concatenate([prior * (s[:BATCH] - 1), np.zeros(BATCH)]) / BATCH
        d = d_pos + d_neg if negative >= 0 else -d_neg
        dh = np.outer(d, m.w2) * (1 - h * h)
        grad = np.concatenate([(x.T @ dh).ravel(), dh.sum(axis=0), h.T @ d, [d.sum()]])
        grad[: m.w1.size] += 1e-4 * m.w1.ravel()
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        move = 0.01 * (1 - 0.9 * step / steps) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        a, b = m.w1.size, m.w1.size + HIDDEN
        m.w1 -= move[:a].reshape(m.w1.shape)
        m.b1 -= move[a:b]
        m.w2 -= move[b : b + HIDDEN]
        m.b2 -= float(move[-1])
    return m


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The smallest unlabelled / positive ratio over upper score tails, with sampling allowance.

    One half of the positives trains the ranking, the other is the sample that is compared."""
    half = len(positive) // 2
    if half < 10 or len(unlabelled) < 20:
        return 0.5
    m = train(positive[:half], unlabelled[::2], 0.5, seed=11, steps=STEPS // 2)
    zp, zu = np.sort(m.logits(positive[half:])), np.sort(m.logits(unlabelled[1::2]))
    cuts = np.quantile(zp, np.linspace(0.0, 0.9, 91))
    tail = lambda z: 1 - np.searchsorted(z, cuts, side="left") / len(z)
    tp, tu = tail(zp), tail(zu)
    slack = np.sqrt(np.log(20) / 2) * (1 / np.sqrt(len(zp)) + 1 / np.sqrt(len(zu)))
    best = np.argmin((tu + slack) / tp)
    return float(np.clip(tu[best] / tp[best], 0.05, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray) -> Model | None:
    if not len(positive) or not len(unlabelled):
        return None
    return train(positive, unlabelled, estimate_prior(positive, unlabelled))


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, positive, unlabelled, text) -> the same with packed features for the text."""
    for whole in batches:
        for batch in slices(whole, "text"):
            x = features(batch.column(3))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([r.tobytes() for r in x], pa.binary())], ["id", "positive", "unlabelled", "x"])


def fit_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality",
    max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED,
) -> Model | None:
    """Fit outside the held-out fold; both samples are bounded, and so is the broadcast of their ids."""
    free = lambda df, c: df.where(F.col(quoted(c)).isNotNull() & (F.pmod(F.crc32(F.col(quoted(c)).cast("string")), F.lit(5)) != 0)).select(F.col(quoted(c)).alias("id"))
    trusted = free(labels.where(F.col(quoted(label)) == 1), id_col).distinct().orderBy(F.xxhash64("id"), "id").limit(max_positive)
    web = free(docs, id_col).distinct().orderBy(F.xxhash64("id", F.lit(1)), "id").limit(max_unlabelled)
    chosen = (
        trusted.select("id", F.lit(1).alias("p"), F.lit(0).alias("u")).unionByName(web.select("id", F.lit(0).alias("p"), F.lit(1).alias("u")))
        .groupBy("id").agg((F.max("p") == 1).alias("positive"), (F.max("u") == 1).alias("unlabelled"))
    )
    texts = docs.select(F.col(quoted(id_col)).alias("doc"), F.col(quoted(text_col)).alias("text"))
    rows = (
        texts.join(F.broadcast(chosen), F.col("doc") == F.col("id")).groupBy("id", "positive", "unlabelled").agg(F.min("text").alias("text"))  # one row an id
        .mapInArrow(pack, "id long, positive boolean, unlabelled boolean, x binary").collect()
    )
    rows = sorted(rows, key=lambda r: (r["id"], bytes(r["x"])))
    matrix = lambda flag: np.array([np.frombuffer(r["x"], float) for r in rows if r[flag]]).reshape(-1, N_FEATURES)
    shuffle = lambda x: x[np.random.default_rng(3).permutation(len(x))]
    return fit(shuffle(matrix("positive")), shuffle(matrix("unlabelled")))


def score_quality(docs: DataFrame, model: Model | None, text_col: str = "text", out_col: str = "quality") -> DataFrame:
    """Add ``out_col``: the estimated probability of label 1."""
    docs = docs.drop(out_col)
    if model is None:
        return docs.withColumn(out_col, F.lit(0.0))
    held = shared(docs.sparkSession, model)
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField(out_col, T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held()
        for whole in batches:
            for batch in slices(whole, text_col, 2 << 20):
                z = m.logits(features(batch.column(batch.schema.get_field_index(text_col))))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sigmoid(z))], [*names, out_col])

    return map_rows(docs, score, schema)
