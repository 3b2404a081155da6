"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of three rows of one hashed table: those of the whole word and
of its first 4 and 6 bytes (inflected forms share what the stem has learned, and a clash in
one row alone does not make two words equal).  Filters of several widths slide
over the whole text, each filter keeps its largest response, and a logistic unit with weights of at
least 0 reads those maxima: words can add evidence but not take it away, so a text without words
has the lowest score and a short clean one is not suspect for what it lacks.  At most ``max_rows`` labelled rows (taken by
the hash of their id) start the model on the driver; then tasks go on over all labelled rows, and
the model moves by the mean of their changes (local steps of SGD with averaging).  Scoring maps
over all whole texts, with the model as a broadcast of fixed size.

Thresholds are calibrated on labelled rows that take no part in the fit: the score is shifted
so that 0.5 is the best cut over all languages, and each language with calibration rows of both
classes gets its own cut, drawn towards the common one the fewer such rows it has
(``Model.thresholds``; others use 0.5).  Scores never
read the language; only ``toxic_by_language`` compares a score with its language's cut.

Null and empty texts have no windows and get the score of an empty text.  Rows are scored one
by one, so ties and repeated rows are equal by construction; a null label is no label; with no
labelled rows of both classes every score is 0.  Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch, exchanges_released, lent, map_rows, shared
from .sqltext import quoted
from .textkit import ALNUM_SEPARATORS, slices, words_of

BUCKETS = 1 << 18
DIM = 8
PREFIXES = (4, 6)
ROWS = 1 + len(PREFIXES)
WIDTHS = (1, 2, 3)
FILTERS = 8
PAD = max(WIDTHS) - 1
MAX_ROWS = 4_000
EPOCHS = 6
RATE = 0.08
ROUNDS = 2  # passes over all rows after the start
LEAST_ROWS_SEEN = 40_000
BATCH = 24
CHUNK = 1 << 16
SHRINKAGE = 20  # calibration rows of the rarer class at which a language's own cut weighs half
MAX_CHARS = 32_000_000  # characters of the sampled texts, over all


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(quoted(id_col)).cast("string")), F.lit(5)) == 0


def word_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of each word, each text followed by PAD empty words (number BUCKETS), and the
    offsets of the texts."""
    w = words_of(column, ALNUM_SEPARATORS, prefixes=PREFIXES)
    n = np.diff(w.offsets)
    shift = np.repeat(np.arange(len(n)) * PAD, n)
    ids = np.full((len(w.hash) + len(n) * PAD, ROWS), BUCKETS, np.int32)
    at = np.arange(len(w.hash)) + shift
    for j, h in enumerate([w.hash, *w.prefixes]):
        ids[at, j] = (h >> np.uint64(46)).astype(np.int32)
    return ids, w.offsets + np.arange(len(w.offsets)) * PAD


def embed(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    x = table[ids[:, 0]]
    for j in range(1, ROWS):
        x += table[ids[:, j]]
    return x


@dataclass
class Model:
    table: np.ndarray
    filters: dict[int, np.ndarray]  # width -> (width, DIM, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    seen: dict | None = None  # sums of squared gradients, while it is being fitted

    def maxima(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(texts, all filters): the largest response of each filter, at least 0, over all windows."""
        n = len(offsets) - 1
        top = np.zeros((n, len(WIDTHS) * FILTERS), np.float32)
        flat = np.concatenate([self.filters[k][j] for k in WIDTHS for j in range(k)], axis=1)
        starts = offsets[:-1]
        for a in range(0, len(ids) - PAD, CHUNK):
            b = min(a + CHUNK, len(ids) - PAD)
            x = embed(self.table, ids[a : b + PAD])
            r = x @ flat
            lo, hi = np.searchsorted(starts, [a, b], side="right")
            first = max(lo - 1, 0)
            rows = np.arange(first, max(hi, first + 1))
            cuts = np.maximum(starts[rows], a) - a
            # words in this chunk for each text, without its padding
            ends = np.minimum(offsets[rows + 1] - PAD, b) - a
            some = ends > cuts
            rows, cuts, ends = rows[some], cuts[some], ends[some]
            if not len(rows):
                continue
            edges = np.empty(2 * len(rows), np.int64)
            edges[::2], edges[1::2] = cuts, ends
            at = 0
            for w, k in enumerate(WIDTHS):
                s = r[: b - a, at * FILTERS : (at + 1) * FILTERS].copy()
                for j in range(1, k):
                    s += r[j : b - a + j, (at + j) * FILTERS : (at + j + 1) * FILTERS]
                at += k
                pairs = edges if edges[-1] < len(s) else edges[:-1]
                best = np.maximum.reduceat(s, pairs, axis=0)[::2] + self.bias[w * FILTERS : (w + 1) * FILTERS]
                cols = slice(w * FILTERS, (w + 1) * FILTERS)
                top[rows, cols] = np.maximum(top[rows, cols], best)
        return top

    def logits(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return self.maxima(ids, offsets).astype(np.float64) @ self.out + self.out_bias + self.shift


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def step(m: Model, texts: list[np.ndarray], labels: np.ndarray, rate: float) -> None:
    """One mini-batch of AdaGrad; only the winning window of each filter gets a gradient."""
    seen = m.seen
    table, filters, n_out = m.table, m.filters, len(m.bias)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    ids = np.concatenate(texts)
    x = embed(table, ids)
    top = np.zeros((len(texts), n_out))
    where = np.zeros((len(texts), n_out), np.int64)
    for w, k in enumerate(WIDTHS):
        s = sum(x[j : len(x) - PAD + j] @ filters[k][j] for j in range(k))
        for row in range(len(texts)):
            a, b = offsets[row], offsets[row + 1] - PAD
            if b > a:
                best = s[a:b].argmax(axis=0)
                where[row, w * FILTERS : (w + 1) * FILTERS] = best + a
                top[row, w * FILTERS : (w + 1) * FILTERS] = s[best + a, np.arange(FILTERS)] + m.bias[w * FILTERS : (w + 1) * FILTERS]
    hidden = np.maximum(top, 0)
    error = (sigmoid(hidden @ m.out + m.out_bias) - labels) / len(texts)
    back = error[:, None] * m.out * (top > 0)
    g_out = hidden.T @ error + 1e-5 * m.out
    g_bias = back.sum(axis=0)
    rows, grads = [], []
    for w, k in enumerate(WIDTHS):
        cols = slice(w * FILTERS, (w + 1) * FILTERS)
        g = np.zeros_like(filters[k])
        for j in range(k):
            t = where[:, cols] + j
            g[j] = np.einsum("mf,mfd->df", back[:, cols], x[t])
            e = (back[:, cols, None] * filters[k][j].T[None]).reshape(-1, DIM)
            some = np.abs(e).max(axis=1) > 1e-9
            for h in range(ROWS):
                rows.append(ids[t.reshape(-1)[some], h])
                grads.append(e[some])
        seen["filters"][k] += g * g
        filters[k] -= (rate * g / np.sqrt(seen["filters"][k])).astype(np.float32)
    seen["out"] += g_out * g_out
    m.out = np.maximum(m.out - rate * g_out / np.sqrt(seen["out"]), 0.0)
    seen["bias"] += g_bias * g_bias
    m.bias -= (rate * g_bias / np.sqrt(seen["bias"])).astype(np.float32)
    seen["ob"] += float(error.sum()) ** 2
    m.out_bias -= rate * float(error.sum()) / np.sqrt(seen["ob"])
    rows, grads = np.concatenate(rows), np.concatenate(grads)
    known = rows < BUCKETS
    touched, inverse = np.unique(rows[known], return_inverse=True)
    total = np.zeros((len(touched), DIM))
    np.add.at(total, inverse, grads[known])
    seen["table"][touched] += total * total
    table[touched] -= (rate * total / np.sqrt(seen["table"][touched])).astype(np.float32)


def train(texts: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Model:
    """Fit on padded id arrays ((words + PAD) x ROWS each) by mini-batches.  Small samples are passed
    over more often."""
    epochs = max(EPOCHS, min(40, LEAST_ROWS_SEEN // len(texts)))
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.02, (BUCKETS + 1, DIM)).astype(np.float32)
    table[BUCKETS] = 0
    filters = {k: rng.normal(0, 0.4, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS}
    n_out = len(WIDTHS) * FILTERS
    m = Model(table, filters, np.full(n_out, 0.02, np.float32), np.abs(rng.normal(0, 0.3, n_out)), float(np.log(max(labels.mean(), 1e-3) / max(1 - labels.mean(), 1e-3))))
    m.seen = {"table": np.full(table.shape, 1e-6, np.float32), "bias": np.full(n_out, 1e-4), "out": np.full(n_out, 1e-4), "ob": 1e-4,
              "filters": {k: np.full(filters[k].shape, 1e-4, np.float32) for k in WIDTHS}}
    for epoch in range(epochs):
        rate = RATE / (1 + 3.0 * epoch / epochs)
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            step(m, [texts[i] for i in pick], labels[pick], rate)
    return m


def best_cut(logits: np.ndarray, labels: np.ndarray, rows: np.ndarray | None = None) -> float:
    """The cut with the largest F1, in the middle of the widest gap among equals (with ``rows``, an
    entry stands for so many rows whose labels sum up to its label)."""
    order = np.argsort(-logits)
    z, y = logits[order], labels[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.cumsum(np.ones(len(y)) if rows is None else rows[order]) + y.sum())
    ends = np.append(z[:-1] != z[1:], True)
    good = np.flatnonzero(ends & (f1 >= f1[ends].max() - 1e-12))
    below = np.append(z[1:], z[-1] - 2.0)
    i = good[np.argmax((z - below)[good])]
    return float((z[i] + below[i]) / 2)


def calibrate(m: Model, z: np.ndarray, y: np.ndarray, langs: np.ndarray, rows: np.ndarray | None = None) -> None:
    """Set the shift and the cuts by language; ``rows`` as in :func:`best_cut`."""
    n = np.ones(len(y)) if rows is None else rows
    if not 0 < y.sum() < n.sum():
        return
    m.shift = -best_cut(z, y, n)
    for lang in np.unique(langs):
        own = langs == lang
        rarer = min(y[own].sum(), (n - y)[own].sum())
        if rarer:
            weight = rarer / (rarer + SHRINKAGE)
            m.thresholds[str(lang)] = float(sigmoid(np.array([weight * (best_cut(z[own], y[own], n[own]) + m.shift)]))[0])


def fit(labelled: list[dict], calibration: list[dict]) -> Model | None:
    """Rows hold ``ids`` (packed, padded), ``label`` and ``lang``."""
    arrays = lambda rows: [np.frombuffer(r["ids"], np.int32).reshape(-1, ROWS) for r in rows]
    labels = np.array([r["label"] for r in labelled], float)
    if not len(labels) or labels.min() == labels.max():
        return None
    m = train(arrays(labelled), labels)
    xs, y = arrays(calibration), np.array([r["label"] for r in calibration], float)
    if len(y):
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in xs])])
        calibrate(m, m.logits(np.concatenate(xs), offsets), y, np.array([r["lang"] or "" for r in calibration]))
    return m


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, lang, fold, text) -> the same with packed word ids for the text."""
    for whole in batches:
        for batch in slices(whole, "text"):
            ids, offsets = word_ids(batch.column(4))
            packed = [ids[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(packed, pa.binary())], ["id", "label", "lang", "fold", "ids"])


def marked(labels: DataFrame, label: str, id_col: str) -> DataFrame:
    """(id, label): one row for each labelled id outside the held-out fold."""
    own = labels.where(F.col(quoted(label)).isNotNull() & F.col(quoted(id_col)).isNotNull() & ~held_out(id_col))
    return own.groupBy(F.col(quoted(id_col)).alias("id")).agg(F.max(F.col(quoted(label))).cast("double").alias("label"))


def fold(id_col: str) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)).cast("int")


def sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, max_rows: int) -> DataFrame:
    """At most ``max_rows`` labelled rows outside the held-out fold, one an id, with text and language;
    in the order of the ids' hashes, as many as have ``MAX_CHARS`` characters together.

    The sample is drawn on the narrow labels table; its broadcast is bounded by ``max_rows``."""
    few = marked(labels, label, id_col).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit("")
    texts = docs.select(F.col(quoted(id_col)).alias("doc"), lang.alias("lang"), F.col(quoted(text_col)).alias("text"))
    rows = texts.join(F.broadcast(few), F.col("doc") == F.col("id")).groupBy("id", "label").agg(F.min(F.struct("text", "lang")).alias("row"))
    # a running sum over at most max_rows rows
    chars = F.sum(F.coalesce(F.length("row.text"), F.lit(0))).over(Window.orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("chars", chars).where(F.col("chars") <= MAX_CHARS).select(
        "id", "label", F.coalesce("row.lang", F.lit("")).alias("lang"), F.pmod(F.crc32(F.col("id").cast("string")), F.lit(5)).cast("int").alias("fold"), "row.text",
    )


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str) -> DataFrame:
    """(id, label, lang, fold, text) of every document whose id is in :func:`marked`.  Labels are the narrow
    side, hashed by partition: texts are exchanged and not sorted."""
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit("")
    texts = docs.select(F.col(quoted(id_col)).alias("doc"), F.coalesce(lang, F.lit("")).alias("lang"), F.col(quoted(text_col)).alias("text"))
    rows = texts.join(marked(labels, label, id_col).hint("shuffle_hash"), F.col("doc") == F.col("id"))
    return rows.select("id", "label", "lang", fold("id").alias("fold"), "text")


def dense(m: Model) -> np.ndarray:
    """All weights but the table as rows of DIM."""
    flat = np.concatenate([*[m.filters[k].ravel() for k in WIDTHS], m.bias, m.out, [m.out_bias]]).astype(np.float64)
    return np.append(flat, np.zeros(-len(flat) % DIM)).reshape(-1, DIM)


def moved(m: Model, rows: np.ndarray, by: np.ndarray) -> None:
    """Add to rows of the table and, numbered from BUCKETS on, of :func:`dense`."""
    own = rows < BUCKETS
    m.table[rows[own]] += by[own].astype(np.float32)
    flat = dense(m)
    flat[rows[~own] - BUCKETS] += by[~own]
    flat, at = flat.ravel(), 0
    for k in WIDTHS:
        size = m.filters[k].size
        m.filters[k], at = flat[at : at + size].reshape(m.filters[k].shape).astype(np.float32), at + size
    n = len(m.bias)
    m.bias, m.out, m.out_bias = flat[at : at + n].astype(np.float32), np.maximum(flat[at + n : at + 2 * n], 0.0), float(flat[at + 2 * n])


def improve(m: Model, rows: DataFrame) -> None:
    """One pass over all ``rows``: each task goes on from the model over its rows, in the order of their
    hashes; every weight then moves by its mean change over the tasks that changed it."""
    names = ["row", *[f"d{i}" for i in range(DIM)]]
    ordered = rows.sortWithinPartitions(F.xxhash64("id"), "id", F.xxhash64("text")).select("label", "text")
    with lent(rows.sparkSession, m) as held:

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = None
            for whole in batches:
                for batch in slices(whole, "text", 1 << 20):
                    if own is None:
                        own = held()
                        table, others = own.table.copy(), dense(own)
                    ids, offsets = word_ids(batch.column(1))
                    label = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
                    for at in range(0, len(label), BATCH):
                        to = min(at + BATCH, len(label))
                        step(own, [ids[offsets[i] : offsets[i + 1]] for i in range(at, to)], label[at:to], RATE / 4)
            if own is not None:
                touched = np.flatnonzero((own.table != table).any(axis=1))
                by = np.concatenate([own.table[touched].astype(np.float64) - table[touched], dense(own) - others])
                at = np.append(touched, BUCKETS + np.arange(len(others))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(by[:, i]) for i in range(DIM)]], names)

        changes = ordered.mapInArrow(learn, ", ".join(f"{n} {'int' if n == 'row' else 'double'}" for n in names))
        # at most a row of DIM numbers for each row of the table
        mean = changes.groupBy("row").agg(*[F.avg(n).cast("float").alias(n) for n in names[1:]]).toArrow()
    if mean.num_rows:
        moved(m, mean.column("row").to_numpy(), np.stack([mean.column(n).to_numpy() for n in names[1:]], axis=1))


def calibrate_on(m: Model, rows: DataFrame) -> None:
    """Set shift and cuts by counts of all ``rows`` for each language and hundredth of a logit."""
    m.shift, m.thresholds = 0.0, {}
    p = F.greatest(F.least("score", F.lit(1 - 1e-12)), F.lit(1e-18))
    scored = score_toxicity(rows, m, out_col="score").select("lang", "label", F.round(F.log(p / (1 - p)), 2).alias("z"))
    bins = scored.groupBy("lang", "z").agg(F.sum("label").alias("y"), F.count(F.lit(1)).cast("double").alias("n")).toArrow()
    calibrate(m, *(bins.column(c).to_numpy() for c in ("z", "y")), bins.column("lang").to_numpy().astype(str), bins.column("n").to_numpy())


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS) -> Model | None:
    """Train on all labelled rows; those with remainder 1 only calibrate the cuts.

    Up to ``max_rows`` rows start the model on the driver.  If there are others, ``ROUNDS`` passes over all
    rows go on from there in the tasks (a task takes one partition of the join, so weights vary a little with
    their number), and the cuts are those of all calibration rows."""
    known = docs.select(F.col(quoted(id_col)).alias("doc")).join(marked(labels, label, id_col).hint("shuffle_hash"), F.col("doc") == F.col("id"))
    total = known.agg(F.count_distinct("id").alias("ids"), F.min(F.when(fold("id") != 1, F.col("label"))).alias("low"), F.max(F.when(fold("id") != 1, F.col("label"))).alias("high")).first()
    if total.low is None or total.low == total.high:
        return None
    # as Arrow batches, which the driver's JVM passes on as they come
    rows = sample(docs, labels, label, id_col, text_col, max_rows).mapInArrow(pack, "id long, label double, lang string, fold int, ids binary").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["id"], r["ids"]))
    first = [r for r in rows if r["fold"] != 1]
    if len(rows) == total.ids:
        m = fit(first, [r for r in rows if r["fold"] == 1])
    else:
        arrays = [np.frombuffer(r["ids"], np.int32).reshape(-1, ROWS) for r in first] or [np.full((PAD, ROWS), BUCKETS, np.int32)]
        m = train(arrays, np.array([r["label"] for r in first] or [0.0], float))
        del rows, first, arrays
        every = labelled_rows(docs, labels, label, id_col, text_col)
        scratch = Scratch(docs.sparkSession, "toxicity")
        scratch.release()
        with exchanges_released(docs.sparkSession):  # a pass's exchanged texts go before the next
            for _ in range(ROUNDS):
                improve(m, every.where("fold <> 1"))
                scratch.release()
            m.seen = None
            calibrate_on(m, every.where("fold = 1"))
            scratch.release()
    m.seen = None
    return m


def score_toxicity(docs: DataFrame, model: Model | None, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """Add ``out_col`` (0 to 1, at 0.5 the cut over all languages); a column of that name is replaced."""
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
                z = m.logits(*word_ids(batch.column(batch.schema.get_field_index(text_col))))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sigmoid(z))], [*names, out_col])

    return map_rows(docs, score, schema)


def toxic_by_language(model: Model | None, score: Column, lang: Column) -> Column:
    """Whether the score reaches its language's cut."""
    cut = F.lit(0.5)
    for name, value in (model.thresholds if model else {}).items():
        cut = F.when(lang == name, value).otherwise(cut)
    return score >= cut
