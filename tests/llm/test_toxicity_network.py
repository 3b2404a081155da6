"""The toxicity network against word-by-word brute force."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from tracehound.llm import toxicity as X


def network(seed: int) -> X.Model:
    r = np.random.default_rng(seed)
    table = r.normal(size=(X.BUCKETS + 1, X.DIM)).astype(np.float32)
    table[X.BUCKETS] = 0
    filters = {k: r.normal(size=(k, X.DIM, X.FILTERS)).astype(np.float32) for k in X.WIDTHS}
    n = len(X.WIDTHS) * X.FILTERS
    return X.Model(table, filters, r.normal(size=n).astype(np.float32), r.normal(size=n), -0.25, 0.5)


def one_logit(m: X.Model, ids: np.ndarray) -> float:
    """Every window of a padded text by itself, then pooling and the output layer."""
    words = [sum(m.table[i].astype(float) for i in row) for row in ids]
    top = []
    for w, k in enumerate(X.WIDTHS):
        for f in range(X.FILTERS):
            seen = [sum(words[at + j] @ m.filters[k][j][:, f] for j in range(k)) for at in range(len(ids) - X.PAD)]
            top.append(max([0.0, *[s + m.bias[w * X.FILTERS + f] for s in seen]]))
    return float(np.array(top) @ m.out + m.out_bias + m.shift)


@pytest.mark.parametrize("chunk", [1, 2, 7, 1 << 16])
def test_scores_equal_brute_force_wherever_chunks_end(monkeypatch, chunk):
    monkeypatch.setattr(X, "CHUNK", chunk)
    texts = ["", None, "one", "two words", "Some LONGER text, of several words; and more", "one", " ... ", "a b c d e f g h i j k"]
    m = network(3)
    ids, offsets = X.word_ids(pa.array(texts, pa.string()))
    expected = [one_logit(m, ids[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    assert np.allclose(m.logits(ids, offsets), expected, atol=1e-3)


@pytest.mark.parametrize("seed", range(5))
def test_the_cut_has_the_largest_f1(seed):
    r = np.random.default_rng(seed)
    y = (r.random(60) < 0.3).astype(float)
    z = np.round(r.normal(size=60) + 2 * y, 1)  # with ties

    def f1(cut):
        hit = z >= cut
        return 2 * (hit & (y == 1)).sum() / max(hit.sum() + y.sum(), 1)

    assert f1(X.best_cut(z, y)) == pytest.approx(max(f1(c) for c in z))


def test_a_small_language_is_drawn_to_the_common_cut(monkeypatch):
    """A language's own cut weighs as much as its calibration rows of the rarer class allow."""
    data = [("a", 1, 2.0, 200), ("a", 0, 0.0, 200), ("big", 1, 6.0, 30), ("big", 0, 4.0, 40), ("few", 1, 6.0, 2), ("few", 0, 4.0, 3), ("one", 0, 0.0, 9)]
    rows = [(lang, label, z) for lang, label, z, n in data for _ in range(n)]
    m = network(0)
    m.shift = 0.0
    m.logits = lambda ids, offsets: np.array([z for _, _, z in rows])
    monkeypatch.setattr(X, "train", lambda texts, labels: m)
    ids = np.full((1 + X.PAD, X.ROWS), X.BUCKETS, np.int32).tobytes()
    calibration = [{"ids": ids, "label": float(label), "lang": lang} for lang, label, _ in rows]
    X.fit(calibration, calibration)
    assert m.shift == -1.0
    assert set(m.thresholds) == {"a", "big", "few"}  # one class alone has no cut of its own
    logit = {lang: np.log(t / (1 - t)) for lang, t in m.thresholds.items()}
    assert logit["a"] == pytest.approx(0.0, abs=1e-9)
    assert logit["big"] == pytest.approx(30 / (30 + X.SHRINKAGE) * (5.0 - 1.0))
    assert logit["few"] == pytest.approx(2 / (2 + X.SHRINKAGE) * (5.0 - 1.0))


def test_rows_beyond_the_first_are_learned(spark):
    """Words that only rows outside the start's sample hold count, and so do those rows for the cuts."""
    from pyspark.sql import functions as F

    n, first = 2400, 100
    ids = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 3 == 0).cast("int").alias("toxic"))
    few = X.marked(ids, "toxic", "doc_id").orderBy(F.xxhash64("id"), "id").limit(first).select(F.col("id").alias("doc_id"), F.lit(True).alias("early"))
    word = F.when(F.col("toxic") == 0, "lovely").when(F.col("early"), "scum").otherwise("vermin")
    docs = ids.join(few, "doc_id", "left").select("doc_id", F.concat_ws(" ", F.lit("this is"), word, F.concat(F.lit("w"), F.col("doc_id") % 40)).alias("text"), F.lit("en").alias("lang"))
    model = X.fit_toxicity(docs, ids, max_rows=first)
    assert model.seen is None and "en" in model.thresholds
    got = X.score_toxicity(docs, model).join(ids, "doc_id").where(X.held_out()).select(((F.col("toxicity") >= 0.5) == (F.col("toxic") == 1)).alias("right")).collect()
    assert sum(r.right for r in got) / len(got) > 0.97
    # of the cut's 100ths: as if each row had its own entry
    z, y = np.array([0.0, 0.0, 1.0, 1.0, 1.0, 2.0]), np.array([0, 1, 0, 1, 1, 1.0])
    assert X.best_cut(z, y) == X.best_cut(np.array([0.0, 1.0, 2.0]), np.array([1, 2, 1.0]), np.array([2, 3, 1.0]))


def test_a_passs_exchanged_texts_go_with_it(spark, monkeypatch):
    """Not only when the driver's garbage happens to be collected."""
    from pathlib import Path
    from time import sleep

    from pyspark.sql import functions as F

    held = lambda: {str(p): p.stat().st_size for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString() for p in Path(d).rglob("shuffle_*.data")}
    monkeypatch.setattr(X.Scratch, "release", lambda self: None)
    rows = spark.range(1500).select(F.col("id").alias("doc_id"), (F.col("id") % 3 == 0).cast("int").alias("toxic"))
    random = F.concat_ws(" ", *[F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(f"-{i}")), 256) for i in range(12)])
    docs = rows.select("doc_id", random.alias("text"), F.lit("en").alias("lang"))
    before, key = held(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    assert X.fit_toxicity(docs, rows, max_rows=40) is not None
    for _ in range(50):
        left = sum(size for p, size in held().items() if p not in before)
        if left < 200_000:
            break
        sleep(0.2)
    assert left < 200_000  # the labelled texts of a pass have about 750,000 characters
    assert spark.conf.get(key) == "false"


def test_a_passs_broadcast_goes_with_it(spark, monkeypatch):
    """Neither the driver's file nor its blocks stay until garbage is collected."""
    from pathlib import Path

    from pyspark.sql import functions as F

    folder = Path(spark.sparkContext._temp_dir)
    large = lambda: {p.name for p in folder.iterdir() if p.stat().st_size > 12 << 20}
    monkeypatch.setattr(X.Scratch, "release", lambda self: None)
    rows = spark.range(400).select(F.col("id").alias("doc_id"), (F.col("id") % 3 == 0).cast("int").alias("toxic"))
    docs = rows.select("doc_id", F.when(F.col("toxic") == 1, "vermin here").otherwise("a lovely day").alias("text"), F.lit("en").alias("lang"))
    before, passes, improve = large(), [], X.improve
    monkeypatch.setattr(X, "improve", lambda m, rows: (improve(m, rows), passes.append(large() - before)))
    assert X.fit_toxicity(docs, rows, max_rows=40).seen is None
    assert passes == [set()] * X.ROUNDS  # a model under training takes 16 MB
