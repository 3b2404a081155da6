"""The pipeline's stages on odd rows, and against brute force on a small corpus."""

import ctypes
import os
import random
import re
import tempfile

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tracehound.llm import scratch


@pytest.fixture(scope="module")
def corpus(spark):
    """A folder of tables, and what should become of each document."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4)))
    item = [word() for _ in range(20)]
    docs, labels, fate = [], [], {}
    for i in range(400):
        w = [word() for _ in range(rng.randrange(30, 120))]
        kind = "toxic" if i % 8 == 0 else "leak" if i % 50 == 1 else "copy" if i % 50 == 3 else "mail" if i % 50 == 5 else "clean"
        if kind == "toxic":
            w[4:4] = ["scumlord", "vilehat"]
        if kind == "leak":
            w[4:4] = item[3:16]
        if kind == "mail":
            w[4:4] = ["joe@example.org"]
        if kind == "copy":
            w = docs[i - 1][1].split()
            w[0] = "changed"
            kind = "toxic" if fate[i - 1] == "toxic" else kind  # a copy of a toxic text is toxic
        docs.append((i, " ".join(w), "en", f"s{min(i % 9, 3)}", 0))
        labels.append((i, 1, int(kind == "toxic")))
        fate[i] = kind
    docs += [(1000, None, None, None, None), (None, "x y", "en", "s1", 3), (1001, "", "en", "s1", 0), (1002, "solo", "en", "s1", 4), (1002, "solo", "en", "s1", 4)]
    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, docs, fate


def test_stages_take_effect_and_keep_clean_documents(spark, corpus):
    d, docs, fate = corpus
    now, kept = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in P.STAGES:
        out = f"{tempfile.mkdtemp(prefix='run-', dir='/tmp')}/{name}"
        stage(spark, now, d).write.parquet(out)
        after = spark.read.parquet(out)
        if name != "mixture":
            assert after.columns == now.columns
        now = after
        kept[name] = [r["doc_id"] for r in now.collect()]
        if name == "personal_data":
            texts = {r["doc_id"]: r["text"] for r in now.collect()}
    gone = lambda a, b: set(a) - set(b)
    every = [r[0] for r in docs]
    assert gone(every, kept["toxicity"]) == {i for i, k in fate.items() if k == "toxic"}
    copies = gone(kept["toxicity"], kept["near_duplicates"])
    assert copies == {i for i, k in fate.items() if k == "copy"}
    assert kept["near_duplicates"].count(1002) == 1
    assert gone(kept["near_duplicates"], kept["decontamination"]) == {i for i, k in fate.items() if k == "leak"} & set(kept["near_duplicates"])
    assert set(kept["personal_data"]) == set(kept["decontamination"]) == set(kept["mixture"])
    original = {r[0]: r[1] for r in docs}
    for i, t in texts.items():
        assert t == (original[i] and re.sub(r"joe@example\.org", "[EMAIL]", original[i]))


def test_texts_that_share_an_id_are_not_lost(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(5, a), (5, b), (7, a), (9, b), (5, a), (6, a + " more"), (8, None), (8, ""), (None, a)]
    out = P.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(map(tuple, out), key=str) == sorted([(5, a), (5, b), (8, None), (8, ""), (None, a)], key=str)


def test_run_applies_the_stages(spark, corpus):
    d, docs, fate = corpus
    out = P.run(spark, d)
    assert out.columns == ["doc_id", "source", "tokens", "pass", "block", "slot"]
    clean = {i for i, k in fate.items() if k in ("clean", "mail")}
    assert clean <= {r["doc_id"] for r in out.collect()}


def test_odd_rows_pass_every_filter(spark, corpus, odd_docs, no_docs):
    d = corpus[0]
    for name, stage in P.STAGES:
        assert stage(spark, no_docs, d).count() == 0
        out = stage(spark, odd_docs.withColumn("m", F.create_map(F.lit("a"), F.lit(1))), d)
        ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert ids >= {1, 3, 4, 5, 6, 8, None}, name


def test_freed_native_memory_of_the_driver_goes_back(spark):
    libc = ctypes.CDLL(None)
    libc.malloc.restype, libc.malloc.argtypes, libc.free.argtypes = ctypes.c_void_p, [ctypes.c_size_t], [ctypes.c_void_p]
    resident = lambda: int(re.search(r"VmRSS:\s+(\d+)", open("/proc/self/status").read())[1]) / 1024
    blocks = [libc.malloc(16_000) for _ in range(6_000)]
    for b in blocks:
        ctypes.memset(b, 1, 16_000)
    held = blocks[::100]  # one in a hundred stays, so the heap's end cannot fall
    for i, b in enumerate(blocks):
        if i % 100:
            libc.free(b)
    before = resident()
    scratch.release(spark)
    after = resident()
    for b in held:
        libc.free(b)
    assert before - after > 40


def test_the_jvm_gives_its_freed_memory_back(spark, monkeypatch):
    assert "Trim native heap" in scratch.trim(spark)
    assert scratch.trim(spark, "noSuchCommand") == ""
    seen = []
    monkeypatch.setattr(scratch, "trim", seen.append)
    scratch.Scratch(spark, "none").release()
    assert seen == [spark]


def test_every_stage_begins_by_releasing(monkeypatch):
    class Begun(Exception):
        pass

    def begin(_):
        raise Begun

    monkeypatch.setattr(P, "release", begin)
    for _, stage in P.STAGES:
        with pytest.raises(Begun):
            stage(None, None, "")
