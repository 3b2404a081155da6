"""Unit rows and odd inputs of the operators that work text by text."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracehound.llm import decontam, licenses, pii, quality, substring, textkit, toxicity


def by_id(df, *cols):
    return {r["doc_id"] if "doc_id" in r else r["id"]: tuple(r[c] for c in cols) for r in df.collect()}


# ------------------------------------------------------------------ text kit


def test_words_agree_with_bytes_split_across_segments(monkeypatch):
    rng = random.Random(3)
    texts = [None, "", " ", "a", *("".join(rng.choice("ab Ré\n") for _ in range(rng.randrange(80))) for _ in range(200))]
    whole = textkit.words_of(pa.array(texts), prefixes=(2,))
    monkeypatch.setattr(textkit, "SEGMENT_BYTES", 16)
    cut = textkit.words_of(pa.array(texts), prefixes=(2,))
    for a, b in ((whole.hash, cut.hash), (whole.offsets, cut.offsets), (whole.start, cut.start), (whole.end, cut.end), (whole.prefixes[0], cut.prefixes[0])):
        assert (a == b).all()
    seen = {}
    for i, t in enumerate(texts):
        words = (t or "").encode().lower().split() if t else []
        assert whole.offsets[i + 1] - whole.offsets[i] == len((t or "").encode().split())
        for j, w in enumerate(words):
            assert seen.setdefault(bytes(w), whole.hash[whole.offsets[i] + j]) == whole.hash[whole.offsets[i] + j]
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("k", [1, 3, 12, 25])
def test_rolling_is_equal_for_equal_windows_only(k):
    rng = np.random.default_rng(k)
    x = rng.integers(0, 2**63, 60, dtype=np.uint64)
    y = np.concatenate([x, rng.integers(0, 2**63, 7, dtype=np.uint64), x])
    h = textkit.rolling(y, k)
    assert (h[: 60 - k + 1] == h[67:]).all()
    assert len(set(h.tolist())) == len(h) - (60 - k + 1)


# ------------------------------------------------------------------ personal data


def brute_spans(text):
    """The base kinds by Python's own matcher."""
    out = []
    for kind in pii.KINDS[:4]:
        for m in re.finditer(kind.pattern, text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            if kind.name == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind.name == "phone" and not 8 <= len(digits) <= 15:
                continue
            if kind.name == "card":
                total = sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits)))
                if not 16 <= len(digits) <= 19 or total % 10:
                    continue
            out.append((kind.name, m.start(), m.end()))
    return out


def test_base_spans_equal_a_plain_matcher(spark):
    rng = random.Random(5)
    alphabet = ["a", "é", "@", ".", "b.c", " ", "-", "+", "1", "25", "256", "4111 1111 1111 1111", "+1 (555) 010-9999", "x@y.zz", "10.0.0.1", "007", "(", "😀"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 30))) for _ in range(400)]
    texts += ["1" * 20_000, "a" * 20_000, "+" + "(" * 5_000, "a@b.c@d.e@f.g", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "x" * 9_000 + "@y.z"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for r in pii.find_pii(rows).collect():
        got = [(s["kind"], s["start"], s["end"]) for s in r["pii"] if s["kind"] in pii.BASE_KINDS]
        assert got == brute_spans(r["text"]), r["text"][:80]


def test_checksums_context_and_redaction(spark):
    rows = [
        (1, "pay to DE89 3704 0044 0532 0130 00 today"), (2, "pay to DE89 3704 0044 0532 0130 01 today"),
        (3, "SSN: 219-09-9999"), (4, "part 219-09-9999"), (5, "my ssn 000-12-3456"),
        (6, "mail é@x a.b@c.de, call +1 (555) 010-9999 or 10.0.0.1"), (7, None), (8, ""),
    ]
    df = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"))
    kinds = {r["doc_id"]: [s["kind"] for s in r["pii"]] for r in df.collect()}
    assert kinds == {1: ["iban"], 2: [], 3: ["ssn"], 4: [], 5: [], 6: ["email", "ip", "phone"], 7: [], 8: []}
    clean = by_id(pii.redact(df), "text")
    assert clean[6] == ("mail é@x [EMAIL], call [PHONE] or [IP]",)
    assert clean[1] == ("pay to [IBAN] today",) and clean[7] == (None,) and clean[8] == ("",)


def test_many_matches_cross_the_block_of_prefix_sums(spark):
    text = " ".join(f"u{i}@x.org" for i in range(700))
    r = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(s["start"], s["end"]) for s in r["pii"]] == [m.span() for m in re.finditer(r"u\d+@x\.org", text)]


def test_pii_odd_inputs(odd_docs, no_docs):
    out = pii.find_pii(odd_docs)
    assert out.count() == odd_docs.count() and out.columns == [*odd_docs.columns, "pii"]
    assert pii.redact(out).count() == odd_docs.count()
    assert pii.find_pii(odd_docs.withColumn("pii", F.lit("clash"))).columns == out.columns
    assert pii.find_pii(no_docs).count() == 0


# ------------------------------------------------------------------ licenses


def test_license_votes_survive_small_edits(spark):
    mit = licenses.TEMPLATES[0][1]
    edited = mit.replace("free of charge", "quite free of charge").replace("associated ", "")
    rows = [(1, f"x y {mit} z"), (2, edited), (3, " ".join(mit.split()[:6])), (4, "Under the MIT License, under the mit license"), (5, None), (6, "cc by nc cc by nc")]
    found = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {r["id"]: (sorted(r["method_labels"] or []), [(p["label"], p["place"]) for p in r["places"]]) for r in found}
    assert got[1] == (["mit"], []) and got[2] == (["mit"], []) and got[3] == ([], [])
    assert got[4][1] == [("mit", 0), ("mit", 4)] and got[5] == ([], [])
    assert got[6][1] == [("cc-by-nc", 0), ("cc-by-nc", 3)]


def test_license_odd_inputs(odd_docs, no_docs):
    out = licenses.scan_licenses(odd_docs)
    assert out.count() == odd_docs.count()
    assert licenses.scan_licenses(no_docs).count() == 0


# ------------------------------------------------------------------ decontamination


def brute_contamination(docs, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    wins = {}
    for i, t in items:
        w = words(t)
        for s in range(max(len(w) - window, 0) + 1 if w else 0):
            wins.setdefault(tuple(w[s : s + window]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for win, owners in wins.items():
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit.update(range(s, s + len(win)))
                    ids |= owners
        out.append((d, len(w), len(hit), sorted(str(i) for i in ids if i is not None)))
    return out


@pytest.mark.parametrize("block", [400_000, 7])
def test_contamination_equals_brute_force(spark, block):
    rng = random.Random(block)
    vocabulary = ["a", "b", "c", "dé", "E"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(1, text(14)), (2, text(3)), (2, text(2)), (3, "a"), (4, None), (5, "..."), (None, text(4)), (7, text(11)), (7, text(11))]
    docs = [(i, text(rng.randrange(60))) for i in range(60)] + [(100, None), (101, ""), (None, items[0][1]), (0, items[7][1]), (0, items[7][1])]
    found = decontam.find_contamination(
        spark.createDataFrame(docs, "doc_id long, text string").withColumn("contamination", F.lit(1)),
        spark.createDataFrame(items, "item_id long, text string"), block_windows=block,
    ).collect()
    got = [(r["doc_id"], r["contamination"]["n_words"], r["contamination"]["n_hit"], r["contamination"]["item_ids"]) for r in found]
    assert sorted(got, key=str) == sorted(brute_contamination(docs, items), key=str)
    for r in found:
        c = r["contamination"]
        assert c["n_hit"] == sum(e - s for s, e in zip(c["starts"], c["ends"], strict=True))


def test_contamination_odd_inputs(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    assert decontam.find_contamination(no_docs, items).count() == 0
    out = decontam.find_contamination(odd_docs, items.limit(0)).collect()
    assert len(out) == odd_docs.count() and all(r["contamination"]["n_hit"] == 0 for r in out)
    hits = decontam.find_contamination(odd_docs, items)
    assert hits.where("contamination.n_hit = 3").count() == 4


# ------------------------------------------------------------------ substring deduplication


def brute_repeats(docs, window):
    first = {}
    words = [((t or "").encode().split()) for _, t in docs]
    for (d, _), w in zip(docs, words, strict=True):
        if d is not None:
            for i in range(len(w) - window + 1):
                k = tuple(w[i : i + window])
                first[k] = min(first.get(k, d), d)
    out = []
    for (d, _), w in zip(docs, words, strict=True):
        gone = set()
        if d is not None:
            for i in range(len(w) - window + 1):
                if first[tuple(w[i : i + window])] < d:
                    gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(4))
def test_repeats_equal_brute_force(spark, monkeypatch, seed):
    """Few words and short windows: the halves of windows often point to different texts."""
    monkeypatch.setattr(substring, "RANGE_BYTES", 400)
    rng = random.Random(seed)
    passage = [rng.choice("abc") for _ in range(60)]
    docs = []
    for i in range(50):
        w = [rng.choice("ab" if seed % 2 else "abcdefgh") for _ in range(rng.randrange(0, 70))]
        if rng.random() < 0.5:
            a = rng.randrange(50)
            w[5:5] = passage[a : a + rng.randrange(3, 30)]
        docs.append((rng.randrange(1, 40) if rng.random() < 0.2 else 100 + i, " ".join(w)))
    docs += [(None, docs[0][1]), (3, None), (4, ""), (200, docs[1][1]), (200, docs[1][1]), (5, "a " * 300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((tuple(r) for r in substring.remove_repeats(df, window=8, keep_text=False).collect()), key=str)
    assert got == brute_repeats(docs, 8)


def test_a_run_sends_each_hash_once(spark):
    """A line that fills all texts is one entry a run in its range, whatever the number of its places."""
    texts = spark.createDataFrame([(i, i, "w " * 200) for i in range(300)], "id long, mark long, text string").coalesce(1)
    sent = [len(substring.read_probes(r["blob"])[0]) for r in substring.probes(texts, 25, 4).collect() if r["range"] < 4]
    assert sent == [1]


@pytest.mark.parametrize("run_bytes", [300, 4 << 20])
def test_frequent_passage_over_runs_equals_brute_force(spark, monkeypatch, run_bytes):
    monkeypatch.setattr(substring, "RANGE_BYTES", 2_000)
    monkeypatch.setattr(substring, "RUN_BYTES", run_bytes, raising=False)
    rng = random.Random(5)
    passage = [rng.choice("abcdef") for _ in range(40)]
    docs = [(i, " ".join([rng.choice("abcdef") for _ in range(rng.randrange(20))] + (passage if i % 3 == 0 else ["w"] * rng.randrange(40)))) for i in range(150)]
    got = sorted((tuple(r) for r in substring.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), window=8, keep_text=False).collect()), key=str)
    assert got == brute_repeats(docs, 8)


def test_substring_odd_inputs(odd_docs, no_docs):
    kept = by_id(substring.remove_repeats(odd_docs), "n_words", "n_removed", "kept")
    assert kept[7] == (401, 400, "pre") and kept[6][1] == 0 and kept[4] == (0, 0, "")
    assert substring.remove_repeats(no_docs).count() == 0


# ------------------------------------------------------------------ classifiers


def labelled(spark, bad, n=400):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        w = [f"{rng.choice('bcdfgh')}{rng.choice('aeiou')}{rng.choice('lmnr')}" for _ in range(rng.randrange(5, 60))]
        y = rng.random() < 0.3
        rows.append((i, bad(rng, w) if y else " ".join(w), "en"))
        labels.append((i, int(y)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, y int")


def held_out_accuracy(scored, labels, col, cut=0.5):
    rows = scored.join(labels, "doc_id").where(toxicity.held_out()).select(F.col(col).alias("s"), "y").collect()
    return sum((r["s"] >= cut) == (r["y"] == 1) for r in rows) / len(rows)


def test_toxicity_learns_marker_words_and_stems(spark):
    docs, labels = labelled(spark, lambda rng, w: " ".join([*w, rng.choice(["scumlord", "vilehat", "vilemar"]), *w[:2]]))
    model = toxicity.fit_toxicity(docs, labels, label="y")
    assert held_out_accuracy(toxicity.score_toxicity(docs, model), labels, "toxicity") > 0.95
    more = spark.createDataFrame([(1, "bal vilezzz cen", "en"), (2, "bal cen", "en")], docs.schema)
    s = by_id(toxicity.score_toxicity(more, model), "toxicity")
    assert s[1][0] > s[2][0]


def test_toxicity_chunks_of_a_long_text_agree(spark, monkeypatch):
    docs, labels = labelled(spark, lambda rng, w: " ".join([*w, "scumlord"]), n=200)
    model = toxicity.fit_toxicity(docs, labels, label="y")
    ids, offsets = toxicity.word_ids(pa.array(["a b", None, "x " * 500 + "scumlord", "", "q"] * 3))
    whole = model.logits(ids, offsets)
    monkeypatch.setattr(toxicity, "CHUNK", 64)
    assert np.allclose(whole, model.logits(ids, offsets))


def test_toxicity_odd_inputs(spark, odd_docs, no_docs):
    docs, labels = labelled(spark, lambda rng, w: " ".join([*w, "scumlord"]), n=150)
    model = toxicity.fit_toxicity(docs, labels.union(spark.createDataFrame([(None, 1), (3, None), (3, 1)], "doc_id long, y int")), label="y")
    scored = toxicity.score_toxicity(odd_docs.withColumn("toxicity", F.lit("clash")), model)
    assert scored.count() == odd_docs.count() and scored.where("toxicity IS NULL OR toxicity < 0 OR toxicity > 1").count() == 0
    assert toxicity.score_toxicity(no_docs, model).count() == 0
    assert toxicity.fit_toxicity(no_docs, labels, label="y") is None
    assert toxicity.score_toxicity(odd_docs, None).select("toxicity").distinct().collect()[0][0] == 0.0


def test_quality_separates_junk_from_positives_alone(spark):
    docs, flipped = labelled(spark, lambda rng, w: " | ".join(x + "%%%" for x in w), n=900)
    labels = flipped.select("doc_id", (1 - F.col("y")).alias("y"))
    model = quality.fit_quality(docs, labels.where("y = 1"), label="y")  # no negative is ever seen
    assert 0.5 < model.prior < 0.9
    assert held_out_accuracy(quality.score_quality(docs, model), labels, "quality") > 0.95


def test_quality_odd_inputs(spark, odd_docs, no_docs):
    docs, labels = labelled(spark, lambda rng, w: " | ".join(w), n=150)
    model = quality.fit_quality(docs, labels, label="y")
    scored = quality.score_quality(odd_docs, model)
    assert scored.count() == odd_docs.count() and scored.where("quality IS NULL OR quality < 0 OR quality > 1").count() == 0
    assert quality.score_quality(no_docs, model).count() == 0
    assert quality.fit_quality(no_docs, labels, label="y") is None
    x = quality.features(pa.array([None, "", "a b\na b", "é|1!"]))
    assert x.shape == (4, quality.N_FEATURES) and np.isfinite(x).all()
