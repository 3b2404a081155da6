"""Unit rows and odd inputs of the operators that compare rows with each other."""

import base64
import hashlib
import os
import random
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracehound.llm import components, mixing, near_dup, neighbours, warc
from tracehound.llm.scratch import Scratch


# ------------------------------------------------------------------ components


@pytest.mark.parametrize("seed", range(2))
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)] + [(500, i) for i in range(501, 540)] + [(7, 7)]
    rng.shuffle(edges)
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "x long, y long"), Scratch(spark, "t")).collect()}
    assert got == {x: find(x) for x in root if x in got} and len(got) == len({x for e in edges for x in e if e[0] != e[1]})


# ------------------------------------------------------------------ near duplicates


def brute_components(docs, words, pct):
    sets = []
    for d, t in docs:
        w = [bytes(x).lower() for x in (t or "").encode().split()]
        sets.append({tuple(w[i : i + words]) for i in range(max(len(w) - words + 1, 1))} if w else set())
    comp = {d: d for d, _ in docs if d is not None}
    find = lambda x: x if comp[x] == x else find(comp[x])
    for i, (a, _) in enumerate(docs):
        for j in range(i):
            b = docs[j][0]
            if a is not None and b is not None and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= pct * len(sets[i] | sets[j]):
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    return sorted(((d, len(s), None if d is None else find(d)) for (d, _), s in zip(docs, sets, strict=True)), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_near_duplicates_equal_brute_force(spark, seed):
    """Heavily edited copies of few texts: most links are not with the central copy."""
    rng = random.Random(seed)
    docs, number = [], 0
    for base in range(4):
        w = [f"{base}x{rng.randrange(60)}" for _ in range(60)]
        edits = [(rng.randrange(60), rng.choice(["", "same", "other"])) for _ in range(12)]
        for _ in range(25):
            c = list(w)
            for at, to in rng.sample(edits, rng.randrange(0, 7)):
                c[at] = to
            if rng.random() < 0.3:
                c = c[: rng.randrange(50, 60)]
            number += rng.randrange(1, 4)
            docs.append((number, " ".join(c)))
    docs += [(900, docs[3][1]), (900, docs[3][1]), (901, "a b"), (902, "A  b"), (903, "a"), (904, None), (905, ""), (None, docs[0][1]), (906, "a b c d e f g")]
    got = sorted((tuple(r) for r in near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), words=3, threshold_pct=85).collect()), key=str)
    assert got == brute_components(docs, 3, 85)


def test_near_duplicates_odd_inputs(odd_docs, no_docs):
    got = sorted((tuple(r) for r in near_dup.near_duplicates(odd_docs).collect()), key=str)
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert got == brute_components(rows, 5, 80)
    assert near_dup.near_duplicates(no_docs).count() == 0


def test_repeated_id_with_two_texts_ties_them(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(5, a), (5, b), (7, a), (9, b)]
    got = {tuple(r) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(i, c) for i, _, c in got} == {(5, 5), (7, 5), (9, 5)}


def test_bayes_keeps_pairs_at_the_threshold():
    least = near_dup.least_matches(0.85)
    ends = range(near_dup.BATCH, near_dup.HASHES + 1, near_dup.BATCH)
    tail = lambda p, k, m: sum(comb(k, j) * p**j * (1 - p) ** (k - j) for j in range(m))
    assert sum(tail(0.85, k, m) for k, m in zip(ends, least, strict=True)) < 1e-6  # lost at the threshold, all batches
    assert tail(0.4, near_dup.HASHES, least[-1]) > 0.99  # pruned far below it


# ------------------------------------------------------------------ nearest neighbours


def brute_nearest(rows, k=5):
    use = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v) and len(v) == 16]
    out = {}
    for i, v in use:
        if i % 7 == 0:
            near = sorted(((-float(v @ u) / np.sqrt(v @ v) / np.sqrt(u @ u), j) for j, u in use if j != i))[:k]
            out[i] = [(j, -s) for s, j in near]
    return out


@pytest.mark.parametrize("per_block", [2_000, 120])
def test_nearest_recall(spark, monkeypatch, per_block):
    monkeypatch.setattr(neighbours, "NODES_PER_BLOCK", per_block)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(800)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0] * 3), (None, rows[0][1]), (2004, [None, *rows[0][1][1:]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 7 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    truth = brute_nearest(rows)
    assert set(got) == set(truth)
    hits = 0
    for q, near in truth.items():
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 6))
        hits += sum(any(abs(s - m[2]) < 1e-12 for m in mine) for _, s in near)
    assert hits >= (0.9 if per_block == 120 else 1.0) * 5 * len(truth)
    # a vector with many copies: the smallest ids, nearest first
    assert [m[1] for m in sorted(got[1001])] == [3, 1000, 1002, 1003, 1004] if 1001 in got else True


@pytest.mark.parametrize("noise", [1e-2, 1e-3])
def test_nearest_recall_in_a_group_of_near_equal_vectors(spark, monkeypatch, noise):
    monkeypatch.setattr(neighbours, "NODES_PER_BLOCK", 800)
    rng = np.random.default_rng(6)
    base = rng.normal(size=64)
    v = np.concatenate([base + noise * rng.normal(size=(3000, 64)), rng.normal(size=(1000, 64))])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df, (F.col("vec_id") % 50 == 0) & (F.col("vec_id") < 3000)).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert len(got) == 60
    hits = 0
    for q, near in got.items():
        s = unit @ unit[q]
        s[q] = -2
        hits += len(near & set(np.argsort(-s)[:5].tolist()))
    assert hits >= 0.9 * 5 * len(got), hits / 5 / len(got)


def test_nearest_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r["rank"], r["vec_id"]) for r in neighbours.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert neighbours.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert neighbours.nearest(df.limit(1), F.col("vec_id") == 0).count() == 0


# ------------------------------------------------------------------ WARC


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def files(path):
    return {f: open(os.path.join(path, f), "rb").read() for f in sorted(os.listdir(path)) if f.endswith(".warc.gz")}


def test_warc_round_trip_and_determinism(spark, scratch_dir):
    rng = random.Random(1)
    rows = [(i, f"http://x/é {i}\r\nX-Injected: 1" if i == 5 else f"http://x/{i}", "".join(rng.choice("abcé<>\r\n ") for _ in range(rng.randrange(400)))) for i in range(300)]
    rows += [(1000 + i, "http://c", rows[7][2]) for i in range(20)] + [(2000, None, None), (2001, "u", ""), (None, "n", "no id"), (2002, "r", "twice"), (2002, "r", "twice"), (2003, "t", "twice"), (9, "other", "changed")]
    df = pages(spark, rows)
    manifests = []
    for name, parts in (("a", 3), ("b", 7)):
        m = warc.write_archive(df.repartition(parts), f"{scratch_dir}/{name}", shard_bytes=20_000, file_bytes=3_000)
        manifests.append(sorted(tuple(r) for r in m.collect()))
    one, two = files(f"{scratch_dir}/a"), files(f"{scratch_dir}/b")
    assert one == two and manifests[0] == manifests[1] and len(one) > 5
    assert {r[0]: r[5] for r in manifests[0]} == {f: hashlib.sha256(b).hexdigest() for f, b in one.items()}
    assert len({r[1] for r in manifests[0]}) > 1 and max(r[2] for r in manifests[0]) > 0  # shards, and files that rolled
    got = warc.read_archive(spark, f"{scratch_dir}/a").collect()
    first = {}
    for k, _, h in rows:
        if k is not None:
            first[h or ""] = min(first.get(h or "", k), k)
    expected = sorted(((k, u or "", len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), None if k is None or first[h or ""] == k else first[h or ""]) for k, u, h in rows), key=str)
    assert sorted(((r["key"], r["target"], r["payload_bytes"], r["payload_digest"], r["refers_to"]) for r in got), key=str) == expected
    assert all((r["record_type"] == "revisit") == (r["refers_to"] is not None) for r in got)
    by_key = {(r["key"], r["payload_digest"]): r["payload"] for r in got if r["record_type"] == "response"}
    for k, _, h in rows:
        body = (h or "").encode()
        key = (k, base64.b32encode(hashlib.sha1(body).digest()).decode())
        assert by_key.get(key, body) == body


def test_warc_small_payloads_damage_and_empty_table(spark, scratch_dir):
    df = pages(spark, [(1, "u", "aa"), (2, "u", "aa"), (3, "u", "b" * 50), (4, "u", "b" * 50)])
    warc.write_archive(df, f"{scratch_dir}/c", min_revisit_bytes=10)
    kinds = {r["key"]: r["record_type"] for r in warc.read_archive(spark, f"{scratch_dir}/c").collect()}
    assert kinds == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    open(f"{scratch_dir}/c/shard-99999999-00000.warc.gz", "wb").write(b"left by a failed attempt")
    assert warc.read_archive(spark, f"{scratch_dir}/c").count() == 4
    warc.write_archive(df.limit(0), f"{scratch_dir}/d")
    assert warc.read_archive(spark, f"{scratch_dir}/d").count() == 0


@pytest.fixture()
def scratch_dir():
    import tempfile

    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


# ------------------------------------------------------------------ mixing


def brute_weights(tokens, entropy):
    total = sum(tokens.values())
    p = {s: t / total for s, t in tokens.items()}

    def at(a):
        z = sum(x**a for x in p.values())
        w = {s: x**a / z for s, x in p.items()}
        return w, -sum(x * np.log(x) for x in w.values())

    lo, hi = 0.0, 1.0
    if at(1.0)[1] >= entropy * np.log(len(p)):
        return p
    for _ in range(50):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if at(mid)[1] >= entropy * np.log(len(p)) else (lo, mid)
    return at(lo)[0]


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 30)), "big" if i < 700 else f"s{i % 4}" if i < 990 else None) for i in range(1000)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string"), rows


def test_mixing_reaches_the_entropy_and_leaves_nothing_out(skewed):
    df, rows = skewed
    out = mixing.mix_sources(df, entropy=0.9, repetition=None, block_tokens=3000).collect()
    tokens = {}
    for i, t, s in rows:
        tokens[s] = tokens.get(s, 0) + max(len(t.split()), 1)
    weights = brute_weights(tokens, 0.9)
    total = sum(r["tokens"] for r in out)
    for s, w in weights.items():
        assert abs(sum(r["tokens"] for r in out if r["source"] == s) / total - w) < 0.01
    assert {r["doc_id"] for r in out} == {r[0] for r in rows}
    # each pass but the last is a whole permutation of its source, and blocks hold the mixture
    most = {s: max(r["pass"] for r in out if r["source"] == s) for s in weights}
    for s in weights:
        for n in range(most[s]):
            assert len([1 for r in out if r["source"] == s and r["pass"] == n]) == len([1 for r in rows if r[2] == s])
    blocks = max(r["block"] for r in out) + 1
    for b in range(blocks):
        own = [r for r in out if r["block"] == b]
        assert abs(sum(r["tokens"] for r in own if r["source"] == "big") / sum(r["tokens"] for r in own) - weights["big"]) < 0.1


def test_mixing_budget_and_repetition_limit(skewed):
    df, rows = skewed
    out = mixing.mix_sources(df, entropy=1.0, repetition=2.0, budget=6000).collect()
    assert sum(r["tokens"] for r in out) <= 6000 and sum(r["tokens"] for r in out) > 5800
    passes = {}
    for r in out:
        passes.setdefault(r["source"], {}).setdefault(r["doc_id"], []).append(r["pass"])
    assert max(len(p) for s in passes.values() for p in s.values()) <= 2
    with pytest.raises(ValueError):
        mixing.mix_sources(df, repetition=1.0, budget=10**9)


def test_mixing_cut_is_the_same_over_many_ranges(skewed, monkeypatch):
    df, _ = skewed
    one = sorted(tuple(r) for r in mixing.mix_sources(df, entropy=0.9, budget=7000).select("doc_id", "pass", "block", "slot").collect())
    monkeypatch.setattr(mixing, "RANGE_DOCS", 16)
    assert sorted(tuple(r) for r in mixing.mix_sources(df, entropy=0.9, budget=7000).select("doc_id", "pass", "block", "slot").collect()) == one


def test_mixing_odd_inputs(odd_docs, no_docs):
    out = mixing.mix_sources(odd_docs)
    assert {r["doc_id"] for r in out.select("doc_id").collect()} == {r["doc_id"] for r in odd_docs.collect()}
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "tokens", "pass", "block", "slot"]
    assert mixing.mix_sources(no_docs).count() == 0
