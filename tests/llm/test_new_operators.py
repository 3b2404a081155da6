"""Line deduplication, conversation repair and the Merkle manifest against brute force."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracehound.llm import conversations as C
from tracehound.llm import lines as L
from tracehound.llm import merkle as M
from tracehound.llm.scratch import Scratch

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
UPPER = {i: i + 32 for i in range(65, 91)}


# ------------------------------------------------------------------ lines


def brute_lines(docs, min_chars=40, min_docs=5):
    key = lambda line: line.strip(L.BLANKS).translate(UPPER)
    holders = defaultdict(set)
    for doc, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(doc)
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        ids = lambda line: holders.get(key(line), set()) - {None}
        gone = [len(ids(x)) >= min_docs and doc != max(ids(x)) for x in lines]
        out.append((doc, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def run_lines(spark, docs, **options):
    scratch = Scratch(spark, "test-lines")
    bitmaps = scratch.keep("bitmaps", L.line_bitmaps(docs, scratch, **options))
    return sorted((tuple(r) for r in L.drop_lines(docs, bitmaps).select("doc_id", "lines.n_lines", "lines.n_dropped", "lines.text").collect()), key=repr)


def random_docs(seed, n, hot):
    rng = random.Random(seed)
    pool = [f"  Shared LINE {i} " + "ünder all Words " * 3 + ("\t" if i % 2 else "\x0b") for i in range(30)]
    docs = []
    for doc in range(n):
        lines = [rng.choice(pool + ["", "short", f"own line of document {doc} " + "x" * 40]) for _ in range(rng.randrange(0, 9))]
        if rng.random() < hot:
            lines += ["The hottest line, in a third of all documents, with its end." + " " * rng.randrange(3)] * rng.randrange(1, 4)
        docs.append((rng.choice([doc, doc, doc, None, 3]), rng.choice(["\n".join(lines)] * 9 + [None])))
    return docs


@pytest.mark.parametrize("seed,n,hot,partitions", [(1, 60, 0.3, 1), (2, 200, 0.9, 13), (3, 300, 0.3, 40), (4, 12, 1.0, 5)])
def test_lines_against_brute_force(spark, seed, n, hot, partitions):
    docs = random_docs(seed, n, hot)
    assert run_lines(spark, spark.createDataFrame(docs, "doc_id long, text string"), partitions=partitions) == brute_lines(docs)


def test_one_line_fills_many_ranges_and_batches(spark):
    """A line of all documents, several times in each, spans ranges; small Arrow batches cut it, too."""
    line = "a line that every single document of this table holds"
    docs = [(i, "\n".join([line] * 3 + [f"{i} and a line of its own that nobody else has"])) for i in range(300)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = run_lines(spark, spark.createDataFrame(docs, "doc_id long, text string"), partitions=16)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == brute_lines(docs)
    assert sum(r[2] for r in got) == 299 * 3


def test_lines_of_odd_documents(spark, odd_docs, no_docs):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    docs = odd_docs.withColumn("a.b", F.lit(1)).withColumn("keep", F.lit(2)).withColumn("text_hash", F.lit(3)).withColumn("id", F.lit(4)).withColumn("lines", F.lit(5))
    assert run_lines(spark, docs, min_chars=10, min_docs=2) == brute_lines(rows, 10, 2)
    assert run_lines(spark, no_docs) == []


def test_lines_of_a_very_long_text(spark):
    long = "\n".join(f"line number {i % 20000} of a very long text, with more words" for i in range(60000))
    docs = [(i, long if i < 3 else "line number 7 of a very long text, with more words\nx") for i in range(7)]
    assert run_lines(spark, spark.createDataFrame(docs, "doc_id long, text string")) == brute_lines(docs)


def test_bitmaps_are_compressed_bits(spark):
    line = "a line that every single document of this table holds"
    docs = spark.createDataFrame([(i, f"x\n{line}\ny") for i in range(5)], "doc_id long, text string")
    rows = L.line_bitmaps(docs, Scratch(spark, "test-lines")).collect()
    assert sorted(r.id for r in rows) == [0, 1, 2, 3]
    assert {zlib.decompress(r.keep) for r in rows} == {bytes([0b10111111])}


# ------------------------------------------------------------------ conversations


def cheapest(symbols):
    """(cost, letters) by a search over (row, state) in the order of cost, then letters."""
    queue, done = [(0, "", 0, C.START)], set()
    while queue:
        cost, letters, i, s = heapq.heappop(queue)
        if (i, s) in done:
            continue
        done.add((i, s))
        if i == len(symbols) and s in (C.START, C.A):
            return cost, letters
        nxt = C.A if s == C.U else C.U
        heapq.heappush(queue, (cost + 2, letters + "I", i, nxt))
        if i < len(symbols):
            initial, fault = symbols[i]
            heapq.heappush(queue, (cost + 3, letters + "D", i + 1, s))
            if fault in ("", "truncated"):
                extra = fault == "truncated"
                to = {("s", C.START): C.S, ("u", C.START): C.U, ("u", C.S): C.U, ("a", C.U): C.A, ("u", C.A): C.U}.get((initial, s))
                if to is not None:
                    heapq.heappush(queue, (cost + extra, letters + "K", i + 1, to))
                heapq.heappush(queue, (cost + extra + 2, letters + "R", i + 1, nxt))
    raise AssertionError


def brute_conversation(rows):
    """rows: (turn, role, text) in order -> (gaps, blank, duplicate, truncated, illegal, cost, audit, repaired lines)."""
    seen, symbols = set(), []
    for _, role, text in rows:
        body = text.rstrip(L.BLANKS)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"
        seen.add((role, text))
        symbols.append((role[:1], fault))
    cost, audit = cheapest(symbols)
    out, i, s = [], 0, C.START
    for letter in audit:
        nxt = C.A if s == C.U else C.U
        if letter in "IR":
            s = nxt
            out.append((C.ROLE_OF[s], "" if letter == "I" else rows[i][2]))
        elif letter == "K":
            s = C.S if rows[i][1][:1] == "s" else nxt
            out.append(rows[i][1:])
        i += letter != "I"
    turns = {t for t, _, _ in rows if t is not None}
    n = lambda kind: sum(f == kind for _, f in symbols)
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(symbols, symbols[1:], strict=False))
    text = "\n".join(f"{r}:{t}" for r, t in out)
    assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, n("blank"), n("duplicate"), n("truncated"), illegal, cost, audit, sha(text))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 8), max_size=14))
def test_block_tables_give_the_cheapest_least_edits(symbols):
    t = C.tables()
    import numpy as np

    codes = t.codes(np.array([symbols], np.int64).reshape(1, -1))
    behind = t.behind(codes, np.zeros(1, np.int16))
    letters, state = t.trace(codes[0], behind[0], C.START)
    letters += {C.S: "II", C.U: "I"}.get(state, "")
    names = [("sua?"[x % 4], "truncated" if x >= 4 else "") if x < 8 else ("u", "blank") for x in symbols]
    assert letters == cheapest(names)[1]


def test_tables_are_the_block_closure_of_single_steps():
    t = C.Tables(2)
    for v in range(len(t.vectors)):
        for a in range(C.SYMBOLS):
            for b in range(C.SYMBOLS):
                assert t.before[v, a * C.SYMBOLS + b] == t.step[t.step[v, b], a]
    assert len(t.vectors) < 200


def random_conversations(seed, n, longest):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        size = longest if conv == 1 else rng.randrange(1, 9)
        for turn in range(size):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "cut off", f"Text {turn}.", f"Text {turn} ?\n ", " \t", "", None, "Schön. ", "x."])
            rows.append((None if conv == 5 else conv, rng.choice([turn] * 6 + [turn + 3, None]), role, text))
    return rows


def run_repair(spark, rows, **options):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, `a.b` int") if rows and len(rows[0]) == 5 else \
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    scratch = Scratch(spark, "test-conversations")
    return C.repair(C.undamaged(df), scratch, **options)


def ordered(spark, rows):
    """The defined order: turn, then role, then the hashes of role and text."""
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    marked = C._marked(C.undamaged(df)).select("conv", "turn", "role", "h1", "h2", "text").collect()
    groups = defaultdict(list)
    for r in marked:
        groups[r.conv].append(((r.turn is not None, r.turn or 0, r.role.encode(), r.h1, r.h2), (r.turn, r.role, r.text)))
    return {conv: [row for _, row in sorted(found, key=lambda x: x[0])] for conv, found in groups.items()}


@pytest.mark.parametrize("segment_rows,partitions,longest", [(4096, None, 12), (1, 3, 40), (3, 9, 200), (4, 1, 60)])
def test_repair_against_search(spark, segment_rows, partitions, longest):
    rows = random_conversations(segment_rows, 30, longest)
    got = {r[0]: tuple(r[1:]) for r in run_repair(spark, rows, segment_rows=segment_rows, partitions=partitions).collect()}
    assert got == {conv: brute_conversation(found) for conv, found in ordered(spark, rows).items()}


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi again."), (1, 2, "system", "S."), (2, 0, "system", "Be kind."), (2, 1, "assistant", "cut")]
    got = sorted(tuple(r) for r in run_repair(spark, rows, turns=True).collect())
    assert got == [
        (1, 0, "K", "user", "Hi."), (1, 1, "I", "assistant", ""), (1, 2, "K", "user", "Hi again."), (1, 3, "R", "assistant", "S."),
        (2, 0, "K", "system", "Be kind."), (2, 1, "I", "user", ""), (2, 2, "K", "assistant", "cut"),
    ]


def test_damage_and_conversations_left_without_rows(spark):
    rows = [(i, j, r, f"Text {i} {j}.") for i in range(200) for j, r in enumerate(["user", "assistant"] if i % 3 else ["user"])]
    rows += [(None, None, None, None), (None, 2, "user", " "), (7, None, "user", "x" * 300_000 + ".")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    damaged = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        how = zlib.crc32(f"{' ' if r[0] is None else r[0]}:{' ' if r[1] is None else r[1]}".encode()) % 20
        role, text = r[2] or " ", r[3] or " "
        row = (r[1], "user" if how == 4 else role, "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text)
        damaged[r[0]] += [] if how == 0 else [row, row] if how == 3 else [row]
    empty = (0, 0, 0, 0, 0, 0, "", sha(""))
    got = {r[0]: tuple(r[1:]) for r in C.repair(C.damage(df), Scratch(spark, "test-conversations")).collect()}
    assert got == {conv: brute_conversation(found) if found else empty for conv, found in damaged.items()}
    assert empty in got.values()
    assert C.repair(C.damage(df.limit(0)), Scratch(spark, "test-conversations")).collect() == []


def test_extra_columns_of_conversations_are_not_read(spark):
    rows = [(1, 0, "user", "Hi.", 1), (1, 1, "assistant", "Yes.", 2)]
    assert run_repair(spark, rows).select("cost", "audit").collect() == [(0, "KK")]


# ------------------------------------------------------------------ Merkle


def brute_tree(leaves):
    """(root, paths, log): the log in the order of an appender that closes a node when its last leaf is in."""
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append([sha("".join(x[i : i + 8])) for i in range(0, len(x), 8)])
    paths = []
    for i in range(len(leaves)):
        path = []
        for level, x in enumerate(levels[:-1]):
            at = i // 8**level
            run = at // 8 * 8
            path += ["".join(x[run:at]), "".join(x[at + 1 : run + 8])]
        paths.append(path)
    log = sorted(((min((j + 1) * 8**k, len(leaves)) - 1, k, d) for k, x in enumerate(levels) for j, d in enumerate(x)))
    return levels[-1][0], paths, [d for _, _, d in log]


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 511, 513, 4095, 4096, 4097])
def test_positions_in_closed_form(n):
    places, width, level = [], n, 0
    while True:
        places += [(int(M.position(level, j, n)), (min((j + 1) * 8**level, n) - 1, level)) for j in range(width)]
        if width == 1:
            break
        width, level = -(-width // 8), level + 1
    assert [p for p, _ in sorted(places, key=lambda x: x[1])] == list(range(len(places)))


def manifest(spark, docs, claim=None):
    scratch = Scratch(spark, "test-merkle")
    leaves = scratch.keep("digests", M.leaves_of(docs, claim))
    built = M.build_manifest(leaves, scratch)
    return built, M.prove(built, scratch)


def brute_manifest(rows):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    trees = defaultdict(list)
    for doc, text, lang, source, n in rows:
        trees[lang].append((doc is not None, doc or 0, sha("".join(enc(v) for v in (doc, source, lang, n, text)))))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {lang: brute_tree([leaf for *_, leaf in sorted(trees[lang])]) for lang in langs}
    root, tops, _ = brute_tree([built[lang][0] for lang in langs])
    out = []
    for lang, top in zip(langs, tops, strict=True):
        subroot, paths, _ = built[lang]
        for (known, doc, leaf), path in zip(sorted(trees[lang]), paths, strict=True):
            out.append((doc if known else None, leaf, subroot, root, sha("".join(path + top)), root, True))
    return sorted(out, key=repr), {lang: built[lang][2] for lang in langs}


def test_merkle_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(rng.choice([i, i, None, 17]), rng.choice(["Text", "", None, "Ä" * 9]), rng.choice(["en"] * 20 + ["de", None, "", "ü", "fr"]), rng.choice(["s", None]), i % 3 or None) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("a.b", F.lit(1)).withColumn("index", F.lit(1))
    expected, logs = brute_manifest(rows)
    for levels in (4, 1, 2):  # blocks of 4096, 8 and 64 leaves: the last two need several bands
        monkeypatch.setattr(M, "BAND", levels)
        built, proofs = manifest(spark, docs)
        assert sorted((tuple(r) for r in proofs.collect()), key=repr) == expected
        log = defaultdict(list)
        for r in built.forest.log().orderBy("tree", "position").collect():
            assert r.position == len(log[r.tree])
            log[r.tree].append(r.digest)
        assert {k[1:] if k else None: v for k, v in log.items()} == logs


def test_merkle_finds_changed_rows(spark, odd_docs, no_docs):
    docs = odd_docs.withColumn("text", F.when(F.col("doc_id") == 5, "ONE").otherwise(F.col("text")))
    low = F.lower("text")
    claim = M.leaf_digest([low if c == "text" else F.col(c) for c in M.FIELDS])
    _, proofs = manifest(spark, docs, claim)
    rows = proofs.collect()
    assert len(rows) == 11 and {r.id for r in rows if not r.verified} == {5}
    assert all((r.folded_root == r.root) == r.verified for r in rows)
    _, none = manifest(spark, no_docs)
    assert none.collect() == []


def test_merkle_of_a_very_long_text_and_of_one_row(spark):
    rows = [(1, "Lorem " * 200_000, "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert [tuple(r) for r in manifest(spark, docs)[1].collect()] == brute_manifest(rows)[0]
