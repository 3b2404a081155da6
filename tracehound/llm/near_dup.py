"""Near-duplicate documents: banded MinHash candidates, sequential Bayesian verification.

1. Documents with equal shingle sets become one class, represented by its smallest id.
2. Representatives are banded (``BANDS`` x ``ROWS`` minima, enough for a similarity at the
   threshold to be missed with probability below 1e-5); buckets with one member go away.
   Buckets that share members form candidate groups.
3. Every member is compared with its group's most central member (that with the most bucket
   mates): signature batches first, and a pair leaves when the posterior probability of
   reaching the threshold falls below ``MISS``; survivors are verified on their full sets.
   A group of n copies costs n comparisons, not n squared.  While a group still has ``FAMILY`` or
   more members outside all stars, and its last star took in a tenth of those that were left,
   the most central of them becomes the next centre.
4. The rest is exact.  Links that no centre shows are between texts of a
   group that is not yet one component.  With L the union of its centres' sets, two texts that
   reach the threshold t share at least t / (1 + t) * (n_x + n_y) shingles, of which at most
   min(|x & L|, |y & L|) lie inside L; so they share at least the difference outside L, and
   therefore one shingle of the correspondingly long prefixes of their outside shingles, rarest
   first.  Joining these prefixes by size class yields the pairs, which go through the same
   verification.  Only pairs whose bound can be met without any outside shingle are joined by
   group and size alone.
5. Components of the verified links; a class has the component of its representative.

No group is gathered in one task: members meet through joins on (group, size, shingle), whose
hot keys the adaptive planner can split, and nothing is capped.  Very long texts are read whole, an
empty table gives no rows.

Null and empty texts have no shingles and are linked with nothing.  A null id is linked with
nothing and is its own component (null).  Rows that share an id are one node; repeated rows
are copies of each other.  Columns other than the id and the text are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch
from .sqltext import quoted
from .textkit import PLAIN_SEPARATORS, mix64, rolling, slices, window_starts, words_of

BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
BATCH = 16
MISS = 1e-7
SIZE_CLASS = 0.01
FAMILY = 64  # members outside all stars from which a group gets another centre
MULTIPLIERS = tuple(int(x) * 2 + 1 for x in np.random.Generator(np.random.PCG64(42)).integers(1, 2**62, size=HASHES))


def shingle_sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the distinct shingles of each text, sorted; a text with fewer words is one shingle."""
    w = words_of(column, PLAIN_SEPARATORS)
    at, rows = window_starts(w.offsets, words)
    h = rolling(w.hash, words)[at] if len(at) else np.zeros(0, np.uint64)
    counts = np.diff(w.offsets)
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        own = np.array([rolling(w.hash[w.offsets[i] : w.offsets[i + 1]], int(counts[i]))[0] for i in short], np.uint64)
        h, rows = np.concatenate([h, own]), np.concatenate([rows, short])
    order = np.lexsort((h, rows))
    h, rows = h[order], rows[order]
    if len(h):
        first = np.append(True, (h[1:] != h[:-1]) | (rows[1:] != rows[:-1]))
        h, rows = h[first], rows[first]
    return h, np.searchsorted(rows, np.arange(len(counts) + 1))


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(id, n, key, sig): set size, 128-bit fingerprint of the set, packed 32-bit minima."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                h, offsets = shingle_sets(batch.column(1), words)
                n = np.diff(offsets)
                some = np.flatnonzero(n)
                key = np.zeros((len(n), 2), np.uint64)
                sig = np.zeros((len(n), HASHES), np.uint32)
                if len(some):
                    cuts = offsets[:-1][some]
                    with np.errstate(over="ignore"):
                        for j in range(2):
                            key[some, j] = np.add.reduceat(mix64(h, 11 + j), cuts)
                        for j, m in enumerate(MULTIPLIERS):
                            sig[some, j] = (np.minimum.reduceat(h * np.uint64(m), cuts) >> np.uint64(32)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), pa.array(n.astype(np.int64)),
                    pa.array([k.tobytes() if m else None for k, m in zip(key, n, strict=True)], pa.binary()),
                    pa.array([s.tobytes() if m else None for s, m in zip(sig, n, strict=True)], pa.binary()),
                ], ["id", "n", "key", "sig"])

    return docs.mapInArrow(sign, "id long, n long, key binary, sig binary")


def band_rows(reps: DataFrame) -> DataFrame:
    """(bucket, rep): one row a band, the band number being part of the bucket's hash."""

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
            out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), sig.shape[:2]).copy()
            for r in range(ROWS):
                out = mix64(out ^ (sig[:, :, r] << np.uint64(16)), r)
            rep = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(out.reshape(-1).view(np.int64)), pa.array(rep)], ["bucket", "rep"])

    return reps.select("rep", "sig").mapInArrow(band, "bucket long, rep long")


def least_matches(threshold: float, miss: float = MISS) -> list[int]:
    """For each batch end k: the fewest equal minima that keep P(similarity >= threshold) above ``miss``.

    Under a uniform prior that posterior is P(Binomial(k + 1, threshold) <= matches)."""
    out = []
    for k in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, -1
        while total <= miss:
            m += 1
            total += comb(k + 1, m) * threshold**m * (1 - threshold) ** (k + 1 - m)
        out.append(m)
    return out


def bayes_survivors(pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs (x, y, sig_x, sig_y) that no signature batch has pruned, as (x, y)."""
    least = least_matches(threshold)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                part = batch.slice(at, 20_000)
                a, b = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint32).reshape(-1, HASHES) for c in (2, 3))
                alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
                for i, need in enumerate(least):
                    cols = slice(i * BATCH, (i + 1) * BATCH)
                    matches = matches + (a[alive, cols] == b[alive, cols]).sum(axis=1)
                    keep = matches >= need
                    alive, matches = alive[keep], matches[keep]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(alive)), part.column(1).take(pa.array(alive))], ["x", "y"])

    return pairs.select("x", "y", "sig_x", "sig_y").mapInArrow(prune, "x long, y long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold_pct: int = 80,
) -> DataFrame:
    """One row a document: id, n_shingles, component_id (the smallest id reachable by links of
    100 * intersection >= ``threshold_pct`` * union)."""
    t = threshold_pct / 100
    scratch = Scratch(docs.sparkSession, "neardup")
    texts = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).alias("text"))
    signed = scratch.keep("signed", signatures(texts, words))
    known = signed.where("id IS NOT NULL AND n > 0")

    # 1. classes of equal sets; a repeated id with different texts ties its classes
    reps = scratch.keep("reps", known.groupBy("key").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.count("*").alias("copies")))
    copies = reps.where("copies > 1").select("key", F.col("rep").alias("class_rep"))
    ties = (
        known.join(known.groupBy("id").agg(F.min("key").alias("k0"), F.max("key").alias("k1")).where("k0 <> k1").select("id"), "id", "left_semi")
        .join(reps.select("key", "rep"), "key").select(F.col("id").alias("x"), F.col("rep").alias("y"))
    )

    # 2. buckets with at least two members, and the groups they form
    banded = band_rows(reps)
    full = banded.groupBy("bucket").agg(F.min("rep").alias("first"), F.count("*").alias("size")).where("size > 1")
    members = scratch.keep("members", banded.join(full, "bucket").select("rep", "first", "size"))
    groups = connected_components(members.select("rep", "first"), scratch, "groups")
    central = members.groupBy("rep").agg(F.sum("size").alias("mates"))
    groups = scratch.keep("grouped", groups.join(central, F.col("node") == F.col("rep")).select("rep", F.col("component").alias("grp"), "mates"))
    scratch.release()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                h, offsets = shingle_sets(batch.column(1), words)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), lists], ["rep", "grp", "shingles"])

    wanted = groups.select(F.col("rep").alias("id"), "grp")
    # the wanted ids grow with the corpus: a sort-merge join at every size
    sets = scratch.keep("sets", texts.join(wanted.hint("merge"), "id").select("id", "text", "grp").mapInArrow(cut, "rep long, grp long, shingles array<bigint>"))

    # 3. every member against its group's central members
    need = lambda a, b, inter: inter * 100 >= threshold_pct * (F.size(a) + F.size(b) - inter)
    sig = reps.select("rep", "sig")
    stars = cores = None  # (rep, star), a centre being in its own; (grp, core)
    left = groups
    for number in itertools.count():
        leaders = scratch.keep(f"leaders{number}", left.groupBy("grp").agg(F.max(F.struct("mates", (-F.col("rep")).alias("r"))).alias("top")).select("grp", (-F.col("top.r")).alias("leader")))
        star = scratch.keep(f"star{number}", star_of(left, leaders, sets, sig, need, t, scratch))
        core = sets.join(leaders.select(F.col("leader").alias("rep")), "rep", "left_semi").select("grp", F.col("rep").alias("star"), F.col("shingles").alias("core"))
        stars, cores = (star, core) if stars is None else (stars.unionByName(star), cores.unionByName(core))
        took = left.join(star, "rep", "left").groupBy("grp").agg(F.count("star").alias("took"), F.count("*").alias("all"))
        again = took.where((F.col("all") - F.col("took") >= FAMILY) & (F.col("took") * 10 >= F.col("all"))).select("grp")
        left = scratch.keep(f"left{number}", left.join(again, "grp", "left_semi").join(star, "rep", "left_anti"))
        scratch.release()
        if left.limit(1).count() == 0:
            break
    links = stars.where("rep <> star").select(F.col("rep").alias("x"), F.col("star").alias("y"))

    # 4. groups of three or more that are not one component yet: prefixes outside the centres
    size = groups.groupBy("grp").agg(F.count("*").alias("size"))
    most = groups.join(stars, "rep").groupBy("grp", "star").agg(F.count("*").alias("n")).groupBy("grp").agg(F.max("n").alias("most"))
    open_groups = scratch.keep("open", size.join(most, "grp").where("size > 2 AND most < size").select("grp"))
    own = scratch.keep("own", cores.join(open_groups, "grp", "left_semi"))
    centre = own.groupBy("grp").agg(F.array_distinct(F.flatten(F.collect_list("core"))).alias("core"))
    outside = scratch.keep("outside", sets.join(centre, "grp").join(stars, "rep", "left").join(own.select("star", F.col("core").alias("own_core")), "star", "left").select(
        "rep", "grp", F.size("shingles").cast("long").alias("n"), F.array_except("shingles", "core").alias("outside"),
        # texts of one star are one component already and need no pairs among themselves
        F.coalesce("star", "rep").alias("star"), F.col("star").alias("centre"),
        F.when(F.col("star").isNotNull(), F.size(F.array_except("shingles", "own_core"))).alias("apart"),
    ).withColumn("inside", F.col("n") - F.size("outside")).withColumn("cls", F.floor(F.log("n") / SIZE_CLASS).cast("long")))
    scratch.release()
    rest = scratch.keep("restlinks", verified_pairs(prefix_pairs(outside, scratch.keep("partners", star_partners(outside, own)), t, scratch), sig, sets, need, t))

    scratch.release()

    # 5. components over representatives, then over documents
    links = links.unionByName(rest).unionByName(ties)
    parts = scratch.keep("parts", connected_components(links, scratch, "links"))
    scratch.drop("signed", "reps", "parts")
    scratch.release()
    labelled = signed.join(copies, "key", "left").withColumn("rep", F.coalesce("class_rep", "id"))
    return labelled.join(parts, F.col("rep") == F.col("node"), "left").select(
        F.col("id"), F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.coalesce("component", "rep")).otherwise(F.col("id")).alias("component_id"),
    )


def star_of(left: DataFrame, leaders: DataFrame, sets: DataFrame, sig: DataFrame, need, t: float, scratch: Scratch) -> DataFrame:
    """(rep, star): the members of ``left`` linked to their group's leader, and the leaders themselves."""
    others = left.join(leaders, "grp").where("rep <> leader").select("rep", "grp", "leader")
    pairs = others.select(F.col("rep").alias("x"), F.col("leader").alias("y")).join(sig.select(F.col("rep").alias("x"), F.col("sig").alias("sig_x")), "x").join(
        sig.select(F.col("rep").alias("y"), F.col("sig").alias("sig_y")), "y")
    survived = scratch.keep("survived", bayes_survivors(pairs, t)).select(F.col("x").alias("rep"), F.col("y").alias("leader"))
    lead = sets.join(leaders.select(F.col("leader").alias("rep")), "rep", "left_semi").select(F.col("rep").alias("leader"), F.col("shingles").alias("core"))
    linked = sets.join(survived, "rep").join(lead, "leader").where(need("shingles", "core", F.size(F.array_intersect("shingles", "core"))))
    return linked.select("rep", F.col("leader").alias("star")).unionByName(leaders.select(F.col("leader").alias("rep"), F.col("leader").alias("star")))


def star_partners(outside: DataFrame, cores: DataFrame) -> DataFrame:
    """(grp, centre, partner, shared, far): pairs of stars of one group (null: the texts in none), with the
    shingles that both centres hold and the most that a text of the partner has apart from its centre.

    Few rows: a group has as many stars as rounds."""
    kinds = outside.groupBy("grp", "centre").agg(F.max("apart").alias("far"))
    a, b = (cores.select("grp", F.col("star").alias(x), F.col("core").alias(f"core_{x}")) for x in ("centre", "partner"))
    met = a.join(b, "grp").where("centre <> partner").select("grp", "centre", "partner", F.size(F.array_intersect("core_centre", "core_partner")).alias("shared"))
    pairs = kinds.select("grp", "centre").join(kinds.select("grp", F.col("centre").alias("partner"), "far"), "grp").where("centre IS NULL OR NOT centre <=> partner")
    met = met.select("grp", F.col("centre").alias("c"), F.col("partner").alias("p"), "shared")
    return pairs.join(met.withColumnRenamed("grp", "g"), (F.col("grp") == F.col("g")) & (F.col("centre") == F.col("c")) & (F.col("partner") == F.col("p")), "left").select("grp", "centre", "partner", "shared", "far")


def prefix_pairs(outside: DataFrame, partners: DataFrame, t: float, scratch: Scratch) -> DataFrame:
    """Distinct pairs (x < y) of one group that can reach the threshold, of different stars."""
    share = t / (1 + t)
    # rarest first: counts of outside shingles within their group
    exploded = outside.select("rep", "grp", F.explode("outside").alias("z"))
    counts = exploded.groupBy("grp", "z").agg(F.count("*").alias("df")).where("df > 1")
    shared = exploded.join(counts, ["grp", "z"]).groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "z"))).alias("common"))
    # shingles of one text alone can be in no intersection: they come first in the order and are left out of the rows
    rows = outside.drop("outside").withColumn("outer", F.col("n") - F.col("inside")).join(shared, "rep", "left").withColumn(
        "common", F.coalesce("common", F.array().cast("array<struct<df:bigint,z:bigint>>")))
    # whatever the partner: no more than inside + common shingles can be shared
    rows = rows.where(F.col("inside") + F.size("common") >= F.ceil(F.col("n") * t - 1e-6))
    classes = outside.select("grp", "cls", "n").groupBy("grp", "cls").agg(F.min("n").alias("least_n"), F.max("n").alias("most_n"))
    probes = rows.join(classes.withColumnRenamed("cls", "partner"), "grp").where(
        (F.col("most_n") >= F.ceil(F.col("n") * t - 1e-6)) & (F.col("least_n") <= F.floor(F.col("n") / t + 1e-6)))
    needed = F.ceil((F.col("n") + F.col("least_n")) * share - 1e-6) - F.col("inside")
    # the first `outer - needed + 1` outside shingles, of which `outer - size(common)` are the text's own
    length = F.col("outer") - needed + 1 - (F.col("outer") - F.size("common"))
    # a text that needs no outside shingle for some partners still meets all partners that do
    hashes = F.transform("common", lambda c: c["z"])
    tokens = F.when(needed <= 0, F.concat(F.array(F.lit(None).cast("long")), hashes)).when(length > 0, F.slice(hashes, F.lit(1), F.greatest(length, F.lit(1)).cast("int")))
    least = F.ceil((F.col("n") + F.col("least_n")) * share - 1e-6)
    probes = scratch.keep("probes", probes.select(
        "rep", "grp", "cls", "partner", "star", "centre", "apart", least.alias("least"), "n", "inside", F.size("common").alias("commons"), F.explode(tokens).alias("z")))
    # without a shared outside shingle, texts of two stars share at most what the centres share and what
    # either has apart from its own: the other stars for which that may do are part of the key
    wide = probes.where("z IS NULL").join(partners.select(F.col("grp").alias("g"), F.col("centre").alias("c"), F.col("partner").alias("to"), "shared", "far"),
                                          (F.col("grp") == F.col("g")) & F.col("centre").eqNullSafe(F.col("c")))
    wide = wide.where(F.coalesce(F.col("shared") + F.col("apart") + F.col("far") >= F.col("least"), F.lit(True))).drop("g", "c", "shared", "far")
    nowhere = F.lit(None).cast("long")
    probes = wide.withColumn("at", F.col("centre")).unionByName(probes.where("z IS NOT NULL").withColumn("to", nowhere).withColumn("at", nowhere))
    a = probes.select(*[F.col(c).alias(f"a_{c}") for c in probes.columns])
    b = probes.select(*[F.col(c).alias(f"b_{c}") for c in probes.columns])
    most = F.least("a_inside", "b_inside") + F.when(F.col("a_z").isNull(), 0).otherwise(F.least("a_commons", "b_commons"))
    # a null token says that no shared outside shingle is needed: both ends must say so
    same = (
        (F.col("a_grp") == F.col("b_grp")) & (F.col("a_partner") == F.col("b_cls")) & (F.col("a_cls") == F.col("b_partner"))
        & F.col("a_z").eqNullSafe(F.col("b_z")) & F.col("a_to").eqNullSafe(F.col("b_at")) & F.col("a_at").eqNullSafe(F.col("b_to")) & (F.col("a_rep") < F.col("b_rep")) & (F.col("a_star") != F.col("b_star"))
        & (most >= F.ceil((F.col("a_n") + F.col("b_n")) * share - 1e-6))
    )
    return a.join(b, same).select(F.col("a_rep").alias("x"), F.col("b_rep").alias("y")).distinct()


def verified_pairs(pairs: DataFrame, sig: DataFrame, sets: DataFrame, need, t: float) -> DataFrame:
    """Signature batches first, then full sets."""
    signed = pairs.join(sig.select(F.col("rep").alias("x"), F.col("sig").alias("sig_x")), "x").join(sig.select(F.col("rep").alias("y"), F.col("sig").alias("sig_y")), "y")
    alive = bayes_survivors(signed, t)
    both = alive.join(sets.select(F.col("rep").alias("x"), F.col("shingles").alias("sx")), "x").join(sets.select(F.col("rep").alias("y"), F.col("shingles").alias("sy")), "y")
    return both.where(need("sx", "sy", F.size(F.array_intersect("sx", "sy")))).select("x", "y")
