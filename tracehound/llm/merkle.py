"""Merkle manifest of a table as a postorder append log.

Rows are leaves of one tree a partition value (``tree_col``), in the order of their id; a run of eight
consecutive nodes has its hash as parent, level by level.  Builders own aligned blocks of 8^4 leaves and
write a block's nodes in the order in which an appender would complete them (postorder).  The place of
a node in the log follows from its level and index alone (:func:`position`), so a proof addresses its
siblings by place, without links.  Block roots are the leaves of the next band of four levels, and the
trees' roots those of a last tree.  Proofs go top down: a block receives one path from its root upward
and each of its members adds the siblings found in its own block.

Defined results: every row is a leaf, repeated rows too (equal ids are ordered by their leaf); null
values are written ``-`` and differ from empty texts; a null id comes first, a null tree value is a tree
of its own and comes first; long texts are hashed where they are read and never travel; an empty table
has no leaves and no root; extra columns are unread, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .sqltext import quoted

ARITY = 8
BAND = 4  # levels a builder owns: blocks of ARITY ** BAND nodes
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODES = "tree string, size bigint, block bigint, level int, index bigint, position bigint, digest string, is_root boolean"
PATHS = "tree string, block bigint, path array<string>, subroot string, root string"
_LOCAL_BITS = 33  # monotonically_increasing_id = partition << 33 | row in the partition


def digest(data: str) -> str:
    return hashlib.sha256(data.encode()).hexdigest()


def position(level: int, index, size):
    """Place of a node in the postorder log of its tree: the nodes completed before its last leaf,
    then the levels that this leaf completes.  Numbers or numpy arrays."""
    last = np.minimum((np.asarray(index, np.int64) + 1) * ARITY**level, size) - 1
    place = last + level
    step = last // ARITY
    while np.any(step):
        place = place + step
        step = step // ARITY
    return place


def height(size: int) -> int:
    levels = 0
    while size > 1:
        size, levels = -(-size // ARITY), levels + 1
    return levels


def encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def tree_key(value: Column) -> Column:
    """A key that is never null and sorts as the values do, null first."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def _indexed(nodes: DataFrame, order: Sequence[str], scratch: Scratch, name: str) -> DataFrame:
    """Adds ``index`` within ``tree`` and the tree's ``size``.

    A tree of any size is cut into ranges of its order; a range knows its place by a table of one row for
    each range and tree in it."""
    keys = ["tree", *order]
    ranges = nodes.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("mono", F.monotonically_increasing_id())
    pid = F.shiftright("mono", _LOCAL_BITS)
    ranged = scratch.keep(name, ranges.withColumn("pid", pid).withColumn("local", F.col("mono") - F.shiftleft(pid, _LOCAL_BITS)).drop("mono"))
    runs = ranged.groupBy("tree", "pid").agg(F.count("*").alias("n"), F.min("local").alias("at"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(tree.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = runs.select("tree", "pid", (before - F.col("at")).alias("shift"), F.sum("n").over(tree).alias("size"))
    return ranged.join(placed, ["tree", "pid"]).withColumn("index", F.col("local") + F.col("shift")).drop("pid", "local", "shift")


def _builder(band: int, arity: int, levels: int):
    """Arrow function of one block: its nodes above level ``band * levels``, in completion order."""
    base = band * levels

    def build(block: pa.Table) -> pa.Table:
        block = block.sort_by("index")
        tree, size, number = (block.column(c)[0].as_py() for c in ("tree", "size", "block"))
        index, nodes = block.column("index").to_numpy(), block.column("digest").to_pylist()
        top = height(size)
        level_of, index_of, found = [], [], []
        if top <= base:  # the tree is this one node
            level_of, index_of, found = [base], [int(index[0])], list(nodes)
        for level in range(base + 1, min(base + levels, top) + 1):
            first = int(index[0]) // ARITY
            cuts = np.append(np.flatnonzero(np.append(True, np.diff(index // ARITY) != 0)), len(index))
            nodes = [digest("".join(nodes[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            index = first + np.arange(len(nodes))
            level_of += [level] * len(nodes)
            index_of += index.tolist()
            found += nodes
        places = np.array([int(position(lv, i, size)) for lv, i in zip(level_of, index_of, strict=True)], np.int64)
        order = np.argsort(places)
        n = len(order)
        return pa.table({
            "tree": pa.array([tree] * n, pa.string()), "size": pa.array([size] * n, pa.int64()), "block": pa.array([number] * n, pa.int64()),
            "level": pa.array(np.array(level_of, np.int32)[order]), "index": pa.array(np.array(index_of, np.int64)[order]),
            "position": pa.array(places[order]), "digest": pa.array([found[i] for i in order], pa.string()),
            "is_root": pa.array([level_of[i] == top for i in order]),
        })

    return build


@dataclass
class Forest:
    """The trees of a table: indexed leaves, and the log in bands of levels."""

    leaves: DataFrame  # tree, size, index, digest and what the caller added
    bands: list[DataFrame] = field(default_factory=list)

    def log(self) -> DataFrame:
        """The whole log: (tree, position, level, index, digest), leaves included."""
        inner = [b.where("level > 0").select("tree", "position", "level", "index", "digest") for b in self.bands]
        place = F.col("index") + F.aggregate(  # position(0, index): the nodes completed before this leaf
            F.transform(F.sequence(F.lit(1), F.lit(20)), lambda k: F.floor(F.col("index") / F.pow(F.lit(float(ARITY)), k)).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)
        out = self.leaves.select("tree", place.alias("position"), F.lit(0).alias("level"), "index", "digest")
        for one in inner:
            out = out.unionByName(one)
        return out

    def roots(self) -> DataFrame:
        """(tree, size, digest): a row a tree."""
        out = None
        for band in self.bands:
            found = band.where("is_root").select("tree", "size", "digest")
            out = found if out is None else out.unionByName(found)
        return out


def build_forest(nodes: DataFrame, order: Sequence[str], scratch: Scratch, name: str) -> Forest:
    """Trees over ``nodes`` (tree, digest, ... ) in the order of the columns ``order``."""
    leaves = scratch.keep(f"{name}-leaves", _indexed(nodes, order, scratch, f"{name}-ranged"))
    largest = leaves.agg(F.max("size")).first()[0] or 0
    forest, below = Forest(leaves), leaves
    while not forest.bands or ARITY ** (BAND * len(forest.bands)) < largest:
        band = len(forest.bands)
        blocks = below.select("tree", "size", "index", "digest", F.floor(F.col("index") / ARITY**BAND).cast("bigint").alias("block"))
        built = blocks.groupBy("tree", "block").applyInArrow(_builder(band, ARITY, BAND), NODES)
        forest.bands.append(scratch.keep(f"{name}-band{band}", built))
        below = forest.bands[-1].where((F.col("level") == BAND * (band + 1)) & ~F.col("is_root"))
    return forest


def _resolver(band: int, levels: int, emit):
    """Cogroup function: members of one block, and the block's nodes with the path above its root.

    For each member ``emit`` gets its siblings: left and right texts of each level, from the member's
    own level to the root of the whole manifest."""
    base = band * levels

    def resolve(members: pa.Table, segment: pa.Table) -> pa.Table:
        members = members.sort_by("index")
        if not members.num_rows or not segment.num_rows:
            return emit([], [], None, None)
        size = members.column("size")[0].as_py()
        above = segment.filter(pc.is_null(segment.column("position")))
        path, subroot, root = (above.column(c)[0].as_py() for c in ("path", "subroot", "root"))
        nodes = segment.filter(pc.is_valid(segment.column("position")))
        at = dict(zip(nodes.column("position").to_pylist(), nodes.column("digest").to_pylist(), strict=True))
        index = members.column("index").to_numpy()
        own = members.column("digest").to_pylist()
        at.update(zip(position(base, index, size).tolist(), own, strict=True))
        top = height(size)
        runs: dict[tuple[int, int], list[str]] = {}
        paths = []
        for i in index.tolist():
            mine = []
            for level in range(base, min(base + levels, top)):
                node = i // ARITY ** (level - base)
                run = node // ARITY
                if (level, run) not in runs:
                    width = -(-size // ARITY**level)
                    places = position(level, np.arange(run * ARITY, min(run * ARITY + ARITY, width)), size)
                    runs[level, run] = [at[p] for p in places.tolist()]
                siblings, me = runs[level, run], node % ARITY
                mine += ["".join(siblings[:me]), "".join(siblings[me + 1 :])]
            paths.append(mine + path)
        return emit(members, paths, subroot, root)

    return resolve


def _emit_paths(members, paths, subroot, root) -> pa.Table:
    n = len(paths)
    return pa.table({
        "tree": members.column("tree").cast(pa.string()) if n else pa.nulls(0, pa.string()),
        "block": members.column("index").cast(pa.int64()) if n else pa.nulls(0, pa.int64()),
        "path": pa.array(paths, pa.list_(pa.string())), "subroot": pa.array([subroot] * n, pa.string()), "root": pa.array([root] * n, pa.string()),
    })


def fold(leaf: str, path: Sequence[str]) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in zip(path[::2], path[1::2], strict=True):
        leaf = digest(left + leaf + right)
    return leaf


def _emit_proofs(members, paths, subroot, root) -> pa.Table:
    n = len(paths)
    claims = members.column("claim").to_pylist() if n else []
    folded = [fold(c, p) for c, p in zip(claims, paths, strict=True)]
    return pa.table({
        "id": members.column("id").cast(pa.int64()) if n else pa.nulls(0, pa.int64()),
        "leaf": members.column("digest").cast(pa.string()) if n else pa.nulls(0, pa.string()),
        "subroot": pa.array([subroot] * n, pa.string()), "root": pa.array([root] * n, pa.string()),
        "proof_sha256": pa.array([digest("".join(p)) for p in paths], pa.string()),
        "folded_root": pa.array(folded, pa.string()), "verified": pa.array([f == root for f in folded], pa.bool_()),
    })


def _blocked(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("index") / ARITY**BAND).cast("bigint"))


def _proved(forest: Forest, upper: DataFrame, emit, schema: str, scratch: Scratch, name: str) -> DataFrame:
    """Top down over the bands; ``upper`` (tree, path, subroot, root) is the path above each tree's root."""
    sizes = forest.roots().select("tree", "size")
    last = sum((F.col("size") > ARITY ** (BAND * b)).cast("int") for b in range(1, len(forest.bands))) if len(forest.bands) > 1 else F.lit(0)
    tops = upper.join(sizes, "tree").withColumn("last", last)
    paths = None
    for band in range(len(forest.bands) - 1, -1, -1):
        own = tops.where(F.col("last") == band).select("tree", F.lit(0).cast("bigint").alias("block"), "path", "subroot", "root")
        above = own if paths is None else own.unionByName(paths)
        segment = (
            forest.bands[band].where(F.col("level") > band * BAND).select("tree", "block", "position", "digest")
            .unionByName(above, allowMissingColumns=True)
        )
        members = _blocked(forest.leaves if band == 0 else forest.bands[band - 1].where((F.col("level") == BAND * band) & ~F.col("is_root")))
        how, kind = (emit, schema) if band == 0 else (_emit_paths, PATHS)
        paths = members.groupBy("tree", "block").cogroup(segment.groupBy("tree", "block")).applyInArrow(_resolver(band, BAND, how), kind)
        if band:
            paths = scratch.keep(f"{name}-paths{band}", paths)
    return paths


@dataclass
class Manifest:
    forest: Forest
    top: Forest


def build_manifest(leaves: DataFrame, scratch: Scratch) -> Manifest:
    """The trees of ``leaves`` (tree, id, digest, claim) and the tree of their roots."""
    forest = build_forest(leaves, ["id", "digest"], scratch, "trees")
    roots = forest.roots().select(F.lit("").alias("tree"), F.col("tree").alias("id"), "digest")
    return Manifest(forest, build_forest(roots, ["id"], scratch, "top"))


def prove(manifest: Manifest, scratch: Scratch) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified): each leaf's ``claim`` folded with
    the siblings found in the log and compared with the root."""
    root = manifest.top.roots().select("tree", F.array().cast("array<string>").alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    tops = _proved(manifest.top, root, _emit_paths, PATHS, scratch, "top")
    named = manifest.top.leaves.select(F.col("index").alias("block"), F.col("id").alias("of"), F.col("digest").alias("sub"))
    upper = tops.join(named, "block").select(F.col("of").alias("tree"), "path", F.col("sub").alias("subroot"), "root")
    schema = "id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _proved(manifest.forest, scratch.keep("upper", upper), _emit_proofs, schema, scratch, "trees")


def leaves_of(docs: DataFrame, claim: Column | None = None, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", tree_col: str = "lang") -> DataFrame:
    """(tree, id, digest, claim): ``claim`` is a digest to check in place of the leaf's own."""
    leaf = leaf_digest([F.col(quoted(c)) for c in fields])
    return docs.select(
        tree_key(F.col(quoted(tree_col))).alias("tree"), F.col(quoted(id_col)).cast("bigint").alias("id"), leaf.alias("digest"),
        (leaf if claim is None else claim).alias("claim"),
    )
