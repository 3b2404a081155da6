"""Approximate nearest neighbours: an NN-descent graph and greedy graph search.

Equal vectors are one node (the smallest id), so a vector that a third of all rows share is
searched once; its smallest ids are looked up at the end.  Nodes are dealt to blocks of about
``NODES_PER_BLOCK`` by a hash of their id, and every step is a Spark exchange between blocks:

* start: each block's exact neighbours within itself, for ``DEALS`` independent dealings (one
  dealing alone would leave every neighbour list inside its block);
* a round joins neighbours of neighbours: the two ends of each sampled new or old edge send
  their vectors to one another's node, which compares its (new x all) members and sends each
  member the candidates that beat its worst neighbour; members keep their best ``DEGREE``.
  Rounds end when few neighbour entries change;
* search: a query starts at its own node's neighbours; a round expands its best unexpanded
  nodes (their blocks look up the adjacency, the candidates' blocks compute the cosine) and
  keeps the best ``BEAM``; it ends when all of them are expanded.  The graph stays where it
  is; only queries and candidates travel.

Between blocks travel packed arrays, each vector once for each pair of blocks.  A node in very
many neighbour lists (a hub) is named by one list of each sending block at most, so no block
receives an unbounded number of messages for one node; that is NN-descent's own sampling, and
affects which edges are tried, not which rows are indexed.  Every row is indexed.  The graph and
the beams hold normalised float32 vectors; scores are cosine - 1, taken in doubles and kept as
float32, so that close cosines near 1 do not tie.  Every node of a final beam gets the exact
cosine of the original vectors in doubles, at its block; a block sends a query its best only.

Vectors that are null, zero or hold null or non-finite components take no part, nor do those
whose length is not the most frequent one (the smallest of equals).  Ties go to the smaller id.
Repeated rows (one id, several vectors) are separate candidates of that id; a null id takes no
part.  An empty table has an empty result.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .sqltext import quoted
from .textkit import mix64

DEGREE = 24
SAMPLE = 14  # new edges a node tries in a round
EMIT = 6  # candidates one comparison list sends to one member
NODES_PER_BLOCK = 2_000
DEALS = 3
MAX_ROUNDS = 12
STOP_SHARE = 0.015
BEAM = 320
EXPAND = 96
MIN_BLOCKS = 4  # small tables go through the same rounds between blocks
MOST_TASKS = 10_000
NONE = -4  # score of an empty place; scores are cosine - 1
BLOCK_ROWS = "block int, kind string, blob binary, changed long"

NAMES = {"i8": np.int64, "f4": np.float32, "f8": np.float64, "u1": np.uint8}


def dump(**arrays: np.ndarray) -> bytes:
    """Named arrays as one compressed Arrow-codec blob."""
    head = ";".join(f"{k}:{a.dtype.str[1:]}:{','.join(map(str, a.shape))}" for k, a in arrays.items()).encode()
    body = len(head).to_bytes(4, "little") + head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays.values())
    return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def load(blob: bytes) -> dict[str, np.ndarray]:
    body = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    at = 4 + int.from_bytes(body[:4], "little")
    out = {}
    for item in body[4:at].decode().split(";"):
        name, kind, shape = item.split(":")
        dims = tuple(int(x) for x in shape.split(",") if x)
        n = int(np.prod(dims)) if dims else 1
        out[name] = np.frombuffer(body, NAMES[kind], n, at).reshape(dims)
        at += n * np.dtype(NAMES[kind]).itemsize
    return out


def block_of(ids: np.ndarray, blocks: int, deal: int = 0) -> np.ndarray:
    return (mix64(ids.astype(np.int64).view(np.uint64), 3 + deal) % np.uint64(blocks)).astype(np.int64)


def rows_of(table: pa.Table) -> dict[str, list[dict[str, np.ndarray]]]:
    out: dict[str, list] = {}
    for kind, blob in zip(table.column("kind").to_pylist(), table.column("blob").to_pylist(), strict=True):
        out.setdefault(kind, []).append(load(blob))
    return out


def table_of(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.binary(), pa.int64()), strict=True)], ["block", "kind", "blob", "changed"])


def gather(parts: list[dict[str, np.ndarray]], *names: str) -> list[np.ndarray]:
    return [np.concatenate([p[n] for p in parts]) for n in names]


def top_rows(owner: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Row numbers of the ``most`` best scores of each owner, by owner and descending score."""
    order = np.lexsort((-score, owner))
    o = owner[order]
    first = np.flatnonzero(np.append(True, o[1:] != o[:-1])) if len(o) else np.zeros(0, np.int64)
    rank = np.arange(len(o)) - np.repeat(first, np.diff(np.append(first, len(o))))
    return order[rank < most]


def filled(n: int, width: int, owner: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """Columns of rows sorted by owner as (n, width) matrices; -1 (or 0) where there is none."""
    first = np.searchsorted(owner, np.arange(n))
    rank = np.arange(len(owner)) - first[owner]
    out = []
    for c in columns:
        m = np.full((n, width), -1 if c.dtype != np.uint8 else 0, c.dtype)
        m[owner, rank] = c
        out.append(m)
    return out


def block_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.float64) @ b.astype(np.float64).T - 1).astype(np.float32)


def within(ids: np.ndarray, v: np.ndarray, degree: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact neighbours among the given nodes: (ids, scores), -1 where there are fewer."""
    n = len(ids)
    nbr, sim = np.full((n, degree), -1, np.int64), np.full((n, degree), NONE, np.float32)
    k = min(degree, n - 1)
    for a in range(0, n if k else 0, 1024):
        s = block_scores(v[a : a + 1024], v)
        s[np.arange(len(s)), np.arange(a, a + len(s))] = NONE - 1
        best = np.argpartition(-s, k - 1, axis=1)[:, :k]
        nbr[a : a + 1024, :k] = ids[best]
        sim[a : a + 1024, :k] = np.take_along_axis(s, best, 1)
    return nbr, sim


def start(blocks: int):
    """Rows (id, vec) of one dealing's block -> the home block's state, or candidates for home blocks."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        deal, block = (int(k.as_py()) for k in key)
        ids = table.column("id").to_numpy()
        order = np.argsort(ids)
        ids = ids[order]
        v = np.array(table.column("vec").to_pylist(), dtype=np.float64)[order]
        v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
        nbr, sim = within(ids, v, DEGREE)
        if deal == 0:
            return table_of([(block, "state", dump(id=ids, vec=v, nbr=nbr, sim=sim, new=(nbr >= 0).astype(np.uint8)), len(ids) * DEGREE)])
        node, slot = np.nonzero(nbr >= 0)
        p, q, score = ids[node], nbr[node, slot], sim[node, slot]
        to = block_of(p, blocks)
        return table_of([(int(b), "candidates", dump(p=p[to == b], q=q[to == b], score=score[to == b]), 0) for b in np.unique(to)])

    return run


def sampled_edges(state: dict[str, np.ndarray], rng: np.random.Generator, sample: int, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node row, neighbour, new flag): up to ``sample`` new and as many old edges a node; one list
    a block names a node at most twice per round."""
    node, slot = np.nonzero(state["nbr"] >= 0)
    flag = state["new"][node, slot]
    pick = top_rows(node * 2 + flag, rng.random(len(node)), sample)
    pick = pick[np.argsort(rng.random(len(pick)))]
    node, other, flag = node[pick], state["nbr"][node[pick], slot[pick]], flag[pick]
    limit = max(2, -(-2 * sample // blocks))
    keep = np.sort(top_rows(other, rng.random(len(other)) + flag, limit))
    return node[keep], other[keep], flag[keep]


def messages(kind: str, blocks: int, state: dict[str, np.ndarray], dst: np.ndarray, member: np.ndarray, flag: np.ndarray) -> list[tuple]:
    """Members' vectors to the blocks of the nodes that compare them."""
    out = []
    to = block_of(dst, blocks)
    order = np.argsort(to, kind="stable")
    dst, member, flag, to = dst[order], member[order], flag[order], to[order]
    cuts = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else []
    for a, b in zip(cuts, np.append(cuts[1:], len(to)), strict=True) if len(to) else []:
        rows, local = np.unique(member[a:b], return_inverse=True)
        out.append((int(to[a]), kind, dump(dst=dst[a:b], local=local.astype(np.int64), flag=flag[a:b], id=state["id"][rows], vec=state["vec"][rows], worst=state["sim"][rows].min(axis=1)), 0))
    return out


def edge_rows(blocks: int, sample: int, seed: int):
    """State -> for each sampled edge: own vector to the neighbour's block, and the edge itself, that it may answer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                s = load(blob)
                node, other, flag = sampled_edges(s, np.random.default_rng((seed, block)), sample, blocks)
                rows = messages("vectors", blocks, s, other, node, flag)
                to = block_of(other, blocks)
                for b in np.unique(to):
                    own = to == b
                    rows.append((int(b), "edges", dump(node=s["id"][node[own]], other=other[own], flag=flag[own]), 0))
                yield from table_of(rows).to_batches()

    return run


def answer_edges(blocks: int):
    """A block's state and the edges that name its nodes -> its nodes' vectors to the other ends."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        got = rows_of(table)
        if "edges" not in got or "state" not in got:
            return table_of([])
        s = got["state"][0]
        node, other, flag = gather(got["edges"], "node", "other", "flag")
        at = np.searchsorted(s["id"], other)
        return table_of(messages("vectors", blocks, s, node, at, flag))

    return run


def compare(blocks: int, cap: int):
    """Vectors that met at a block's nodes -> candidates for the members' blocks."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rng = np.random.default_rng(int(key[0].as_py()))
        got = rows_of(table)["vectors"]
        shift = np.cumsum([0] + [len(p["id"]) for p in got[:-1]])
        dst, flag, ids, vec, worst = gather(got, "dst", "flag", "id", "vec", "worst")
        local = np.concatenate([p["local"] + s for p, s in zip(got, shift, strict=True)])
        nodes, dst = np.unique(dst, return_inverse=True)
        # one member once a node, new if any edge is new; then at most `cap` of either kind
        order = np.lexsort((-flag.astype(np.int64), ids[local], dst))
        dst, local, flag = dst[order], local[order], flag[order]
        first = np.append(True, (dst[1:] != dst[:-1]) | (ids[local][1:] != ids[local][:-1]))
        dst, local, flag = dst[first], local[first], flag[first]
        pick = np.sort(top_rows(dst * 2 + flag, rng.random(len(dst)), cap))
        dst, local, flag = dst[pick], local[pick], flag[pick]
        width = 2 * cap
        member, new = filled(len(nodes), width, dst, local, flag)
        p_out, q_out, s_out = [], [], []
        for a in range(0, len(nodes), 256):
            m, f = member[a : a + 256], new[a : a + 256] > 0
            v = vec[np.maximum(m, 0)].astype(np.float64)
            s = (np.matmul(v, v.transpose(0, 2, 1)) - 1).astype(np.float32)
            valid = (m >= 0)[:, :, None] & (m >= 0)[:, None, :] & (f[:, :, None] | f[:, None, :])
            valid[:, np.arange(width), np.arange(width)] = False
            s = np.where(valid & (s > worst[np.maximum(m, 0)][:, :, None]), s, NONE - 1)
            k = min(EMIT, width)
            best = np.argpartition(-s, k - 1, axis=2)[:, :, :k]
            score = np.take_along_axis(s, best, 2)
            g, i, j = np.nonzero(score > NONE)
            p_out.append(m[g, i])
            q_out.append(m[g, best[g, i, j]])
            s_out.append(score[g, i, j])
        p, q, score = np.concatenate(p_out), np.concatenate(q_out), np.concatenate(s_out).astype(np.float32)
        p, q = ids[p], ids[q]
        order = np.lexsort((q, p))
        p, q, score = p[order], q[order], score[order]
        once = np.append(True, (p[1:] != p[:-1]) | (q[1:] != q[:-1]))[: len(p)]
        p, q, score = p[once], q[once], score[once]
        best = top_rows(p, score, DEGREE)
        p, q, score = p[best], q[best], score[best]
        to = block_of(p, blocks)
        return table_of([(int(b), "candidates", dump(p=p[to == b], q=q[to == b], score=score[to == b]), 0) for b in np.unique(to)])

    return run


def merge(sample: int, blocks: int, seed: int):
    """State and candidates -> the next state; edges tried in this round are old from now on."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        block = int(key[0].as_py())
        got = rows_of(table)
        s = got["state"][0]
        n, degree = s["nbr"].shape
        new = s["new"].copy()
        if sample:
            tried_node, tried_other, _ = sampled_edges(s, np.random.default_rng((seed, block)), sample, blocks)
            hit = s["nbr"][tried_node] == tried_other[:, None]
            new[tried_node, hit.argmax(axis=1)] = 0
        owner, slot = np.nonzero(s["nbr"] >= 0)
        other, score, flag = s["nbr"][owner, slot], s["sim"][owner, slot], new[owner, slot]
        known = np.ones(len(owner), np.uint8)
        if "candidates" in got:
            p, q, c = gather(got["candidates"], "p", "q", "score")
            owner = np.concatenate([owner, np.searchsorted(s["id"], p)])
            other, score = np.concatenate([other, q]), np.concatenate([score, c])
            flag, known = np.concatenate([flag, np.ones(len(p), np.uint8)]), np.concatenate([known, np.zeros(len(p), np.uint8)])
        order = np.lexsort((-known.astype(np.int64), other, owner))
        owner, other, score, flag, known = (x[order] for x in (owner, other, score, flag, known))
        once = np.append(True, (owner[1:] != owner[:-1]) | (other[1:] != other[:-1]))[: len(owner)]
        owner, other, score, flag, known = (x[once] for x in (owner, other, score, flag, known))
        best = top_rows(owner, score, degree)
        owner, other, score, flag, known = (x[best] for x in (owner, other, score, flag, known))
        nbr, sim, fresh = filled(n, degree, owner, other, score, flag)
        sim[nbr < 0] = NONE
        return table_of([(block, "state", dump(id=s["id"], vec=s["vec"], nbr=nbr, sim=sim, new=fresh), int((known == 0).sum()))])

    return run


def reverse_rows(blocks: int):
    """State -> its edges to the blocks of their far ends, two a far end from one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(2).to_pylist():
                s = load(blob)
                node, slot = np.nonzero(s["nbr"] >= 0)
                other, sim = s["nbr"][node, slot], s["sim"][node, slot]
                keep = top_rows(other, sim, max(2, -(-2 * DEGREE // blocks)))
                node, other, sim = s["id"][node[keep]], other[keep], sim[keep]
                to = block_of(other, blocks)
                yield from table_of([(int(b), "edges", dump(node=node[to == b], other=other[to == b], score=sim[to == b]), 0) for b in np.unique(to)]).to_batches()

    return run


def adjacency():
    """State and reverse edges -> (id, vec, own neighbours and the nearest ``DEGREE`` that name the node)."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        got = rows_of(table)
        s = got["state"][0]
        owner, slot = np.nonzero(s["nbr"] >= 0)
        other = s["nbr"][owner, slot]
        if "edges" in got:
            node, far, score = gather(got["edges"], "node", "other", "score")
            far = np.searchsorted(s["id"], far)
            keep = top_rows(far, score, DEGREE)
            owner, other = np.concatenate([owner, far[keep]]), np.concatenate([other, node[keep]])
        order = np.lexsort((other, owner))
        owner, other = owner[order], other[order]
        once = np.append(True, (owner[1:] != owner[:-1]) | (other[1:] != other[:-1]))[: len(owner)]
        owner, other = owner[once], other[once]
        offsets = np.searchsorted(owner, np.arange(len(s["id"]) + 1))
        return table_of([(int(key[0].as_py()), "graph", dump(id=s["id"], vec=s["vec"], offsets=offsets.astype(np.int64), nbr=other), 0)])

    return run


def first_beams(blocks: int):
    """State and queries (ids of its nodes) -> beams: each query's own neighbours."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        got = rows_of(table)
        if "queries" not in got or "state" not in got:
            return table_of([])
        s = got["state"][0]
        q = np.unique(gather(got["queries"], "id")[0])
        at = np.searchsorted(s["id"], q)
        pool, sim = np.full((len(q), BEAM), -1, np.int64), np.full((len(q), BEAM), NONE, np.float32)
        w = min(BEAM, s["nbr"].shape[1])
        pool[:, :w], sim[:, :w] = s["nbr"][at, :w], s["sim"][at, :w]
        return table_of([(int(key[0].as_py()), "beams", dump(id=q, vec=s["vec"][at], pool=pool, sim=sim, done=np.zeros(pool.shape, np.uint8)), len(q))])

    return run


def to_expand(beams: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(query row, slot) of each query's best unexpanded nodes."""
    row, slot = np.nonzero((beams["pool"] >= 0) & (beams["done"] == 0))
    keep = np.sort(top_rows(row, beams["sim"][row, slot], EXPAND))
    return row[keep], slot[keep]


def expansions(blocks: int):
    """Beams -> (query with vector, node) pairs to the nodes' blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(2).to_pylist():
                s = load(blob)
                row, slot = to_expand(s)
                yield from table_of(pairs_out("expand", blocks, s["pool"][row, slot], row, s["id"], s["vec"], s["sim"].min(axis=1))).to_batches()

    return run


def pairs_out(kind: str, blocks: int, node: np.ndarray, row: np.ndarray, ids: np.ndarray, vec: np.ndarray, worst: np.ndarray) -> list[tuple]:
    to, out = block_of(node, blocks), []
    for b in np.unique(to):
        own = to == b
        used, local = np.unique(row[own], return_inverse=True)
        out.append((int(b), kind, dump(node=node[own], local=local.astype(np.int64), id=ids[used], vec=vec[used], worst=worst[used]), 0))
    return out


def met(parts: list[dict[str, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(node, query row, query id, vector, worst) over messages, each query once."""
    shift = np.cumsum([0] + [len(p["id"]) for p in parts[:-1]])
    node, ids, vec, worst = gather(parts, "node", "id", "vec", "worst")
    local = np.concatenate([p["local"] + s for p, s in zip(parts, shift, strict=True)])
    unique, first, inverse = np.unique(ids, return_index=True, return_inverse=True)
    return node, inverse[local], unique, vec[first], worst[first]


def distinct_pairs(row: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((node, row))
    row, node = row[order], node[order]
    once = np.append(True, (row[1:] != row[:-1]) | (node[1:] != node[:-1]))[: len(row)]
    return row[once], node[once]


def look_up(blocks: int):
    """Nodes to expand at their block -> (query, neighbour) pairs to the neighbours' blocks."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        got = rows_of(table)
        if "expand" not in got or "graph" not in got:
            return table_of([])
        g = got["graph"][0]
        node, row, ids, vec, worst = met(got["expand"])
        at = np.searchsorted(g["id"], node)
        n = g["offsets"][at + 1] - g["offsets"][at]
        pick = np.repeat(g["offsets"][at], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        row, other = distinct_pairs(np.repeat(row, n), g["nbr"][pick])
        return table_of(pairs_out("score", blocks, other, row, ids, vec, worst))

    return run


def cosines(blocks: int):
    """(query, node) pairs at the nodes' block -> those that beat the beam, to the queries' blocks."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        got = rows_of(table)
        if "score" not in got or "graph" not in got:
            return table_of([])
        g = got["graph"][0]
        node, row, ids, vec, worst = met(got["score"])
        row, node = distinct_pairs(row, node)
        at = np.searchsorted(g["id"], node)
        score = np.concatenate([
            (np.einsum("nd,nd->n", vec[row[a : a + 65536]].astype(np.float64), g["vec"][at[a : a + 65536]].astype(np.float64)) - 1).astype(np.float32) for a in range(0, len(row), 65536)
        ]) if len(row) else np.zeros(0, np.float32)
        keep = np.flatnonzero((score > worst[row]) & (ids[row] != node))
        keep = keep[top_rows(row[keep], score[keep], BEAM)]
        q, node, score = ids[row[keep]], node[keep], score[keep].astype(np.float32)
        to = block_of(q, blocks)
        return table_of([(int(b), "found", dump(q=q[to == b], node=node[to == b], score=score[to == b]), 0) for b in np.unique(to)])

    return run


def next_beams():
    """Beams and what was found -> beams with this round's nodes marked; ``changed`` counts open queries."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        got = rows_of(table)
        if "beams" not in got:
            return table_of([])
        s = got["beams"][0]
        row, slot = to_expand(s)
        done = s["done"].copy()
        done[row, slot] = 1
        owner, slot = np.nonzero(s["pool"] >= 0)
        node, score, flag = s["pool"][owner, slot], s["sim"][owner, slot], done[owner, slot]
        if "found" in got:
            q, more, c = gather(got["found"], "q", "node", "score")
            owner = np.concatenate([owner, np.searchsorted(s["id"], q)])
            node, score, flag = np.concatenate([node, more]), np.concatenate([score, c]), np.concatenate([flag, np.zeros(len(q), np.uint8)])
        order = np.lexsort((-flag.astype(np.int64), node, owner))
        owner, node, score, flag = (x[order] for x in (owner, node, score, flag))
        once = np.append(True, (owner[1:] != owner[:-1]) | (node[1:] != node[:-1]))[: len(owner)]
        owner, node, score, flag = (x[once] for x in (owner, node, score, flag))
        best = top_rows(owner, score, BEAM)
        owner, node, score, flag = (x[best] for x in (owner, node, score, flag))
        pool, sim, done = filled(len(s["id"]), BEAM, owner, node, score, flag)
        sim[pool < 0] = NONE
        open_ = int(((pool >= 0) & (done == 0)).any(axis=1).sum())
        return table_of([(int(key[0].as_py()), "beams", dump(id=s["id"], vec=s["vec"], pool=pool, sim=sim, done=done), open_)])

    return run


def exact_rows(key: tuple, table: pa.Table) -> pa.Table:
    """A block's nodes with their original vectors."""
    ids = table.column("id").to_numpy()
    order = np.argsort(ids)
    return table_of([(int(key[0].as_py()), "exact", dump(id=ids[order], vec=np.array(table.column("vec").to_pylist(), np.float64)[order]), 0)])


def whole_beams(blocks: int):
    """Exact vectors and final beams -> (query with original vector, node) pairs to the nodes' blocks."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        got = rows_of(table)
        if "beams" not in got:
            return table_of([])
        s, e = got["beams"][0], got["exact"][0]
        near = np.concatenate([s["id"][:, None], s["pool"]], axis=1)  # its own class, too
        row, slot = np.nonzero(np.append(np.ones((len(near), 1), bool), s["sim"] > NONE, axis=1))
        return table_of(pairs_out("exact pairs", blocks, near[row, slot], row, s["id"], e["vec"][np.searchsorted(e["id"], s["id"])], s["sim"].min(axis=1)))

    return run


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, each summed from the first component on."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def exact_cosines(most: int):
    """Pairs at the nodes' block -> (q, near, score): the block's ``most`` best of each query, smaller ids first of equals."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        got = rows_of(table)
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if "exact pairs" in got:
            e = got["exact"][0]
            node, row, ids, vec, _ = met(got["exact pairs"])
            at = np.searchsorted(e["id"], node)
            lengths, own = np.sqrt(dots(vec, vec)), np.sqrt(dots(e["vec"], e["vec"]))
            score = np.concatenate([dots(vec[row[a : a + 65536]], e["vec"][at[a : a + 65536]]) for a in range(0, len(row), 65536)]) / (lengths[row] * own[at])
            order = np.argsort(node, kind="stable")
            keep = order[top_rows(row[order], score[order], most)]
            out = [ids[row[keep]], node[keep], score[keep]]
        return pa.table([pa.array(c) for c in out], ["q", "near", "score"])

    return run


def by_block(df: DataFrame, run) -> DataFrame:
    return df.groupBy("block").applyInArrow(run, BLOCK_ROWS)


def beside(held: DataFrame, df: DataFrame, run, schema: str = BLOCK_ROWS) -> DataFrame:
    """The same for rows that go to the blocks of ``held``, which is dealt by block already and stays where it is."""

    def both(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return run(key, pa.concat_tables([left, right]))

    return held.groupBy("block").cogroup(df.groupBy("block")).applyInArrow(both, schema)


def in_place(df: DataFrame, blocks: int) -> DataFrame:
    """A frame dealt by block once and kept by the executors, on disk where memory is short; a lost
    part is read again from the written table behind it."""
    return df.repartition(min(blocks, MOST_TASKS), "block").persist()


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def build_graph(nodes: DataFrame, scratch: Scratch, blocks: int, total: int) -> DataFrame:
    """NN-descent over nodes (block, id, vec); returns the block states."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(1).to_numpy(zero_copy_only=False)
            for number in range(DEALS):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), number, np.int32)), pa.array(block_of(ids, blocks, number).astype(np.int32)), b.column(1), b.column(2)], ["deal", "block", "id", "vec"])

    dealt = nodes.mapInArrow(deal, "deal int, block int, id long, vec array<double>")
    first = dealt.groupBy("deal", "block").applyInArrow(start(blocks), BLOCK_ROWS)
    state = scratch.keep("state", by_block(first, merge(0, blocks, 0)))
    for number in range(MAX_ROUNDS):
        sent = scratch.keep("sent", state.mapInArrow(edge_rows(blocks, SAMPLE, number), BLOCK_ROWS))
        answered = by_block(state.unionByName(sent.where("kind = 'edges'")), answer_edges(blocks))
        candidates = by_block(sent.where("kind = 'vectors'").unionByName(answered), compare(blocks, SAMPLE))
        state = scratch.keep("state", by_block(state.unionByName(candidates), merge(SAMPLE, blocks, number)))
        if (state.agg(F.sum("changed")).first()[0] or 0) <= STOP_SHARE * total * DEGREE:
            break
    return state


def search(graph: DataFrame, state: DataFrame, queries: DataFrame, scratch: Scratch, blocks: int) -> DataFrame:
    """Beams of the queries (block, id) after greedy search."""

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        return table_of([(int(key[0].as_py()), "queries", dump(id=table.column("id").to_numpy()), 0)])

    asked = queries.groupBy("block").applyInArrow(pack, BLOCK_ROWS)
    beams = scratch.keep("beams", by_block(state.unionByName(asked), first_beams(blocks)))
    held = in_place(graph, blocks)
    try:
        while True:  # a round closes nodes for good or ends a query, so the rounds end
            pairs = beside(held, beams.mapInArrow(expansions(blocks), BLOCK_ROWS), look_up(blocks))
            found = beside(held, pairs, cosines(blocks))
            beams = scratch.keep("beams", by_block(beams.unionByName(found), next_beams()))
            if not beams.agg(F.sum("changed")).first()[0]:
                return beams
    finally:
        held.unpersist()


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found by cosine of each row that ``is_query`` marks."""
    scratch = Scratch(vectors.sparkSession, "nn")
    rows = vectors.where(usable(F.col(quoted(vector_col))) & F.col(quoted(id_col)).isNotNull()).select(
        F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(vector_col)).cast("array<double>").alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    length = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").select("d").first()
    rows = rows.where(F.size("vec") == (length["d"] if length else 0))
    # one node for equal vectors; of each class the k + 1 smallest ids can appear in a result
    classes = scratch.keep("classes", rows.groupBy("vec").agg(F.min("id").alias("node"), F.max("asks").alias("asks"), F.count("*").alias("copies")))
    total = classes.count()
    blocks = max(MIN_BLOCKS, -(-total // NODES_PER_BLOCK))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(block_of(b.column(0).to_numpy(zero_copy_only=False), blocks).astype(np.int32)), *b.columns], ["block", *b.schema.names])

    # a repeated id with several vectors has several classes; each is a node of its own number
    numbered = classes.withColumn("dup", F.row_number().over(Window.partitionBy("node").orderBy("vec")))
    numbered = scratch.keep("nodes", numbered.select(F.when(F.col("dup") == 1, F.col("node")).otherwise(F.xxhash64("node", "dup")).alias("id"), "vec", "asks", "node").mapInArrow(deal, "block int, id long, vec array<double>, asks boolean, node long"))
    state = build_graph(numbered.select("block", "id", "vec"), scratch, blocks, total)
    graph = scratch.keep("graph", by_block(state.unionByName(state.mapInArrow(reverse_rows(blocks), BLOCK_ROWS)), adjacency()))
    beams = search(graph, state, numbered.where("asks").select("block", "id"), scratch, blocks)

    # exact cosines of whole beams; the k + 1 best of a query are among the k + 1 best of each block
    exact = numbered.select("block", "id", "vec").groupBy("block").applyInArrow(exact_rows, BLOCK_ROWS)
    asked = by_block(exact.unionByName(beams), whole_beams(blocks))
    scored = exact.unionByName(asked).groupBy("block").applyInArrow(exact_cosines(k + 1), "q long, near long, score double")
    best_classes = scored.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "near"))).where(F.col("r") <= k + 1).drop("r")
    ids = rows.join(numbered.select("vec", F.col("id").alias("cls")), "vec").select("cls", "id", "asks")
    few = ids.select("cls", "id").withColumn("r", F.row_number().over(Window.partitionBy("cls").orderBy("id"))).where(F.col("r") <= k + 1).drop("r")
    answers = ids.where("asks").select(F.col("cls").alias("q"), F.col("id").alias("query_id")).join(best_classes, "q").join(few.select(F.col("cls").alias("near"), F.col("id").alias("vec_id")), "near").where(F.col("query_id") != F.col("vec_id"))
    ranked = answers.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    found = scratch.keep("found", ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
    scratch.drop("found")
    return found
