"""Conversation structure repair with Four-Russians block tables.

A row is one of nine symbols: it must go (blank, duplicate), or it begins with s, u, a or something else
and may be truncated.  Edits lead through four states (start, s, u, a); the cost of the cheapest end from
each state is a vector of four numbers.  Less its least entry, only a few vectors occur, so each has a
number, and a table gives for every vector and every block of :data:`BLOCK` symbols the vector before that
block.  Conversations are priced backward, a block a lookup; then their edits are traced forward, each
block expanded backward into the vectors between its rows, which decide ties exactly.

Rows are ordered by ranges, so that a conversation may span any number of tasks.  A task's rows are cut
in segments; one that may go on in a neighbour is a table from every vector (and state) behind it to the
one before it, and those small tables are chained along the conversation in sorted order, as streams.

Defined results: a null role or text is one space (such a text is blank, such a role has no legal
initial); a null or one-space part of the key of the damage is one space; a null turn comes first; rows
of one turn are ordered by role, then by a hash of role and text; rows without a conversation are one of
their own; an empty table has no conversations; very long texts travel once, to be written out; extra
columns are unread, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lines import BLANKS
from .scratch import Scratch
from .sqltext import quoted

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1  # fixed values: costs of the edits
START, S, U, A = range(4)
TURN_OF = (U, U, A, U)  # the state that the only legal user or assistant turn leads to
ROLE_OF = {U: "user", A: "assistant"}
INITIALS = "sua"
GOES, NOTHING = 8, 9  # symbols: 0-3 s, u, a, other; 4-7 the same, truncated; 8 must go; 9 no row
SYMBOLS = 10
BLOCK = 3
SEGMENT_ROWS = 4096
_LOCAL_BITS = 33
ORDER = ["conv", "turn", "role", "h1", "h2", "copy"]  # ascending, nulls first
# ------------------------------------------------------------------ cost vectors


def _after(state: int, symbol: int) -> int | None:
    """State after keeping a row of this symbol, if that is legal."""
    kind = symbol % 4
    if kind == 0:
        return S if state == START else None
    if kind == 3:
        return None
    return TURN_OF[state] if (U, A)[kind - 1] == TURN_OF[state] else None


def _closed(direct: list[int]) -> list[int]:
    """Costs when up to two turns may be inserted first."""
    once = [min(c, INSERT + direct[TURN_OF[s]]) for s, c in enumerate(direct)]
    return [min(c, INSERT + once[TURN_OF[s]]) for s, c in enumerate(direct)]


def edits(state: int, symbol: int, behind: tuple[int, ...]) -> list[tuple[str, int, int]]:
    """(letter, state after, total cost) of the edits that use up a row, ``behind`` the costs after it."""
    out = [("D", state, DELETE + behind[state])]
    if symbol < GOES:
        extra = TRUNCATED if symbol >= 4 else 0
        kept = _after(state, symbol)
        if kept is not None:
            out.append(("K", kept, KEEP + extra + behind[kept]))
        out.append(("R", TURN_OF[state], REROLE + extra + behind[TURN_OF[state]]))
    return out


def price(symbol: int, behind: tuple[int, ...]) -> list[int]:
    if symbol == NOTHING:
        return list(behind)
    return _closed([min(c for _, _, c in edits(s, symbol, behind)) for s in range(4)])


END = tuple(_closed([0, 99, 99, 0]))  # after the last row: start and a are legal ends


def _normalised(costs) -> tuple[int, ...]:
    least = min(costs)
    return tuple(c - least for c in costs)


class Tables:
    """Numbered normalised vectors, their transitions by symbol and by block, and a cache of expansions."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        self.vectors = [_normalised(END)]
        number = {self.vectors[0]: 0}
        steps = []
        for vector in self.vectors:  # grows while new vectors are met
            row = []
            for symbol in range(SYMBOLS):
                before = _normalised(price(symbol, vector))
                if before not in number:
                    number[before] = len(self.vectors)
                    self.vectors.append(before)
                row.append(number[before])
            steps.append(row)
        self.step = np.array(steps, np.int16)  # [vector behind, symbol] -> vector before
        table = np.arange(len(self.vectors), dtype=np.int16)[:, None]
        for _ in range(block):  # code = first symbol as the highest digit, so the last one is applied first
            table = self.step[table][:, :, :].transpose(0, 2, 1).reshape(len(self.vectors), -1)
        self.before = table  # [vector behind, block code] -> vector before
        self.expansions: dict[tuple[int, int, int], tuple[str, int]] = {}

    def expand(self, behind: int, code: int, state: int) -> tuple[str, int]:
        """Letters of the cheapest edits of one block from ``state``, the ASCII-least of equals, and the state after."""
        found = self.expansions.get((behind, code, state))
        if found is None:
            symbols = [code // SYMBOLS ** (self.block - 1 - i) % SYMBOLS for i in range(self.block)]
            after = [behind]
            for symbol in reversed(symbols):  # vectors between the rows, from the back
                after.append(int(self.step[after[-1], symbol]))
            letters, at = [], state
            for symbol, vector in zip(symbols, after[-2::-1], strict=True):
                if symbol == NOTHING:
                    continue
                costs = self.vectors[vector]
                here = price(symbol, costs)
                while True:  # letters in ASCII order: D, I, K, R
                    uses = {letter: (to, cost) for letter, to, cost in edits(at, symbol, costs)}
                    options = [*((x, *uses[x]) for x in ("D",) if x in uses), ("I", TURN_OF[at], INSERT + here[TURN_OF[at]])]
                    options += [(x, *uses[x]) for x in ("K", "R") if x in uses]
                    letter, at = next((x, to) for x, to, cost in options if cost == here[at])
                    letters.append(letter)
                    if letter != "I":
                        break
            found = self.expansions[behind, code, state] = ("".join(letters), at)
        return found

    def codes(self, symbols: np.ndarray) -> np.ndarray:
        """Block codes of rows of symbols (two-dimensional, filled with :data:`NOTHING`)."""
        n, width = symbols.shape
        blocks = max(1, -(-width // self.block))
        padded = np.full((n, blocks * self.block), NOTHING, np.int64)
        padded[:, :width] = symbols
        weights = SYMBOLS ** np.arange(self.block - 1, -1, -1)
        return padded.reshape(n, blocks, self.block) @ weights

    def behind(self, codes: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Vector behind each block and, first, before them all: [row, block + 1], by lookup from the back."""
        out = np.empty((len(codes), codes.shape[1] + 1), np.int16)
        out[:, -1] = last
        for b in range(codes.shape[1] - 1, -1, -1):
            out[:, b] = self.before[out[:, b + 1], codes[:, b]]
        return out

    def trace(self, codes: np.ndarray, behind: np.ndarray, state: int) -> tuple[str, int]:
        letters = []
        for code, vector in zip(codes.tolist(), behind[1:].tolist(), strict=True):
            piece, state = self.expand(vector, code, state)
            letters.append(piece)
        return "".join(letters), state


_TABLES: dict[int, Tables] = {}


def tables() -> Tables:
    if BLOCK not in _TABLES:
        _TABLES[BLOCK] = Tables(BLOCK)
    return _TABLES[BLOCK]


# ------------------------------------------------------------------ rows


def damage(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text, copy) after the damage by crc32(``conv_id:turn``) % 20; ``copy`` is null
    on a row that was dropped, and 1 on the second of a repeated one."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn"))) % 20
    text = one("text")
    rows = conversations.select(
        F.col("conv_id").alias("conv"), F.col("turn").cast("bigint").alias("turn"), F.when(how == 4, "user").otherwise(one("role")).alias("role"),
        F.when(how == 1, "").when(how == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(how == 0, F.array(F.lit(None).cast("int"))).when(how == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("copies"),
    )
    return rows.select("conv", "turn", "role", "text", F.explode("copies").alias("copy"))


def undamaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The same columns for rows as they are."""
    text = lambda c: F.coalesce(F.col(quoted(c)).cast("string"), F.lit(" "))
    return conversations.select(
        F.col(quoted(conv_col)).alias("conv"), F.col(quoted(turn_col)).cast("bigint").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"),
        F.lit(0).alias("copy"),
    )


def _marked(rows: DataFrame) -> DataFrame:
    """Adds the identity of role and text (``h1``, ``h2``) and the row's own faults."""
    end = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    return rows.select(
        "conv", "turn", "role", F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "role", "text").alias("h2"), "copy",
        (end == "").alias("blank"), (~end.isin(".", "!", "?", "")).alias("cut"), "text",
    )


def _segments(rows: pa.Table, firsts: pa.Table, kind: pa.Schema) -> pa.Table:
    """The rows of one block of a range -> its segments: runs of rows of one conversation.

    A segment inside the block is a whole conversation, priced and traced here; the first and the last
    may go on elsewhere and become tables from the vector behind them to the one before."""
    rows = rows.sort_by("local")
    n = rows.num_rows
    if not n:
        return kind.empty_table()
    t = tables()
    blank, cut = (rows.column(c).to_numpy() for c in ("blank", "cut"))
    again = ~np.isin(rows.column("local").to_numpy(), firsts.column("local").to_numpy()) & ~blank
    cut = cut & ~again & ~blank
    kinds = np.array([INITIALS.find(r[:1]) if r else -1 for r in rows.column("role").to_pylist()])
    symbols = np.where(blank | again, GOES, np.where(kinds < 0, 3, kinds) + np.where(cut, 4, 0))
    conv = rows.column("conv").to_pylist()
    starts = np.array([0] + [i for i in range(1, n) if conv[i] != conv[i - 1]])
    ends = np.append(starts[1:], n)
    edge = np.zeros(len(starts), bool)
    edge[[0, -1]] = True
    letters: list[str | None] = [None] * len(starts)
    maps: list[list[int] | None] = [None] * len(starts)
    whole = np.flatnonzero(~edge)
    if len(whole):
        width = int((ends - starts)[whole].max())
        at = starts[whole][:, None] + np.arange(width)
        codes = t.codes(np.where(at < ends[whole][:, None], symbols[np.minimum(at, n - 1)], NOTHING))
        behind = t.behind(codes, np.zeros(len(whole), np.int16))
        for i, s in enumerate(whole.tolist()):
            letters[s] = t.trace(codes[i], behind[i], START)[0]
    every = np.arange(len(t.vectors), dtype=np.int16)
    for s in np.flatnonzero(edge).tolist():
        codes = t.codes(symbols[None, starts[s] : ends[s]])
        maps[s] = t.behind(np.repeat(codes, len(every), 0), every)[:, 0].tolist()
    count = lambda x: np.add.reduceat(x.astype(np.int64), starts)
    first = rows.take(pa.array(starts))
    out = {c: first.column(c) for c in ("conv", "turn", "role", "h1", "h2", "copy", "pid")} | {
        "seq": first.column("local"), "blank": count(blank), "again": count(again), "cuts": count(cut), "letters": letters, "map": maps,
        "symbols": [symbols[a:b].astype(np.uint8).tobytes() if e else None for a, b, e in zip(starts, ends, edge, strict=True)],
    }
    return pa.table([out[f.name] if isinstance(out[f.name], pa.ChunkedArray) else pa.array(out[f.name], f.type) for f in kind], names=kind.names).cast(kind)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edge segments, last first in each conversation -> the vector behind each."""
    conv, vector, begun = None, 0, False
    for batch in batches:
        behind = []
        for c, table in zip(batch.column("conv").to_pylist(), batch.column("map"), strict=True):
            if not begun or c != conv:
                conv, vector, begun = c, 0, True
            behind.append(vector)
            vector = table.values[vector].as_py()
        keep = [n for n in batch.schema.names if n != "map"]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], pa.array(behind, pa.int32())], names=[*keep, "behind"])


class _Conversation:
    """One conversation read in order: its counts, its edits, the hash of what is left."""

    def __init__(self, conv):
        self.conv = conv
        self.turns, self.low, self.high, self.turn = 0, None, None, None
        self.blank = self.again = self.cuts = self.illegal = self.cost = self.place = 0
        self.initial: str | None = None
        self.traced, self.state = START, START  # after all letters known, after the letters used up
        self.audit: list[str] = []
        self.ready: deque[str] = deque()
        self.hash = hashlib.sha256()

    def segment(self, row: dict) -> None:
        letters = row["letters"]
        if letters is None:
            t = tables()
            codes = t.codes(np.frombuffer(row["symbols"], np.uint8).astype(np.int64)[None, :])
            behind = t.behind(codes, np.array([row["behind"]], np.int16))
            letters, self.traced = t.trace(codes[0], behind[0], self.traced)
        self.audit.append(letters)
        self.ready.extend(letters)
        self.blank += row["n_blank"]
        self.again += row["n_again"]
        self.cuts += row["n_cuts"]

    def _write(self, role: str, text: str, letter: str) -> tuple:
        self.hash.update((f"\n{role}:{text}" if self.place else f"{role}:{text}").encode())
        self.place += 1
        return self.conv, self.place - 1, letter, role, text

    def _insert(self) -> tuple:
        self.cost += INSERT
        self.state = TURN_OF[self.state]
        return self._write(ROLE_OF[self.state], "", "I")

    def row(self, row: dict) -> Iterator[tuple]:
        turn, role = row["turn"], row["role"]
        if turn is not None:
            self.turns += self.turn != turn
            self.low, self.high, self.turn = turn if self.low is None else self.low, turn, turn
        self.illegal += self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au")
        self.initial = role[:1]
        while (letter := self.ready.popleft()) == "I":
            yield self._insert()
        if letter == "D":
            self.cost += DELETE
            return
        self.cost += (REROLE if letter == "R" else KEEP) + (TRUNCATED if row["cut"] else 0)
        if letter == "K":
            self.state = S if role[:1] == "s" else TURN_OF[self.state]
        else:
            self.state = TURN_OF[self.state]
            role = ROLE_OF[self.state]
        yield self._write(role, row["text"], letter)

    def end(self) -> Iterator[tuple]:
        while self.state not in (START, A):
            self.audit.append("I")
            yield self._insert()

    def report(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (self.conv, gaps, self.blank, self.again, self.cuts, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


REPORT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
TURNS = "place bigint, edit string, role string, text string"


def _writer(turns: bool, flush: int = 2000):
    """Arrow function over rows and segments in order: a report a conversation, or its repaired turns."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.string(), pa.string()] if turns else [pa.int64()] * 6 + [pa.string()] * 2
        names = ["conv", *[c.split()[0] for c in (TURNS if turns else REPORT).split(", ")]]
        now: _Conversation | None = None
        out: list[tuple] = []
        conv_type = None

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            columns = zip(*found, strict=True) if found else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, [conv_type, *types], strict=True)], names=names)

        def finish(done: _Conversation) -> None:
            closing = list(done.end())
            out.extend(closing if turns else [done.report()])

        for batch in batches:
            conv_type = batch.schema.field("conv").type
            for row in batch.to_pylist():
                if now is None or row["conv"] != now.conv:
                    if now is not None:
                        finish(now)
                    now = _Conversation(row["conv"])
                if row["kind"] == 0:
                    now.segment(row)
                elif row["copy"] is not None:
                    written = list(now.row(row))
                    if turns:
                        out.extend(written)
                if len(out) >= flush:
                    yield batch_of(out)
                    out.clear()
        if now is not None:
            finish(now)
        if out:
            yield batch_of(out)

    return write


def repair(rows: DataFrame, scratch: Scratch, turns: bool = False, segment_rows: int = SEGMENT_ROWS, partitions: int | None = None) -> DataFrame:
    """Repair conversations given as (conv, turn, role, text, copy), see :func:`undamaged`.

    A report a conversation (faults, cost, audit, hash), or with ``turns`` the repaired turns (conv, place,
    edit, role, text).  Only the last step moves texts: a conversation is then one sorted stream, as its
    hash and its order ask for, read without being held."""
    known = _marked(rows)
    conv_kind = rows.schema["conv"].dataType.simpleString()
    narrow = known.where(F.col("copy").isNotNull()).drop("text")
    ranges = narrow.repartitionByRange(partitions, *ORDER) if partitions else narrow.repartitionByRange(*ORDER)
    number = ranges.sortWithinPartitions(*ORDER).withColumn("mono", F.monotonically_increasing_id())
    pid = F.shiftright("mono", _LOCAL_BITS)
    placed = number.withColumn("pid", pid).withColumn("local", F.col("mono") - F.shiftleft(pid, _LOCAL_BITS)).drop("mono")
    ordered = scratch.keep("ordered", placed.withColumn("part", F.floor(F.col("local") / segment_rows).cast("bigint")))
    # one row each (conversation, role and text) is its first; a repeated text is aggregated before it is exchanged
    firsts = ordered.groupBy("conv", "h1", "h2").agg(F.min(F.struct("pid", "local", "part")).alias("f")).select("f.*")
    schema = (
        f"conv {conv_kind}, turn bigint, role string, h1 bigint, h2 bigint, copy int, pid bigint, seq bigint, blank bigint, again bigint, cuts bigint, "
        "letters string, map array<int>, symbols binary"
    )
    arrow = _arrow_schema(rows, schema)
    cut = ordered.groupBy("pid", "part").cogroup(firsts.groupBy("pid", "part")).applyInArrow(lambda a, b: _segments(a, b, arrow), schema)
    segments = scratch.keep("segments", cut)
    open_ = segments.where(F.col("letters").isNull())
    # at most two segments a block of rows, read last first in each conversation
    sorted_ = open_.repartition("conv").sortWithinPartitions("conv", F.col("pid").desc(), F.col("seq").desc())
    chained = sorted_.mapInArrow(_chain, schema.replace("map array<int>, ", "") + ", behind int")
    counts = {"n_blank": "blank", "n_again": "again", "n_cuts": "cuts"}
    markers = (
        segments.where(F.col("letters").isNotNull()).drop("map").unionByName(chained, allowMissingColumns=True)
        .withColumnsRenamed({v: k for k, v in counts.items()}).withColumn("kind", F.lit(0))
    )
    all_ = known.drop("blank").withColumn("kind", F.lit(1)).unionByName(markers, allowMissingColumns=True)
    stream = all_.repartition("conv").sortWithinPartitions(*ORDER, "kind", "pid", "seq")
    return stream.mapInArrow(_writer(turns), f"conv {conv_kind}, {TURNS if turns else REPORT}")


def _arrow_schema(rows: DataFrame, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(rows.sparkSession.createDataFrame([], ddl).schema)
