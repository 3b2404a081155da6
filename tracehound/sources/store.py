"""Stored tables whose live folders are named by a log.

Every write has a folder of its own, ``path/batch=<tag>`` (with ``month=`` folders inside), and
becomes visible by one step: the next numbered file in ``path/_log``, which names all live
folders.  So

* a reader sees whole writes only, and always one state of the table;
* a micro-batch is stored once, however often it is handled: the log keeps the last batch of each
  writer, and a folder of an attempt that died is never named;
* folding small folders, collapsing replaced rows, expiry and truncation swap folders in the same
  step, beside running writers (a writer that loses the race for a number tries again);
* a query that follows the table reads the log as its stream: it gets each appended row once, and
  nothing that folding rewrites.

Folders that are no longer named stay :data:`KEEP_GONE_MS` for readers that still have them open.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..session import create_text, delete_path, list_children, modified_ms, path_exists, read_text

KEEP_GONE_MS = 3_600_000
KEEP_LOG_MS = 24 * 3_600_000  # a query that follows the table may lag this long
FOLD_AT = 50  # folders of one month and level that are folded into one of the next level
CHANGE = "generation bigint, kind string, added array<string>"
_LOCKS: dict[str, threading.Lock] = {}


class Store:
    """A table of ``schema``, in ``month`` folders where ``months`` is set."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, months: bool = True, sort: Sequence[str] = ()):
        self.spark, self.path, self.schema, self.months, self.sort = spark, path.rstrip("/"), schema, months, list(sort)
        self.log = f"{self.path}/_log"

    # -------------------------------------------------------------- log

    def exists(self) -> bool:
        return path_exists(self.spark, self.log)

    def _generations(self) -> dict[int, str]:
        names = (p for p in list_children(self.spark, self.log) if p.endswith(".json"))
        return {int(p.rpartition("/")[2][:-5]): p for p in names}

    def state(self) -> dict:
        """The newest state: ``live`` folders ([tag, month or None, level]), last batch of each writer, ``gone`` folders."""
        found = self._generations()
        if not found:
            return {"generation": -1, "kind": "new", "added": [], "live": [], "done": {}, "gone": []}
        return json.loads(read_text(self.spark, found[max(found)]))

    def _commit(self, kind: str, change: Callable[[dict], dict | None]) -> bool:
        """Append the state that ``change`` makes of the newest one; False if it declines."""
        with _LOCKS.setdefault(self.path, threading.Lock()):
            while True:
                old = self.state()
                now = int(time.time() * 1000)
                changed = change(old)
                if changed is None:
                    return False
                named = {tuple(x[:2]) for x in changed["live"]}
                gone = old["gone"] + [[*x[:2], now] for x in old["live"] if tuple(x[:2]) not in named]
                late = [g for g in gone if g[2] < now - KEEP_GONE_MS]
                new = {**old, "added": [], **changed, "generation": old["generation"] + 1, "kind": kind, "gone": [g for g in gone if g not in late]}
                if create_text(self.spark, f"{self.log}/{new['generation']:012d}.json", json.dumps(new)):
                    for tag, month, _ in late:
                        delete_path(self.spark, self._folder(tag, month))
                    return True

    def _folder(self, tag: str, month: int | None) -> str:
        return f"{self.path}/batch={tag}" + (f"/month={month}" if month is not None else "")

    def create(self) -> "Store":
        """An empty table, unless there is one."""
        if not self.exists():
            self._commit("create", lambda s: {"live": s["live"]} if s["generation"] < 0 else None)
        return self

    # -------------------------------------------------------------- write

    def _write(self, df: DataFrame, tag: str, level: int) -> list[list]:
        """Write a folder that nobody sees yet; its entries for the log."""
        where = f"{self.path}/batch={tag}"
        keys = [*(["month"] if self.months else []), *self.sort]
        writer = (df.sortWithinPartitions(*keys) if keys else df).write.mode("overwrite")
        (writer.partitionBy("month") if self.months else writer).parquet(where)
        if not self.months:
            return [[tag, None, level]]
        return [[tag, int(p.rpartition("=")[2]), level] for p in list_children(self.spark, where, "month=")]

    def append(self, df: DataFrame, batch: int | None = None, writer: str = "batch") -> bool:
        """Store rows.  With a ``batch`` number of a ``writer``, only once: False if that batch was stored before."""
        done = lambda s: batch is not None and s["done"].get(writer, -1) >= int(batch)
        if done(self.state()):
            return False
        entries = self._write(df, f"{writer}-{'x' if batch is None else int(batch)}-{uuid.uuid4().hex[:12]}", 0)

        def change(s: dict) -> dict | None:
            if done(s):
                return None
            mark = {} if batch is None else {writer: int(batch)}
            return {"live": s["live"] + entries, "added": sorted({self._folder(e[0], None) for e in entries}), "done": {**s["done"], **mark}}

        return self._commit("append", change)

    def replace(self, df: DataFrame) -> None:
        """Store rows in place of all others."""
        entries = self._write(df, f"all-{uuid.uuid4().hex[:12]}", 0)
        self._commit("replace", lambda s: {"live": entries})

    def rewrite(self, months: Sequence[int] | None, build: Callable[[DataFrame], DataFrame], kind: str = "rewrite", level: int | None = None) -> bool:
        """Replace the live folders of ``months`` (of one ``level``, if given; all for None) by what
        ``build`` makes of their rows.  Folders added meanwhile stay; False if an input was replaced meanwhile."""
        chosen = [e for e in self.state()["live"] if (months is None or e[1] in months) and (level is None or e[2] == level)]
        if not chosen:
            return False
        entries = self._write(build(self._frame(chosen)), f"{kind}-{uuid.uuid4().hex[:12]}", max(e[2] for e in chosen) + (level is not None))

        def change(s: dict) -> dict | None:
            if any(e not in s["live"] for e in chosen):
                return None
            return {"live": [e for e in s["live"] if e not in chosen] + entries}

        return self._commit(kind, change)

    def fold(self, at: int = FOLD_AT) -> None:
        """Merge the folders of a month and level into one of the next level, once there are ``at`` of them:
        a row is rewritten once a level, and a month keeps fewer than ``at`` folders a level."""
        while True:
            counts: dict[tuple, int] = {}
            for _, month, level in self.state()["live"]:
                counts[month, level] = counts.get((month, level), 0) + 1
            full = [(level, month) for (month, level), n in counts.items() if n >= at]
            if not full:
                return
            level, month = min(full, key=lambda x: (x[0], x[1] or 0))
            if not self.rewrite(None if month is None else [month], lambda df: df, "fold", level):
                return  # another rewrite was first; the next batch folds

    def drop_months(self, before: int) -> list[int]:
        """Take months before ``before`` out of the table; returns them."""
        gone = sorted({e[1] for e in self.state()["live"] if e[1] is not None and e[1] < before})
        if gone:
            self._commit("expire", lambda s: {"live": [e for e in s["live"] if e[1] is None or e[1] >= before]})
        return gone

    def truncate(self) -> None:
        self._commit("truncate", lambda s: {"live": []})

    def vacuum(self, keep_ms: int = KEEP_LOG_MS) -> None:
        """Delete old log files, folders of attempts that were never named, and folders given up before ``keep_ms``."""
        now = int(time.time() * 1000)
        state = self.state()
        for number, file in self._generations().items():
            if number < state["generation"] and modified_ms(self.spark, file) < now - keep_ms:
                delete_path(self.spark, file)
        named = {e[0] for e in state["live"]} | {g[0] for g in state["gone"] if g[2] >= now - keep_ms}
        for folder in list_children(self.spark, self.path, "batch="):
            if folder.rpartition("batch=")[2] not in named and modified_ms(self.spark, folder) < now - keep_ms:
                delete_path(self.spark, folder)

    # -------------------------------------------------------------- read

    def months_live(self) -> list[int]:
        return sorted({e[1] for e in self.state()["live"] if e[1] is not None})

    def _frame(self, entries: Sequence[Sequence]) -> DataFrame:
        extra = [T.StructField("month", T.IntegerType())] if self.months else []
        if not entries:
            return self.spark.createDataFrame([], T.StructType([*self.schema.fields, *extra]))
        return self._read([self._folder(e[0], e[1]) for e in entries])

    def _read(self, folders: Sequence[str]) -> DataFrame:
        extra = [T.StructField("month", T.IntegerType())] if self.months else []
        schema = T.StructType([*self.schema.fields, T.StructField("batch", T.StringType()), *extra])
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(*folders).drop("batch")

    def read(self, months: Sequence[int] | None = None) -> DataFrame:
        """The live rows, of some months only if given (filters on ``month`` prune folders, too)."""
        return self._frame([e for e in self.state()["live"] if months is None or e[1] in months])

    def newest(self, n: int, order: Callable[[DataFrame], DataFrame], where=None) -> DataFrame:
        """``order`` (a descending sort with limit ``n`` on the time of which ``month`` is the month) of the live
        rows: months are walked from the last one back until ``n`` rows are found, which none before can beat."""
        months, rows = [], None
        for month in reversed(self.months_live()):
            months.append(month)
            rows = self.read(months)
            rows = rows if where is None else rows.where(where)
            if rows.limit(n).count() >= n:
                break
        return order(self._frame([]) if rows is None else rows)

    def follow(self, handle: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict, commits: int = 1000) -> StreamingQuery:
        """Call ``handle(rows, batch id)`` with the appended rows, each once in the query's life (a batch that
        was cut short is handled again under its id); at most ``commits`` log files a batch."""
        self.create()

        def batch(changes: DataFrame, batch_id: int) -> None:
            added = changes.where("kind = 'append'").select(F.explode("added")).collect()  # one row a commit
            handle(self._read([r[0] for r in added]) if added else self._frame([]), batch_id)

        stream = self.spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", commits).json(self.log)
        return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger).start()
