"""Streaming sequence rules (T1-T4): event-time ordering buffer + the batch rule logic.

A stream does not arrive in event-time order.  ``SuccessorBuffer`` is a
``transformWithStateInPandas`` processor that, per scope key, holds events until the
watermark passes them (T2), then releases them in ``(timestamp, id)`` order and emits
every released event together with the successors released so far (up to ``k``).  It
keeps only the last ``k`` released events between batches (T4), so state is bounded by
``k`` plus the out-of-order window.  Events at or before the released watermark are
late and dropped from matching (T3; the table sink stores them anyway).

An event is emitted once per number of known successors (0..k); a rule with ``m``
steps is evaluated on the row with exactly ``m - 1`` successors, so every (rule, start
event) pair is evaluated once, as soon as its last step is released.  The rule
conditions are the same Column expressions as in batch (``operators.rules``).

Scope ``endpoint`` keys the state by endpoint (scales with endpoints).  Scope
``global`` is the reference meaning: one key, so the ordering runs in one task - a
real limit of strict global contiguity, as in the reference.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.rules import Rule, RuleRegistry, _rule_hit
from ..schema import DETECTION_COLUMNS, DETECTIONS
from ..session import ship_package

BUFFER_FIELDS = (
    "id", "ts_ms", "endpoint_id", "event_type", "status", "direction", "bytes", "source_ip", "destination_ip",
    "process_name", "user",
)
_TYPES = {"ts_ms": T.LongType(), "bytes": T.LongType()}

STATE_SCHEMA = T.StructType(
    [T.StructField(f, _TYPES.get(f, T.StringType()), True) for f in BUFFER_FIELDS]
)
MARK_SCHEMA = T.StructType([T.StructField("upto", T.LongType(), True)])


def output_schema(k: int) -> T.StructType:
    fields = [T.StructField(f"c_{f}", _TYPES.get(f, T.StringType()), True) for f in BUFFER_FIELDS]
    for j in range(1, k + 1):
        fields += [T.StructField(f"n{j}_{f}", _TYPES.get(f, T.StringType()), True) for f in BUFFER_FIELDS]
    fields.append(T.StructField("avail", T.IntegerType(), True))
    return T.StructType(fields)


class SuccessorBuffer(StatefulProcessor):
    """Release events in event-time order once the watermark passes them; emit each
    with its known successors (see module doc)."""

    def __init__(self, k: int):
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", STATE_SCHEMA)
        self.tail = handle.getListState("tail", STATE_SCHEMA)
        self.mark = handle.getValueState("released", MARK_SCHEMA)

    # -- state helpers (whole lists are written with one put, never row by row)

    @staticmethod
    def _frame(items) -> pd.DataFrame:
        rows = list(items)
        if not rows:
            return pd.DataFrame({f: pd.Series(dtype="int64" if f == "ts_ms" else "object") for f in BUFFER_FIELDS})
        return pd.DataFrame([tuple(r) for r in rows], columns=list(BUFFER_FIELDS))

    @staticmethod
    def _tuples(df: pd.DataFrame) -> list[tuple]:
        return [
            tuple(None if (v is None or (isinstance(v, float) and np.isnan(v))) else (int(v) if f == "ts_ms" else v)
                  for f, v in zip(BUFFER_FIELDS, row))
            for row in df[list(BUFFER_FIELDS)].itertuples(index=False, name=None)
        ]

    def _released_upto(self) -> int:
        if self.mark.exists():
            return int(self.mark.get()[0])
        return -(1 << 62)

    # -- callbacks

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        wm = timerValues.getCurrentWatermarkInMs()
        floor = max(wm, self._released_upto())
        parts = [p[list(BUFFER_FIELDS)] for p in rows]
        new = pd.concat(parts, ignore_index=True) if parts else self._frame([])
        new = new[new["ts_ms"] > floor]  # late: at or before what was already released
        pend = self._frame(self.pending.get()) if self.pending.exists() else self._frame([])
        if len(new):
            pend = pd.concat([pend, new], ignore_index=True) if len(pend) else new
        yield from self._release(pend, wm)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        wm = timerValues.getCurrentWatermarkInMs()
        pend = self._frame(self.pending.get()) if self.pending.exists() else self._frame([])
        yield from self._release(pend, wm)

    def close(self) -> None:
        pass

    # -- core

    def _release(self, pend: pd.DataFrame, wm: int) -> Iterator[pd.DataFrame]:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if len(pend) == 0:
            self.pending.clear()
            return
        pend = pend.sort_values(["ts_ms", "id"], kind="mergesort").reset_index(drop=True)
        ready_mask = pend["ts_ms"].to_numpy() <= wm
        ready = pend[ready_mask]
        rest = pend[~ready_mask]
        if len(rest):
            self.pending.put(self._tuples(rest))
            self.handle.registerTimer(int(rest["ts_ms"].iloc[0]))
        else:
            self.pending.clear()
        if len(ready) == 0:
            return
        self.mark.update((int(max(wm, self._released_upto())),))
        tail = self._frame(self.tail.get()) if self.tail.exists() else self._frame([])
        seq = pd.concat([tail, ready], ignore_index=True) if len(tail) else ready.reset_index(drop=True)
        t_len, n, k = len(tail), len(seq), self.k
        self.tail.put(self._tuples(seq.iloc[max(0, n - k):]))
        idx = np.arange(n)
        old = np.where(idx < t_len, t_len - 1 - idx, -1)
        new = np.minimum(k, n - 1 - idx)
        count = np.maximum(new - old, 0)
        total = int(count.sum())
        if total == 0:
            return
        rep = np.repeat(idx, count)
        starts = np.repeat(np.cumsum(count) - count, count)
        avail = np.arange(total) - starts + np.repeat(old + 1, count)
        out = {}
        for f in BUFFER_FIELDS:
            out[f"c_{f}"] = seq[f].to_numpy()[rep]
        for j in range(1, k + 1):
            src = np.minimum(rep + j, n - 1)
            ok = avail >= j
            for f in BUFFER_FIELDS:
                vals = seq[f].to_numpy()[src]
                if f == "ts_ms":
                    col = pd.array(np.where(ok, vals, 0), dtype="Int64")
                    col[~ok] = pd.NA
                else:
                    col = np.where(ok, vals, None)
                out[f"n{j}_{f}"] = col
        out["avail"] = avail.astype("int32")
        yield pd.DataFrame(out)


def _struct(prefix: str) -> F.Column:
    cols = [F.col(f"{prefix}_{f}").alias(f) for f in BUFFER_FIELDS]
    cols.append(F.timestamp_millis(F.col(f"{prefix}_ts_ms")).alias("timestamp"))
    return F.struct(*cols)


def stream_rules(
    events: DataFrame,
    registry: RuleRegistry | list[Rule] | None = None,
    scope: str = "endpoint",
    delay: str = "5 seconds",
) -> DataFrame:
    """Detections of a stream of normalised events (T1-T4); same rows as
    :func:`operators.rules.apply_rules` over the on-time events."""
    if registry is None:
        registry = RuleRegistry.default()
    rules = registry.rules if isinstance(registry, RuleRegistry) else list(registry)
    if not rules:  # no rules, no detections; the stream keeps its schema
        return events.where(F.lit(False)).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in DETECTIONS.fields])
    k = max(len(r.steps) for r in rules) - 1
    ship_package(events.sparkSession)
    src = events
    if "ts_ms" not in src.columns:
        src = src.withColumn("ts_ms", F.unix_millis("timestamp"))
    src = src.withWatermark("timestamp", delay)
    key = F.col("endpoint_id") if scope == "endpoint" else F.lit("all")
    keyed = src.withColumn("_scope", key).select("_scope", "timestamp", *BUFFER_FIELDS)
    buffered = keyed.groupBy("_scope").transformWithStateInPandas(
        statefulProcessor=SuccessorBuffer(k),
        outputStructType=output_schema(k),
        outputMode="Append",
        timeMode="EventTime",
    )
    structs = [_struct("c")] + [F.when(F.col("avail") >= j, _struct(f"n{j}")) for j in range(1, k + 1)]
    hits = F.array(
        *[F.when(F.col("avail") == len(r.steps) - 1, _rule_hit(r, structs)) for r in rules]
    )
    return (
        buffered.select(F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("d"))
        .select("d.*")
        .withColumn("date", F.to_date("timestamp"))
        .select(*DETECTION_COLUMNS)
    )
