"""Streaming sequence rules that scale: micro-batches through the batch ordinal.

With ``scope="global"`` the next event of an event is the next one of the *whole*
stream, so a keyed state processor has a single key and orders the stream in one task.
This module keeps the reference meaning without that bottleneck: every micro-batch is
processed by the distributed batch machinery (:func:`operators.ordinal.next_rows`),
and only a small carried state links consecutive batches:

* ``pending`` - events not yet released (newer than the watermark: at most the
  out-of-order window of the stream),
* ``tail``    - the last ``k`` released events, so sequences can span batches,
* ``meta``    - one row: highest event time seen and the release bound.

The same works for ``scope="endpoint"`` (successors within the endpoint; the tail is
the last ``k`` events of every endpoint), and a hot endpoint is then spread over the
balanced range partitions instead of one keyed task.

A batch releases every pending or new event at or before the watermark
(``max event time seen - delay``), in ``(timestamp, id)`` order after the tail.  A rule
with ``m`` steps is evaluated at a start event exactly when its last step is among the
newly released events, so every (rule, start) pair is evaluated once.  Events at or
before the previous release bound are late: dropped from matching (they are still
stored by the events sink).

Carried rows are bounded: a tail row that lies ``within`` or more before the watermark can
begin no match any more and is dropped, and so are the state folders of all but the last two
batches.

A batch is done when its ``meta`` row is written, which happens last; handling a done batch
again changes nothing, and of one that was cut short the detections table takes the rows only
if its log does not name the batch yet.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ordinal import next_rows
from ..operators.rules import MATCH_FIELDS, Rule, RuleRegistry, _rule_hit
from ..schema import DETECTION_COLUMNS
from ..session import delete_path, path_exists
from ..sources.sinks import table_store, write_batch

CARRY_FIELDS = tuple(f for f in MATCH_FIELDS if f != "timestamp")
CARRY_DDL = ", ".join(f"{f} {'bigint' if f in ('ts_ms', 'bytes') else 'string'}" for f in (*CARRY_FIELDS, "kind"))
META_DDL = "max_seen bigint, released bigint"
_NEVER = -(1 << 62)


class GlobalRuleBatches:
    """``foreachBatch`` handler computing detections per micro-batch (either scope)."""

    def __init__(
        self, root: str, registry: RuleRegistry | list[Rule] | None = None, delay_ms: int = 5000,
        scope: str = "global", detections: str | None = None,
    ):
        registry = RuleRegistry.default() if registry is None else registry
        self.rules = registry.rules if isinstance(registry, RuleRegistry) else list(registry)
        self.k = max((len(r.steps) for r in self.rules), default=1) - 1
        self.within_ms = max((r.within_ms for r in self.rules), default=0)
        self.delay_ms = int(delay_ms)
        if scope not in ("global", "endpoint"):
            raise ValueError("scope must be 'global' or 'endpoint'")
        self.partition = ("endpoint_id",) if scope == "endpoint" else ()
        self.writer = f"rules-{scope}"
        self.detections = detections or os.path.join(root, f"detections_{scope}")
        self.state = os.path.join(root, f"_{scope}_state", "carry")
        self.meta = os.path.join(root, f"_{scope}_state", "meta")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if self.done(batch.sparkSession, batch_id):
            return
        batch = batch.persist()  # read once per micro-batch, used by several jobs
        try:
            self._process(batch, batch_id)
        finally:
            batch.unpersist()

    def done(self, spark: SparkSession, batch_id: int) -> bool:
        """Whether this or a later batch was handled to its end."""
        return any(path_exists(spark, os.path.join(self._of(self.meta, b), "_SUCCESS")) for b in (batch_id, batch_id + 1))

    @staticmethod
    def _of(path: str, batch_id: int) -> str:
        return os.path.join(path, f"batch={int(batch_id)}")

    def _process(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        carry = spark.createDataFrame([], CARRY_DDL)
        max_seen, released = (_NEVER, _NEVER)
        if batch_id > 0:  # only the first batch has no state before it
            carry = spark.read.schema(CARRY_DDL).parquet(self._of(self.state, batch_id - 1))
            row = spark.read.schema(META_DDL).parquet(self._of(self.meta, batch_id - 1)).first()
            max_seen, released = row.max_seen, row.released
        new = batch.select(
            *[F.col(c) for c in CARRY_FIELDS if c != "ts_ms"], F.unix_millis("timestamp").alias("ts_ms")
        ).where(F.col("ts_ms") > F.lit(released))
        top = new.agg(F.max("ts_ms")).first()[0]  # one row
        if top is not None:
            max_seen = max(max_seen, int(top))
        wm = max_seen - self.delay_ms if max_seen != _NEVER else _NEVER
        pending = carry.where(F.col("kind") == "pending").drop("kind").unionByName(new.select(*CARRY_FIELDS))
        tail = carry.where(F.col("kind") == "tail").drop("kind")
        release = pending.where(F.col("ts_ms") <= F.lit(wm))
        hold = pending.where(F.col("ts_ms") > F.lit(wm))
        # tail rows were released before: they give context but start no new match
        seq = (
            tail.withColumn("_tail", F.lit(True))
            .unionByName(release.withColumn("_tail", F.lit(False)))
            .withColumn("timestamp", F.timestamp_millis("ts_ms"))
        )
        new_tail, with_next = tail, None
        if release.count():
            payload = [*MATCH_FIELDS, "_tail"]
            if self.k:
                with_next = next_rows(seq, ("ts_ms", "id"), self.k, payload, self.partition, prefix="_n").persist()
                # rows with fewer than k successors (per endpoint in that scope)
                new_tail = with_next.where(F.col(f"_n{self.k}").isNull()).select(*CARRY_FIELDS)
            else:
                with_next = seq.persist()
                new_tail = with_next.where(F.lit(False)).select(*CARRY_FIELDS)
            current = F.struct(*[F.col(c) for c in payload])
            structs = [current] + [F.col(f"_n{i}") for i in range(1, self.k + 1)]

            def last_step_is_new(m: int):
                return F.coalesce(~structs[m - 1]["_tail"], F.lit(False))

            if self.rules:
                hits = F.array(
                    *[F.when(last_step_is_new(len(r.steps)), _rule_hit(r, structs)) for r in self.rules]
                )
                det = (
                    with_next.select(F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("d"))
                    .select("d.*")
                    .withColumn("date", F.to_date("timestamp"))
                    .select(*DETECTION_COLUMNS)
                )
                write_batch(det, self.detections, "detections", batch_id, self.writer)
            released = max(released, wm)
        live_tail = new_tail.where(F.col("ts_ms") > F.lit(wm - self.within_ms))
        state = hold.withColumn("kind", F.lit("pending")).unionByName(live_tail.withColumn("kind", F.lit("tail")))
        state.write.mode("overwrite").parquet(self._of(self.state, batch_id))
        meta = spark.createDataFrame([(int(max_seen), int(released))], META_DDL)
        meta.write.mode("overwrite").parquet(self._of(self.meta, batch_id))
        if with_next is not None:
            with_next.unpersist()
        for path in (self.state, self.meta):  # a replay needs the batch before, nothing older
            if batch_id > 1:
                delete_path(spark, self._of(path, batch_id - 2))

    def read_detections(self, spark: SparkSession) -> DataFrame:
        return table_store(spark, self.detections, "detections").read().select(*DETECTION_COLUMNS)


def start_global_rules(
    events: DataFrame,
    root: str,
    registry: RuleRegistry | list[Rule] | None = None,
    delay_ms: int = 5000,
    trigger: dict | None = None,
    scope: str = "global",
) -> tuple[StreamingQuery, GlobalRuleBatches]:
    """Start rule matching over a stream of normalised events, one distributed pass
    per micro-batch (``scope`` "global" or "endpoint")."""
    handler = GlobalRuleBatches(root, registry, delay_ms, scope)
    q = (
        events.writeStream.foreachBatch(handler)
        .option("checkpointLocation", os.path.join(root, "_checkpoints", f"{scope}_rules"))
        .trigger(**(trigger or {"processingTime": "10 seconds"}))
        .start()
    )
    return q, handler
