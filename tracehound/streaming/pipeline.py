"""The stream job (S1, S3-S5, S8, T1-T7, M3, M5): raw messages -> stored events,
detections, published alerts, incremental views, live feeds and dashboard snapshots.

Queries (each with its own checkpoint under ``root/_checkpoints``):

``job``         one query over the raw messages: each micro-batch is parsed once and feeds the
                events table, the quarantine folder and the rules, which write the
                detections table.  A batch handled again changes nothing.
                Late events are stored too; only matching drops them.
``publish``     follows the detections table -> JSON text (``ruleId`` etc.) -> topic
                (at least once; consumers dedupe by ``id``) or one folder a batch.
``rollups``     follow the stored tables: a rollup of each appended row, once -> summary views.
``live``        every ``refresh``, with or without new events: newest 20 events and
                detections, and one dashboard snapshot row in the snapshot table.

Tables are stores (``sources.store``): what a query follows are the rows that a writer appended,
each once, whatever folding and compaction do meanwhile.  With ``impl="state"`` the rules are the
keyed ordering buffer instead, and events, quarantine and detections are three queries.
"""

from __future__ import annotations

import datetime as dt
import os
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.parse import normalize_events, parse_staged, parse_events_with_quarantine, stage, with_month
from ..operators.rules import RuleRegistry
from ..operators.sorting import latest
from ..plans.dashboard import dashboard_snapshot
from ..schema import DETECTIONS, EVENTS
from ..session import configure, delete_path, list_children, path_exists
from ..sources.sinks import publish_detections, table_store, write_batch, write_detections, write_events
from ..sources.store import Store
from . import rollups as RU
from .global_order import GlobalRuleBatches
from .ordering import stream_rules


SNAPSHOT_DAYS = 30
KEEP_LIVE_NS = 60 * 10**9  # replaced live lists stay this long for readers that still have them open


@dataclass(frozen=True)
class Layout:
    """Folder layout of one deployment under a shared root."""

    root: str

    def path(self, name: str) -> str:
        return os.path.join(self.root, name)

    @property
    def events(self):
        return self.path("events")

    @property
    def detections(self):
        return self.path("detections")

    @property
    def quarantine(self):
        return self.path("quarantine")

    @property
    def published(self):
        return self.path("published")

    @property
    def event_rollup(self):
        return self.path("rollup_events")

    @property
    def detection_rollup(self):
        return self.path("rollup_detections")

    @property
    def live_events(self):
        return self.path("live_events")

    @property
    def live_detections(self):
        return self.path("live_detections")

    @property
    def snapshots(self):
        return self.path("dashboard_snapshots")

    def checkpoint(self, query: str) -> str:
        return os.path.join(self.root, "_checkpoints", query)


def normalized_stream(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parse + normalise a raw ``value`` stream; returns (events, quarantined text)."""
    parsed, bad = parse_events_with_quarantine(raw)
    return normalize_events(parsed), bad


def start_event_store(raw: DataFrame, layout: Layout, trigger: dict | None = None) -> dict[str, StreamingQuery]:
    events, bad = normalized_stream(raw)
    q_events = write_events(events, layout.events, layout.checkpoint("events"), trigger)
    q_bad = (
        bad.select("value")
        .writeStream.format("text")
        .option("path", layout.quarantine)
        .option("checkpointLocation", layout.checkpoint("quarantine"))
        .trigger(**(trigger or {"processingTime": "200 milliseconds"}))
        .start()
    )
    return {"events": q_events, "quarantine": q_bad}


class Job:
    """``foreachBatch`` handler of the whole job: one parse feeds store, quarantine and rules."""

    def __init__(self, layout: Layout, rules: GlobalRuleBatches):
        self.layout, self.rules = layout, rules

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if self.rules.done(batch.sparkSession, batch_id):
            return
        staged = stage(batch.select("value")).persist()
        try:
            good, bad = parse_staged(staged)
            events = normalize_events(good)
            write_batch(events, self.layout.events, "events", batch_id, "job")
            bad.select("value").write.mode("overwrite").text(os.path.join(self.layout.quarantine, f"batch={int(batch_id)}"))
            self.rules(events, batch_id)
        finally:
            staged.unpersist()


def start_job(
    raw: DataFrame, layout: Layout, registry: RuleRegistry | None = None, scope: str = "endpoint",
    trigger: dict | None = None, delay: str = "5 seconds",
) -> tuple[StreamingQuery, Job]:
    """Store, quarantine and rules as one query over the raw messages."""
    job = Job(layout, GlobalRuleBatches(layout.root, registry, _duration_ms(delay), scope, layout.detections))
    query = (
        raw.writeStream.foreachBatch(job)
        .option("checkpointLocation", layout.checkpoint("job"))
        .trigger(**(trigger or {"processingTime": "10 seconds"}))
        .start()
    )
    return query, job


def start_keyed_rules(
    raw: DataFrame, layout: Layout, registry: RuleRegistry | None = None, scope: str = "endpoint",
    trigger: dict | None = None, delay: str = "5 seconds",
) -> StreamingQuery:
    """Rule matching by the keyed ordering buffer (``transformWithStateInPandas``), keyed by
    endpoint, or by one key for the global scope."""
    events, _ = normalized_stream(raw)
    det = stream_rules(events, registry, scope, delay)
    return write_detections(det, layout.detections, layout.checkpoint("detections"), trigger)


def _duration_ms(text: str) -> int:
    """'5 seconds' / '500 milliseconds' / '1 minute' -> milliseconds."""
    amount, unit = text.split()
    scale = {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000}[unit.rstrip("s")]
    return int(float(amount) * scale)


def create_tables(spark: SparkSession, layout: Layout) -> None:
    """Empty stored tables, unless there are some."""
    table_store(spark, layout.events, "events").create()
    table_store(spark, layout.detections, "detections").create()


def start_publisher(spark: SparkSession, layout: Layout, fmt: str = "text", trigger: dict | None = None, **options) -> StreamingQuery:
    """Publish every stored detection.  Text goes to one folder a batch, which a replay replaces."""

    def publish(det: DataFrame, batch_id: int) -> None:
        if fmt == "text":
            publish_detections(det, fmt, path=os.path.join(layout.published, f"batch={int(batch_id)}"), mode="overwrite", **options)
        else:
            publish_detections(det, fmt, **options)

    return table_store(spark, layout.detections, "detections").follow(publish, layout.checkpoint("publish"), trigger or {"processingTime": "200 milliseconds"})


def start_rollups(spark: SparkSession, layout: Layout, trigger: dict | None = None) -> dict[str, StreamingQuery]:
    """M3: rollups of the stored events and detections, each row counted once."""
    kinds = {
        "events": (layout.events, layout.event_rollup, RU.event_rollup),
        "detections": (layout.detections, layout.detection_rollup, RU.detection_rollup),
    }

    def start(kind: str) -> StreamingQuery:
        table, rollup, build = kinds[kind]

        def handle(rows: DataFrame, batch_id: int) -> None:
            RU.write_partial(build(rows), rollup, batch_id, kind)
            RU.compact_rollup(spark, rollup, batch_id, kind)

        return table_store(spark, table, kind).follow(handle, layout.checkpoint(f"rollup_{kind}"), trigger or {"processingTime": "1 second"})

    return {f"rollup_{kind}": start(kind) for kind in kinds}


def current_views(spark: SparkSession, layout: Layout) -> dict[str, DataFrame]:
    """Summary views from the stored rollups (empty views before the first batch)."""
    er = RU.read_rollup(spark, layout.event_rollup, "events")
    dr = RU.read_rollup(spark, layout.detection_rollup, "detections")
    return RU.views_from_rollups(er, dr)


def stored(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A stored table, empty before anything is stored."""
    return table_store(spark, path, table).read()


def live_list(spark: SparkSession, path: str, table: str) -> DataFrame:
    """The last complete live list: each refresh is an ``at=<number>`` partition of its own, so a
    reader never meets one that is being replaced."""
    schema = EVENTS if table == "events" else DETECTIONS
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("at", T.LongType())])).parquet(path)
    last = rows.agg(F.max("at")).first()[0]
    return rows.where(F.col("at") == F.lit(last)).select(*schema.fieldNames())


def _newest(spark: SparkSession, path: str, table: str, held_path: str, n: int) -> DataFrame:
    """The newest ``n`` rows of a stored table, kept at ``held_path``.

    Months are read from the last one back until ``n`` rows are found; once ``n`` rows are held,
    rows before the oldest held one are left out as well.  At most ``n`` rows pass the driver."""
    store = table_store(spark, path, table)
    held = live_list(spark, held_path, table).agg(F.count("*").alias("n"), F.min("timestamp").alias("t")).first()
    rows = store.newest(n, lambda df: df, F.col("timestamp") >= F.lit(held["t"]) if held["n"] >= n else None)
    schema = store.schema
    top = spark.createDataFrame(latest(rows.select(*schema.fieldNames()), n).collect(), schema)
    now = time.time_ns()
    top.coalesce(1).withColumn("at", F.lit(now)).write.mode("append").partitionBy("at").parquet(held_path)
    for old in list_children(spark, held_path, "at="):
        if int(old.rpartition("=")[2]) < now - KEEP_LIVE_NS:
            delete_path(spark, old)
    return top


def refresh_live(spark: SparkSession, layout: Layout, n: int = 20, as_of: str | None = None, keep_days: int = SNAPSHOT_DAYS) -> None:
    """One refresh of the live lists and one dashboard snapshot, from the stored tables; snapshots
    older than ``keep_days`` go.

    Views come from the rollups; before the first rollup they are derived from the tables."""
    configure(spark)
    recent = _newest(spark, layout.events, "events", layout.live_events, n)
    alerts = _newest(spark, layout.detections, "detections", layout.live_detections, n)
    if RU.rollup_store(spark, layout.event_rollup, "events").exists():
        views = current_views(spark, layout)
    else:
        views = RU.views_from_rollups(
            RU.event_rollup(stored(spark, layout.events, "events")),
            RU.detection_rollup(stored(spark, layout.detections, "detections")),
        )
    snap = dashboard_snapshot(recent, alerts, as_of or F.current_timestamp(), views)
    snap.coalesce(1).write.mode("append").partitionBy("snapshot_date").parquet(layout.snapshots)
    prune_snapshots(spark, layout, keep_days)


def _snapshot_days(spark: SparkSession, layout: Layout) -> list[tuple[dt.date, str]]:
    found = ((p.rpartition("=")[2], p) for p in list_children(spark, layout.snapshots, "snapshot_date="))
    return sorted((dt.date.fromisoformat(day), p) for day, p in found)


def prune_snapshots(spark: SparkSession, layout: Layout, keep_days: int) -> list[dt.date]:
    """Remove the folders of snapshot days more than ``keep_days`` before the newest one; returns those days."""
    days = _snapshot_days(spark, layout)
    old = [(day, p) for day, p in days if day <= days[-1][0] - dt.timedelta(days=keep_days)]
    for _, path in old:
        delete_path(spark, path)
    return [day for day, _ in old]


def newest_snapshot(spark: SparkSession, layout: Layout) -> DataFrame:
    """M5 / Q5: the newest snapshot row; only the newest day is read (no rows before the first snapshot)."""
    days = _snapshot_days(spark, layout)
    if not days:
        empty = {t: spark.createDataFrame([], k) for t, k in (("events", EVENTS), ("detections", DETECTIONS))}
        return dashboard_snapshot(empty["events"], empty["detections"], F.current_timestamp()).limit(0)
    rows = spark.read.option("basePath", layout.snapshots).parquet(days[-1][1])
    return rows.orderBy(F.col("snapshot_timestamp").desc()).limit(1)


def start_live(
    spark: SparkSession, layout: Layout, refresh: str = "5 seconds", n: int = 20, as_of: str | None = None,
) -> StreamingQuery:
    """Refresh by the clock, whether or not events arrive."""
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load()
    return (
        clock.writeStream.foreachBatch(lambda _, __: refresh_live(spark, layout, n, as_of))
        .option("checkpointLocation", layout.checkpoint("live"))
        .trigger(processingTime=refresh).start()
    )


def run_pipeline(
    spark: SparkSession,
    raw: DataFrame,
    root: str,
    registry: RuleRegistry | None = None,
    scope: str = "endpoint",
    trigger: dict | None = None,
    impl: str = "micro_batch",
) -> dict[str, StreamingQuery]:
    """Start the job over ``raw`` (a streaming ``value`` frame).

    Downstream queries (publisher, rollups, live) read the stored tables; start them
    with :func:`start_publisher`, :func:`start_rollups` and :func:`start_live`.
    """
    configure(spark)
    layout = Layout(root)
    create_tables(spark, layout)
    if impl == "micro_batch":
        return {"job": start_job(raw, layout, registry, scope, trigger)[0]}
    return {**start_event_store(raw, layout, trigger), "detections": start_keyed_rules(raw, layout, registry, scope, trigger)}


__all__ = [
    "Layout",
    "run_pipeline",
    "start_event_store",
    "start_job",
    "start_keyed_rules",
    "refresh_live",
    "live_list",
    "start_publisher",
    "newest_snapshot",
    "prune_snapshots",
    "start_rollups",
    "start_live",
    "current_views",
    "with_month",
]
