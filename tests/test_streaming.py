import glob
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tracehound.functions.parse import normalize_events, parse_events
from tracehound.operators.rules import apply_rules
from tracehound.sources.events import read_raw_events
from tracehound.sources.fixture import load_fixture_events
from tracehound.streaming import pipeline as P
from tracehound.streaming import rollups as RU
from tracehound.streaming.ordering import stream_rules

ONCE = {"availableNow": True}
FLUSH = '{"id":"flush","timestamp":1800000000000,"event_type":"flush","endpoint_id":"flush"}\n'


def wire(ev):
    return ev.select(
        F.to_json(F.struct("id", F.unix_millis("timestamp").alias("timestamp"), "endpoint_id", "event_type",
                           "status", "direction", "bytes", "source_ip", "destination_ip", "process_name",
                           "user")).alias("value"),
        F.unix_millis("timestamp").alias("ms"),
    )


def _stamp(path, order):
    # the file source takes new files in modification-time order
    os.utime(path, (1_700_000_000 + order, 1_700_000_000 + order))


def write_chunks(ev, folder, n=3, start=0):
    """Time-ordered JSON-lines files, one per chunk (file i = micro-batch i)."""
    os.makedirs(folder, exist_ok=True)
    rows = sorted((r.ms, r.value) for r in wire(ev).collect())
    size = -(-len(rows) // n)
    for i in range(n):
        path = os.path.join(folder, f"{start + i:04d}.json")
        with open(path, "w") as fh:
            fh.writelines(v + "\n" for _, v in rows[i * size:(i + 1) * size])
        _stamp(path, start + i)


def flush(folder, name="9999.json"):
    path = os.path.join(folder, name)
    with open(path, "w") as fh:
        fh.write(FLUSH)
    _stamp(path, 9999)


def run_stream_rules(spark, src, ckpt, scope, name):
    raw = read_raw_events(spark, src, maxFilesPerTrigger=1)
    det = stream_rules(normalize_events(parse_events(raw)), scope=scope)
    q = (det.writeStream.format("memory").queryName(name).option("checkpointLocation", ckpt)
         .trigger(**ONCE).start())
    q.awaitTermination(600)
    return spark.table(name)


@pytest.mark.parametrize("scope", ["endpoint", "global"])
def test_stream_equals_batch(spark, scratch, scope):
    ev = load_fixture_events(spark, SF_SMALL)
    write_chunks(ev, f"{scratch}/src", 3)
    flush(f"{scratch}/src")
    got = run_stream_rules(spark, f"{scratch}/src", f"{scratch}/ckpt", scope, f"s_{scope}")
    want = apply_rules(ev, scope=scope)
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_late_event_stored_not_matched(spark, scratch):
    src = f"{scratch}/src"
    os.makedirs(src)
    base = 1704067200000
    fails = [{"id": f"f{i}", "timestamp": base + 100_000 + i, "event_type": "login", "status": "failed",
              "endpoint_id": "e1", "user": "u"} for i in range(3)]
    with open(f"{src}/0000.json", "w") as fh:
        fh.write("\n".join(json.dumps(f) for f in fails) + "\n")
    _stamp(f"{src}/0000.json", 0)
    # far later event moves the watermark; then three failures far in the past are late
    with open(f"{src}/0001.json", "w") as fh:
        fh.write(json.dumps({"id": "later", "timestamp": base + 3_600_000, "event_type": "dns"}) + "\n")
    _stamp(f"{src}/0001.json", 1)
    late = [{"id": f"l{i}", "timestamp": base + i, "event_type": "login", "status": "failed",
             "endpoint_id": "e1", "user": "u"} for i in range(3)]
    with open(f"{src}/0002.json", "w") as fh:
        fh.write("\n".join(json.dumps(f) for f in late) + "\n")
    _stamp(f"{src}/0002.json", 2)
    flush(src)
    raw = read_raw_events(spark, src, maxFilesPerTrigger=1)
    layout = P.Layout(f"{scratch}/out")
    qs = P.run_pipeline(spark, raw, layout.root, scope="global", trigger=ONCE)
    for q in qs.values():
        q.awaitTermination(600)
    stored = {r.id for r in spark.read.parquet(layout.events).collect()}
    assert {"l0", "l1", "l2", "f0", "later", "flush"} <= stored
    det = spark.read.parquet(layout.detections).collect()
    assert [d.event_ids for d in det] == ["f0,f1,f2"]


def test_restart_from_checkpoint_no_repeats(spark, scratch):
    ev = load_fixture_events(spark, SF_SMALL)
    src = f"{scratch}/src"
    write_chunks(ev, src, 4)
    later = sorted(glob.glob(f"{src}/*.json"))[2:]
    hold = f"{scratch}/hold"
    os.makedirs(hold)
    for p in later:
        os.rename(p, os.path.join(hold, os.path.basename(p)))
    layout = P.Layout(f"{scratch}/out")
    raw = read_raw_events(spark, src, maxFilesPerTrigger=1)
    for q in P.run_pipeline(spark, raw, layout.root, trigger=ONCE).values():
        q.awaitTermination(600)
    first = spark.read.parquet(layout.detections).count()
    for p in glob.glob(f"{hold}/*.json"):
        os.rename(p, os.path.join(src, os.path.basename(p)))
    flush(src)
    raw = read_raw_events(spark, src, maxFilesPerTrigger=1)
    for q in P.run_pipeline(spark, raw, layout.root, trigger=ONCE).values():
        q.awaitTermination(600)
    det = spark.read.parquet(layout.detections).drop("month", "batch")
    want = apply_rules(ev, scope="endpoint")
    assert 0 < first < det.count()
    assert det.count() == det.select("id").distinct().count() == want.count()
    assert det.exceptAll(want).count() == 0
    assert spark.read.parquet(layout.events).count() == ev.count() + 1


def test_pipeline_downstream_queries(spark, scratch):
    ev = load_fixture_events(spark, SF_SMALL)
    src = f"{scratch}/src"
    write_chunks(ev, src, 2)
    with open(f"{src}/0005.json", "w") as fh:
        fh.write("this is not json\n")
    _stamp(f"{src}/0005.json", 5)
    flush(src)
    layout = P.Layout(f"{scratch}/out")
    raw = read_raw_events(spark, src, maxFilesPerTrigger=1)
    for q in P.run_pipeline(spark, raw, layout.root, scope="global", trigger=ONCE).values():
        q.awaitTermination(600)
    # a snapshot taken before any rollup counts all stored rows
    P.refresh_live(spark, layout, as_of="2024-01-03 12:00:00")
    early = spark.read.parquet(layout.snapshots).first()
    for q in [P.start_publisher(spark, layout, trigger=ONCE), *P.start_rollups(spark, layout, trigger=ONCE).values()]:
        q.awaitTermination(600)
    live = P.start_live(spark, layout, refresh="1 second", as_of="2024-01-03 12:00:01")
    try:  # driven by the clock: no event arrives any more
        while spark.read.parquet(layout.snapshots).count() < 2:
            live.exception() and live.awaitTermination()
            time.sleep(1)
    finally:
        live.stop()
    det = spark.read.parquet(layout.detections).drop("month", "batch")
    published = [json.loads(r.value) for r in spark.read.text(layout.published).collect()]
    assert sorted(p["id"] for p in published) == sorted(r.id for r in det.collect())
    views = P.current_views(spark, layout)
    stored = spark.read.parquet(layout.events).drop("month", "batch")
    want = RU.views_from_rollups(RU.event_rollup(stored), RU.detection_rollup(det))
    for name in ("endpoint_events", "user_details", "user_detections"):
        got = views[name]
        assert got.exceptAll(want[name].select(*got.columns)).count() == 0, name
    assert [r.value for r in spark.read.text(layout.quarantine).collect()] == ["this is not json"]
    late = spark.read.parquet(layout.snapshots).orderBy(F.desc("snapshot_timestamp")).first()
    day = "date >= date_sub(DATE'2024-01-03', 1)"
    assert early.total_events == late.total_events == stored.where(day).count() > 20
    assert early.total_detections == late.total_detections == det.where(day).count()
    live = P.live_list(spark, layout.live_events, "events").collect()
    assert len(live) == 20 and max(r.timestamp for r in live) == stored.agg(F.max("timestamp")).first()[0]


def test_global_scope_micro_batches_equal_batch(spark, scratch):
    from tracehound.streaming.global_order import start_global_rules

    ev = load_fixture_events(spark, SF_SMALL)
    src = f"{scratch}/src"
    write_chunks(ev, src, 4)
    flush(src)
    raw = read_raw_events(spark, src, maxFilesPerTrigger=1)
    q, handler = start_global_rules(normalize_events(parse_events(raw)), f"{scratch}/out", trigger=ONCE)
    q.awaitTermination(600)
    got = handler.read_detections(spark)
    want = apply_rules(ev, scope="global")
    assert got.count() == want.count() == 16
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_endpoint_scope_micro_batches_equal_batch(spark, scratch):
    from tracehound.streaming.global_order import start_global_rules

    ev = load_fixture_events(spark, SF_SMALL)
    src = f"{scratch}/src"
    write_chunks(ev, src, 4)
    flush(src)
    raw = read_raw_events(spark, src, maxFilesPerTrigger=1)
    q, handler = start_global_rules(normalize_events(parse_events(raw)), f"{scratch}/out", trigger=ONCE, scope="endpoint")
    q.awaitTermination(600)
    got = handler.read_detections(spark)
    want = apply_rules(ev, scope="endpoint")
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_micro_batches_single_step_rule(spark, scratch):
    from tracehound.operators.rules import Rule, Step
    from tracehound.streaming.global_order import start_global_rules

    dns = Rule(
        rule_id="RULE-910", severity=1, description="DNS event",
        steps=(Step("dns", lambda e, m: e["event_type"] == "dns"),),
        within_ms=1, endpoint_step="dns", message=lambda m: m["dns"]["id"],
    )
    ev = load_fixture_events(spark, SF_SMALL)
    src = f"{scratch}/src"
    write_chunks(ev, src, 2)
    flush(src)
    raw = read_raw_events(spark, src, maxFilesPerTrigger=1)
    q, handler = start_global_rules(normalize_events(parse_events(raw)), f"{scratch}/out", [dns], trigger=ONCE)
    q.awaitTermination(600)
    got = handler.read_detections(spark)
    assert got.count() == ev.where("event_type = 'dns'").count() > 0
    assert got.exceptAll(apply_rules(ev, [dns])).count() == 0


def one_step(rule_id, cond):
    from tracehound.operators.rules import Rule, Step

    return Rule(rule_id=rule_id, severity=1, description="one step", steps=(Step("e", lambda e, m: cond(e)),),
                within_ms=1000, endpoint_step="e", message=lambda m: m["e"]["id"])


def test_replayed_batches_change_nothing(spark, scratch):
    from tracehound.streaming.global_order import GlobalRuleBatches

    ev = load_fixture_events(spark, SF_SMALL)
    end = ev.agg(F.max("timestamp")).first()[0]
    extra = ev.limit(1).withColumn("id", F.lit("flush")).withColumn("timestamp", F.lit(end) + F.expr("INTERVAL 1 DAY")).withColumn("event_type", F.lit("x"))
    handler = GlobalRuleBatches(f"{scratch}/out", scope="global")
    for batch, part in enumerate([ev, extra]):
        for _ in range(2):
            handler(part, batch)
    # cut short before it was done: the rows are written, the marker is not
    from tracehound.session import delete_path

    delete_path(spark, f"{handler.meta}/batch=1")
    handler(extra, 1)
    got = handler.read_detections(spark)
    assert got.count() == got.select("id").distinct().count() == 16


def test_carried_state_is_bounded(spark, scratch):
    from tracehound.streaming.global_order import GlobalRuleBatches

    handler = GlobalRuleBatches(f"{scratch}/out", scope="endpoint")
    rows = spark.range(30).select(
        F.concat(F.lit("d"), "id").alias("id"), F.timestamp_millis(F.lit(1704067200000) + F.col("id") * 86_400_000).alias("timestamp"),
        F.concat(F.lit("endpoint-"), "id").alias("endpoint_id"), F.lit("login").alias("event_type"), F.lit("failed").alias("status"),
        *[F.lit("").alias(c) for c in ("direction", "source_ip", "destination_ip", "process_name", "user")], F.lit(0).cast("long").alias("bytes"),
    ).cache()
    for batch in range(10):
        handler(rows.where(f"substring(id, 2) div 3 = {batch}"), batch)
    state = spark.read.parquet(f"{handler.state}/batch=9")
    assert state.count() <= 2  # the newest event is pending, one more may still be in reach
    assert sorted(os.path.basename(p) for p in glob.glob(f"{handler.state}/batch=*")) == ["batch=8", "batch=9"]


def test_empty_registry_and_missing_state(spark, scratch):
    from pyspark.errors import AnalysisException

    from tracehound.operators.rules import RuleRegistry
    from tracehound.streaming.global_order import GlobalRuleBatches

    ev = load_fixture_events(spark, SF_SMALL)
    for registry in ([], RuleRegistry()):
        handler = GlobalRuleBatches(f"{scratch}/none{type(registry).__name__}", registry)
        handler(ev, 0)
        assert handler.read_detections(spark).count() == 0
    with pytest.raises(AnalysisException):  # lost state is an error, not an empty start
        GlobalRuleBatches(f"{scratch}/lost")(ev, 5)


def test_rules_see_every_field_and_choose_citations(spark, scratch):
    from tracehound.operators.rules import FAILED_LOGINS
    from tracehound.streaming.global_order import GlobalRuleBatches

    ev = load_fixture_events(spark, SF_SMALL)
    big = one_step("RULE-911", lambda e: (e["bytes"] > 5000) & (e["source_ip"] == "") & (e["destination_ip"] == ""))
    want = ev.where("bytes > 5000").count()
    assert apply_rules(ev, [big]).count() == want > 0
    handler = GlobalRuleBatches(f"{scratch}/out", [big], delay_ms=0)
    handler(ev, 0)
    assert handler.read_detections(spark).count() == want
    cited = {r.event_ids.count(",") for r in apply_rules(ev, [FAILED_LOGINS.citing("first", "third")]).collect()}
    assert cited == {1}
    with pytest.raises(ValueError):
        FAILED_LOGINS.citing("nobody")


def test_rollups_are_folded(spark, scratch):
    ev = load_fixture_events(spark, SF_SMALL)
    path = f"{scratch}/rollup"
    parts = ev.randomSplit([1.0] * 5, seed=3)
    for batch, part in enumerate(parts):
        RU.write_partial(RU.event_rollup(part), path, batch)
        RU.compact_rollup(spark, path, batch, every=2)
        assert not RU.write_partial(RU.event_rollup(part), path, batch)  # handled again
    assert len(RU.rollup_store(spark, path).state()["live"]) == 1
    got, want = RU.read_rollup(spark, path), RU.merge_event_rollup(RU.event_rollup(ev))
    assert got.exceptAll(want.select(*got.columns)).count() == 0 and got.count() == want.count()
    assert RU.read_rollup(spark, f"{scratch}/none").count() == 0
