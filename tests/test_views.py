import csv
import glob
import json

from pyspark.sql import functions as F

from conftest import SF_SMALL
from helpers import ev, events_df, ts
from tracehound.operators import filters as FL
from tracehound.operators import joins as J
from tracehound.operators import lifecycle as L
from tracehound.operators import setops as U
from tracehound.operators import sorting as S
from tracehound.operators import views as V
from tracehound.operators.rules import apply_rules
from tracehound.sources.fixture import fixture_endpoints, load_fixture_events
from tracehound.sources.sinks import detections_json, export_csv
from tracehound.streaming import rollups as RU


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_incremental_rollups_equal_full_views(spark):
    ev_all = load_fixture_events(spark, SF_SMALL)
    det = apply_rules(ev_all)
    # three "micro-batches" split by event id
    parts = [ev_all.where(F.abs(F.hash("id")) % 3 == i) for i in range(3)]
    er = RU.merge_event_rollup(parts[0].transform(RU.event_rollup)
                               .unionByName(parts[1].transform(RU.event_rollup))
                               .unionByName(parts[2].transform(RU.event_rollup)))
    dr = RU.merge_detection_rollup(det.transform(RU.detection_rollup))
    inc = RU.views_from_rollups(er, dr)
    full = {
        "detection_summary": V.detection_summary(det),
        "endpoint_detections": V.endpoint_detections(det),
        "endpoint_events": V.endpoint_events(ev_all),
        "user_events": V.user_events(ev_all),
        "user_detections": V.user_detections(det, ev_all),
        "endpoint_details": V.endpoint_details_view(ev_all),
        "user_details": V.user_details_view(ev_all),
    }
    for name, want in full.items():
        got = inc[name].select(*want.columns)
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0, name


def test_smallest_distinct_bounded_and_sorted(spark):
    df = spark.createDataFrame([("k", f"v{i:03d}") for i in range(500)] + [("j", "b"), ("j", "a"), ("j", "a")], "key string, v string")
    out = {r.key: r.v for r in V.smallest_distinct(df, "key", "v", 10, salts=7).collect()}
    assert out["k"] == [f"v{i:03d}" for i in range(10)]
    assert out["j"] == ["a", "b"]


def test_latest_by_key_and_merge_live(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, ver int, val string")
    assert rows(V.latest_by_key(df, "k", "ver"), "k", "val") == [("a", "y"), ("b", "z")]
    held = spark.createDataFrame([("1", "held")], "id string, v string")
    new = spark.createDataFrame([("1", "new"), ("2", "new")], "id string, v string")
    assert rows(U.merge_live(new, held), "id", "v") == [("1", "held"), ("2", "new")]


def test_recent_hours_keeps_exact_cutoff(spark):
    df = spark.createDataFrame([(1, "2024-01-02 12:00:00"), (2, "2024-01-02 11:59:59.999")], "n int, t string")
    df = df.withColumn("last_seen", F.to_timestamp("t"))
    assert [r.n for r in FL.recent_hours(df, "2024-01-03 12:00:00", 24).collect()] == [1]


def test_retention_last_day(spark):
    df = spark.createDataFrame([(1, "2024-01-02"), (2, "2024-01-01")], "n int, d string").withColumn("date", F.to_date("d"))
    # 2024-01-02 + 90 days = 2024-04-01: kept at midnight, gone later that day
    assert [r.n for r in L.apply_retention(df, 90, "2024-04-01 00:00:00").collect()] == [1]
    assert L.apply_retention(df, 90, "2024-04-01 00:00:01").count() == 0


def test_search_mixed_case_and_sort_nulls_last(spark):
    df = spark.createDataFrame([("Endpoint-A", "Bob"), ("x", None), ("y", "alice")], "endpoint_id string, user string")
    assert rows(FL.search_rows(df, "ENDPOINT-a", ["endpoint_id", "user"]), "endpoint_id") == [("Endpoint-A",)]
    assert rows(FL.search_rows(df, "", ["user"]), "endpoint_id") == [("Endpoint-A",), ("x",), ("y",)]
    asc = [r.user for r in S.sort_nulls_last(df, "user", True).collect()]
    desc = [r.user for r in S.sort_nulls_last(df, "user", False).collect()]
    assert asc == ["alice", "Bob", None] and desc == ["Bob", "alice", None]


def test_attach_events_edges(spark):
    events = events_df(spark, [ev("a", 2), ev("b", 1), ev("c", 3)])
    det = spark.createDataFrame(
        [("d1", "a,b"), ("d2", ""), ("d3", "zz,c"), ("d4", "a,a")], "id string, event_ids string")
    out = {r.id: [e.id for e in r.events] for r in J.attach_events(det, events).collect()}
    assert out == {"d1": ["b", "a"], "d2": [], "d3": ["c"], "d4": ["a"]}


def test_filters_ignore_falsy_and_offset_past_end(spark):
    det = spark.createDataFrame([("x", 3, "R"), ("y", 4, "R")], "id string, severity int, rule_id string")
    assert FL.filter_detections(det, severity=0, rule_id="").count() == 2
    assert FL.filter_detections(det, severity=4).count() == 1
    events = events_df(spark, [ev("a", 1), ev("b", 2)])
    assert S.page(events, S.newest_first(), limit=10, offset=5).count() == 0
    assert FL.filter_events(events, from_=ts(2), to=ts(2)).count() == 1


def test_hostnames_default_unknown(spark):
    df = spark.createDataFrame([("endpoint-1",), ("endpoint-9",)], "endpoint_id string")
    got = dict(rows(J.add_hostnames(df, fixture_endpoints(spark)), "endpoint_id", "hostname"))
    assert got == {"endpoint-1": "host-1", "endpoint-9": "Unknown"}


def test_table_health_states(spark):
    one = spark.range(3)
    empty = spark.range(0)
    out = {r.table: (r.rows, r.state) for r in V.table_health({"a": one, "b": empty, "c": None}).collect()}
    assert out == {"a": (3, "OK"), "b": (0, "EMPTY"), "c": (None, "MISSING")}


def test_publish_json_and_csv_export(spark, scratch):
    events = events_df(spark, [ev("a", 0), ev("b", 1), ev("c", 2)])
    det = apply_rules(events)
    payload = json.loads(detections_json(det).collect()[0].value)
    assert set(payload) == {"id", "timestamp", "ruleId", "severity", "endpointId", "description", "eventIds"}
    assert payload["eventIds"] == "a,b,c" and payload["timestamp"] == 1704067200002
    export_csv(J.attach_events(det, events), f"{scratch}/csv", single_file=True)
    [path] = glob.glob(f"{scratch}/csv/*.csv")
    with open(path) as fh:
        recs = list(csv.DictReader(fh))
    assert recs[0]["event_ids"] == "a,b,c" and recs[0]["rule_id"] == "RULE-001"
    assert json.loads(recs[0]["events"])[0]["id"] == "a"


def test_truncate_keeps_schema(spark, scratch):
    events = events_df(spark, [ev("a", 0), ev("b", 1)])
    path = f"{scratch}/t"
    events.write.parquet(path)
    L.truncate_tables(spark, [(path, spark.read.parquet(path))])
    out = spark.read.parquet(path)
    assert out.count() == 0 and out.schema == events.schema
