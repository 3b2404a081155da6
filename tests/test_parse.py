import json

from pyspark.sql import functions as F

from tracehound.functions.parse import normalize_events, parse_events, parse_events_with_quarantine, with_month
from tracehound.sources.events import read_event_file, read_raw_events


def parse(spark, texts, default_ts=123):
    raw = spark.createDataFrame([(t,) for t in texts], "value string")
    good, bad = parse_events_with_quarantine(raw, default_ts_ms=F.lit(default_ts).cast("bigint"))
    return good.collect(), [r.value for r in bad.collect()]


def test_text_coercion(spark):
    rows, bad = parse(spark, ['{"id":"a","user":null}', '{"id":"b","status":5}', '{"id":"c","direction":{"x":1}}'])
    got = {r.id: r for r in rows}
    assert got["a"].user == "null"
    assert got["b"].status == "5"
    assert got["c"].direction == ""
    assert got["a"].endpoint_id == "" and bad == []


def test_long_coercion(spark):
    rows, _ = parse(spark, ['{"id":"a","bytes":"42"}', '{"id":"b","bytes":12.7}', '{"id":"c","bytes":"zz"}', '{"id":"d"}'])
    assert {r.id: r.bytes for r in rows} == {"a": 42, "b": 12, "c": 0, "d": 0}


def test_timestamp_text_and_default(spark):
    rows, _ = parse(spark, ['{"id":"a","timestamp":"1700000000123"}', '{"id":"b"}'], default_ts=5)
    got = {r.id: r.timestamp for r in rows}
    assert int(got["a"].timestamp() * 1000) == 1700000000123
    assert int(got["b"].timestamp() * 1000) == 5


def test_malformed_goes_to_quarantine_and_array_gets_defaults(spark):
    rows, bad = parse(spark, ["not json", "[1,2]", ""])
    assert "not json" in bad
    assert len(rows) == 1
    r = rows[0]
    assert r.id.startswith("gen-") and r.user == "" and r.bytes == 0


def test_missing_id_is_deterministic(spark):
    a, _ = parse(spark, ['{"user":"x"}'])
    b, _ = parse(spark, ['{"user":"x"}'])
    assert a[0].id == b[0].id


def test_normalise_lowercases_four_fields_only(spark):
    rows, _ = parse(spark, ['{"id":"A","event_type":"LOGIN","status":"Failed","direction":"OUT","process_name":"CMD.EXE","user":"Bob","endpoint_id":"EP-1"}'])
    raw = spark.createDataFrame([rows[0]])
    n = normalize_events(raw).collect()[0]
    assert (n.event_type, n.status, n.direction, n.process_name) == ("login", "failed", "out", "cmd.exe")
    assert (n.id, n.user, n.endpoint_id) == ("A", "Bob", "EP-1")


def test_month_key(spark):
    rows, _ = parse(spark, ['{"id":"a","timestamp":1706745600000}'])  # 2024-02-01
    m = with_month(spark.createDataFrame(rows)).collect()[0]
    assert m.month == 202402 and str(m.date) == "2024-02-01"


def test_event_file_pretty_array(spark, scratch):
    events = [
        {"id": "a", "timestamp": 1704067200000, "endpoint_id": "endpoint-1", "event_type": "login",
         "status": "failed", "bytes": 0, "user": "alice"},
        {"id": "b", "timestamp": 1704067200100, "bytes": "17", "user": None},
    ]
    with open(f"{scratch}/events.json", "w") as fh:
        json.dump(events, fh, indent=2)
    got = {r.id: r for r in read_event_file(spark, f"{scratch}/events.json").collect()}
    assert set(got) == {"a", "b"}
    assert got["a"].user == "alice" and got["b"].bytes == 17 and got["b"].user == "null"


def test_raw_text_source_batch(spark, scratch):
    with open(f"{scratch}/m.txt", "w") as fh:
        fh.write('{"id":"a","timestamp":1}\n{"id":"b","timestamp":2}\n')
    raw = read_raw_events(spark, f"{scratch}/m.txt", stream=False)
    assert sorted(r.id for r in parse_events(raw).collect()) == ["a", "b"]


def test_fast_and_variant_paths_agree(spark):
    texts = [
        '{"id":"a","timestamp":5,"endpoint_id":"e","event_type":"t","status":"s","direction":"d","bytes":3,'
        '"source_ip":"1","destination_ip":"2","process_name":"p","user":"u"}',
        '{"id":"b","timestamp":5,"endpoint_id":"{x","event_type":"t","status":"s","direction":"d","bytes":3,'
        '"source_ip":"1","destination_ip":"2","process_name":"[p","user":"u"}',
        '{"id":"c","timestamp":"7","endpoint_id":"e","event_type":"t","status":"s","direction":"d","bytes":3.9,'
        '"source_ip":"1","destination_ip":"2","process_name":"p","user":null}',
    ]
    raw = spark.createDataFrame([(t,) for t in texts], "value string")
    fast = {r.id: r for r in parse_events(raw).collect()}
    from tracehound.functions.parse import parse_variant_events
    slow = {r.id: r for r in parse_variant_events(raw.select(F.parse_json("value").alias("value"))).collect()}
    for k in "abc":
        assert fast[k].asDict() == slow[k].asDict() | {"id": k}
    assert fast["b"].endpoint_id == "{x" and fast["c"].bytes == 3 and fast["c"].user == "null"
