"""Stored tables: one state at a time, batches once, rewrites beside writers and followers."""

import glob
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helpers import ev, events_df
from tracehound.operators import joins as J
from tracehound.operators import rollups as RU
from tracehound.operators import sorting as S
from tracehound.operators.ordinal import Key
from tracehound.operators.watchlist import candidates, matching_names, on_watch_list
from tracehound.plans import requests as R
from tracehound.session import create_text, read_text
from tracehound.sources.sinks import table_store, write_table
from tracehound.sources.store import Store

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("x", T.StringType())])
ONCE = {"availableNow": True}


def rows(spark, a, b, x="a"):
    return spark.range(a, b).withColumn("x", F.lit(x)).withColumn("month", (F.lit(202401) + F.col("id") % 2).cast("int"))


def ids(df):
    return sorted(r.id for r in df.collect())


def test_files_are_created_once(spark, scratch):
    path = f"{scratch}/a/0.json"
    assert create_text(spark, path, "é1") and not create_text(spark, path, "2")
    assert read_text(spark, path) == "é1"


def test_batches_are_stored_once(spark, scratch):
    store = Store(spark, f"{scratch}/t", SCHEMA, sort=["id"])
    assert store.read().count() == 0 and not store.exists()
    assert store.append(rows(spark, 0, 10), 0, "a") and not store.append(rows(spark, 0, 10), 0, "a")
    assert store.append(rows(spark, 10, 12), 0, "b") and store.append(rows(spark, 12, 14))
    assert store.append(rows(spark, 0, 0), 1, "a") and not store.append(rows(spark, 5, 6), 1, "a")  # an empty batch is done, too
    assert ids(store.read()) == list(range(14)) and store.months_live() == [202401, 202402]
    # a folder of an attempt that was never named is no part of the table, and goes in time
    store._write(rows(spark, 90, 95), "a-7-dead", 0)
    assert ids(store.read()) == list(range(14))
    store.vacuum(keep_ms=-60_000)
    assert not glob.glob(f"{scratch}/t/batch=a-7-dead") and ids(store.read()) == list(range(14))


def test_rewrites_beside_writers_and_followers(spark, scratch):
    store = Store(spark, f"{scratch}/t", SCHEMA, sort=["id"]).create()
    seen = []

    def follow():
        store.follow(lambda df, i: seen.extend(ids(df)), f"{scratch}/ck", ONCE).awaitTermination()

    for batch in range(6):
        store.append(rows(spark, 10 * batch, 10 * batch + 10), batch, "w")
        if batch == 2:
            follow()
        if batch % 2:
            held = store.read()  # a reader that opened the table before
            assert store.rewrite([202401], lambda df: df.where("id % 10 <> 0"), "compact")
            assert held.count() == 10 * (batch + 1) - (batch - 1)
    follow()
    assert sorted(seen) == list(range(60))
    assert ids(store.read()) == [i for i in range(60) if i % 10]

    def racing(df):
        store.rewrite([202402], lambda other: other)  # somebody else is first
        return df

    assert not store.rewrite([202402], racing) and ids(store.read()) == [i for i in range(60) if i % 10]

    def meanwhile(df):
        store.append(rows(spark, 100, 102))
        return df

    assert store.rewrite([202401], meanwhile) and ids(store.read())[-2:] == [100, 101]
    assert store.drop_months(202402) == [202401] and set(ids(store.read().where("id % 2 = 0"))) == set()
    store.truncate()
    assert store.read().count() == 0
    assert store.append(rows(spark, 1, 3)) and ids(store.read()) == [1, 2]


def test_small_folders_are_folded_in_levels(spark, scratch):
    store = Store(spark, f"{scratch}/t", SCHEMA, sort=["id"])
    for batch in range(9):
        store.append(rows(spark, batch, batch + 1).withColumn("month", F.lit(202401)), batch, "w")
        store.fold(at=3)
        assert len(store.state()["live"]) <= 4 and ids(store.read()) == list(range(batch + 1))
    assert [e[2] for e in store.state()["live"]] == [2]  # each row was written three times


def test_pruned_scans_of_a_stored_table(spark, scratch):
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    path = f"{scratch}/events"
    rows_ = [ev(f"x{i:03d}", i * 86_400_000 * 3) for i in range(200)]  # 20 months
    write_table(events_df(spark, rows_), path, "events")
    store = table_store(spark, path, "events")
    newest = R.newest_stored(store, 20)
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryFileIndex(2 paths)" in plan or "InMemoryFileIndex(3 paths)" in plan
    assert [r.id for r in newest.collect()] == [f"x{i:03d}" for i in range(199, 179, -1)]
    assert R.newest_stored(store, 500).count() == 200
    assert [r.id for r in R.newest_stored(store, 1, F.col("id") == "x003").collect()] == ["x003"]
    # events of a page of detections: months and times around the page only
    det = spark.createDataFrame([("d", datetime(2024, 3, 1, 1), "x020,x019")], "id string, timestamp timestamp, event_ids string")
    bounded = J.events_between(det, store.read(), 7_200_000)
    plan = bounded._jdf.queryExecution().executedPlan().toString()
    part = plan[plan.index("PartitionFilters"):].split("\n")[0]
    assert "month" in part and "202402" in part and "202403" in part
    assert ids(bounded) == ["x020"]
    got = J.attach_events(det, store.read(), within_ms=4 * 86_400_000).first()
    assert [e.id for e in got.events] == ["x019", "x020"]
    assert J.attach_events(det.limit(0), store.read(), within_ms=1).count() == 0


def test_pages_by_cursor_equal_offset_pages(spark):
    names = ["b", None, "a", "c"]
    df = spark.createDataFrame([(i, names[i % 4], float(i % 5) if i % 3 else None) for i in range(50)], "id long, name string, x double")
    for keys in ([Key(F.col("name")), Key(F.col("x"), False), Key(F.col("id"))], [Key(F.col("x"), False), Key(F.col("name"), False), Key(F.col("id"), False)]):
        want = [r.id for r in df.orderBy(*[k.order() for k in keys]).collect()]
        got, cursor = [], None
        while True:
            found = S.page_after(df, keys, cursor, 7).collect()
            if not found:
                break
            got += [r.id for r in found]
            cursor = [found[-1][str(k.column._jc.toString())] for k in keys]
        assert got == want
    with pytest.raises(ValueError):
        S.page_after(df, [Key(F.col("id"))], (1, 2))
    ts = spark.createDataFrame([(i, datetime(2024, 1 + i, 5)) for i in range(6)], "id long, timestamp timestamp").withColumn("month", F.lit(202401) + F.col("id"))
    second = S.page_after(ts, S.newest_keys(), (datetime(2024, 4, 5), 3), 2)
    assert [r.id for r in second.collect()] == [2, 1]


def test_long_watch_list_equals_contains(spark):
    import random

    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcÄé%_") for _ in range(n))
    names = [word(rng.randrange(0, 9)) for _ in range(300)] + [None, "", "Ab", "x" * 50]
    patterns = [word(rng.randrange(0, 6)) for _ in range(400)] + [None, "", "XXX", "zzz"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id long, name string")
    got = {r.id: r.watch_pattern for r in on_watch_list(df, "name", spark.createDataFrame([(p,) for p in patterns], "p string")).collect()}
    low = {p.lower() for p in patterns if p}
    want = {i: min((p for p in low if n and p in n.lower()), key=lambda p: p.encode(), default=None) for i, n in enumerate(names)}
    assert got == want


def test_watch_list_broadcasts_only_its_bit_map(spark, scratch):
    """Names read from a small file have many n-grams, which a plan by file sizes would broadcast."""
    spark.range(400).select(F.concat(F.lit("proc.exe/"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("name")).write.parquet(f"{scratch}/names")
    spark.range(50).select(F.lpad(F.col("id").cast("string"), 7, "0").alias("p")).write.parquet(f"{scratch}/patterns")
    found = matching_names(spark.read.parquet(f"{scratch}/names"), spark.read.parquet(f"{scratch}/patterns"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    sent = [plan[at:].split("\n", 1)[0] for at in range(len(plan)) if plan.startswith("BroadcastExchange", at)]
    assert len(sent) == 2 and plan.count("SortMergeJoin") == 1  # the levels and the bit map
    assert {(r.name[-9:], r.pattern) for r in found.collect()} >= {("000000399", "0000003"), ("000000005", "0000000")}
    # a pattern of a level's length meets only the names that hold it, as its end is all of it
    ends = spark.createDataFrame([("0000017", 7, "0000017")], "pattern string, level int, gram string")
    assert candidates(spark.read.parquet(f"{scratch}/names"), ends).count() == 11  # 17, and 170 to 179
    long = spark.createDataFrame([("a" * 300 + "b",), ("b" * 9,), ("c" * 300,)], "p string")
    names = spark.createDataFrame([("z" + "a" * 300 + "bz",), ("b" * 10,), ("a" * 301,)], "name string")
    assert {(len(r.name), len(r.pattern)) for r in matching_names(names, long).collect()} == {(303, 301), (10, 9)}


def test_fan_out_of_a_hot_endpoint_is_salted(spark, monkeypatch):
    monkeypatch.setattr(RU, "USERS_PER_SALT", 10)
    pairs = spark.range(300).select(F.concat(F.lit("u"), "id").alias("user"), F.when(F.col("id") < 200, "hot").otherwise(F.concat(F.lit("e"), F.col("id") % 40)).alias("endpoint_id"))
    groups = spark.createDataFrame([(e, d, 1, "r", n) for n, e in enumerate(["hot", "e1", "e2", "nobody"]) for d in ("x", "y")], "endpoint_id string, date string, severity int, rule_id string, _n long")
    plain = groups.join(pairs, "endpoint_id").groupBy("user", "date", "severity", "rule_id").agg(F.sum("_n").alias("n"))
    salted = RU.fan_out(groups, pairs).agg(F.sum("_n").alias("n"))
    assert salted.count() == plain.count() > 400 and salted.exceptAll(plain).count() == 0


def test_ten_batches_leave_no_scratch(spark, scratch):
    from tracehound.session import checkpoint_dir
    from tracehound.streaming.global_order import GlobalRuleBatches

    folder = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    handler = GlobalRuleBatches(f"{scratch}/out")
    for batch in range(10):
        handler(events_df(spark, [ev(f"x{batch}{i}", batch * 60_000 + i * 1000) for i in range(5)]), batch)
    assert set(os.listdir(folder)) == before


def test_snapshot_days_expire(spark, scratch):
    from tracehound.streaming import pipeline as P

    layout = P.Layout(f"{scratch}/out")
    assert P.newest_snapshot(spark, layout).count() == 0
    P.create_tables(spark, layout)
    write_table(events_df(spark, [ev("a", 0), ev("b", 1000)]), layout.events, "events")
    for day in ("2024-01-01 00:00:01", "2024-01-02 00:00:00", "2024-01-09 00:00:00"):
        P.refresh_live(spark, layout, as_of=day, keep_days=8)
    kept = sorted(os.path.basename(p) for p in glob.glob(f"{layout.snapshots}/snapshot_date=*"))
    assert kept == ["snapshot_date=2024-01-02", "snapshot_date=2024-01-09"]
    assert P.newest_snapshot(spark, layout).first().snapshot_timestamp == datetime(2024, 1, 9)
    assert "InMemoryFileIndex(1 paths)" in P.newest_snapshot(spark, layout)._jdf.queryExecution().executedPlan().toString()


def _event_tables(spark, folder, rows=90, files=3):
    raw = spark.range(rows).select(
        F.col("id").alias("event_id"), F.expr("timestampadd(MINUTE, CAST(id * 7 AS INT), timestamp_ntz'2024-01-01 00:00:00')").alias("ts"),
        (F.col("id") % 5).alias("user_id"), F.lit("error").alias("event_type"), F.lit(1.5).alias("value"), F.format_string('{"k": %d}', F.col("id") % 100).alias("props"))
    raw.repartition(files).write.parquet(f"{folder}/events.parquet")


def test_newest_stored_sorts_one_copy_at_a_time(spark, scratch):
    from tracehound.plans import stored

    _event_tables(spark, scratch)
    store = stored._two_years(spark, scratch, "two-years")
    rows = {}
    for tag, month, _ in store.state()["live"]:
        rows[tag] = rows.get(tag, 0) + store._frame([[tag, month, 0]]).count()
    assert len(rows) == 24 and set(rows.values()) == {90}
    assert store.read().select("id").distinct().count() == 24 * 90


def test_disordered_stream_is_written_by_all_tasks(spark, scratch, monkeypatch):
    from tracehound.plans import stored
    from tracehound.session import list_children

    _event_tables(spark, scratch)
    monkeypatch.setattr(stored, "scratch_table_path", lambda spark, label: f"{scratch}/run")
    conf = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))  # a task a file
    try:
        stored.q_stream_disordered(spark, scratch).collect()
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", conf)
    files = [p for p in list_children(spark, f"{scratch}/run/src") if p.endswith(".txt")]
    assert len(files) > 3 * 5  # parts of three tasks each
    from tracehound.streaming.pipeline import Layout

    offsets = list_children(spark, Layout(f"{scratch}/run/out").checkpoint("job") + "/offsets")
    assert len([p for p in offsets if not p.endswith(".crc")]) == 7
