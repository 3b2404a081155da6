"""Physical-plan checks: pushdown, pruning, no single-task windows on the hot path."""

from conftest import SF_SMALL
from tracehound.operators import filters as FL
from tracehound.operators.rules import apply_rules
from tracehound.sources.events import load_table
from tracehound.sources.fixture import load_fixture_events
from tracehound.sources.sinks import write_table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_event_filters_reach_scan_and_prune_months(spark, scratch):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    path = f"{scratch}/events"
    write_table(load_fixture_events(spark, SF_SMALL), path, "events", mode="overwrite")
    ev = load_table(spark, path, "events")
    q = FL.filter_events(ev, endpoint_id="endpoint-3", event_type="login",
                         from_="2024-01-02 00:00:00", to="2024-01-02 12:00:00").select("id", "timestamp")
    p = plan(q)
    assert "EqualTo(endpoint_id,endpoint-3)" in p and "EqualTo(event_type,login)" in p
    assert "PartitionFilters: [isnotnull(month" in p and "202401" in p
    # column pruning: only the needed columns are read
    assert "ReadSchema: struct<id:string,timestamp:timestamp,endpoint_id:string,event_type:string>" in p
    assert q.count() == FL.filter_events(load_fixture_events(spark, SF_SMALL), endpoint_id="endpoint-3",
                                         event_type="login", from_="2024-01-02 00:00:00",
                                         to="2024-01-02 12:00:00").count()


def test_rules_plan_has_no_unpartitioned_window_over_events(spark):
    det = apply_rules(load_fixture_events(spark, SF_SMALL), num_partitions=4)  # few rows would be one bucket
    p = plan(det)
    # every lead window is partitioned by the bucket id, never a global single partition
    specs = [line.rsplit("], [", 2)[1] for line in p.splitlines() if "Window [lead(" in line]
    assert specs and all(spec.startswith("_b#") for spec in specs)
