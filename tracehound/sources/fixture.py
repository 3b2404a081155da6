"""Security-event view over the driver's generic ``events`` table.

The driver ships ``events(event_id, ts timestamp_ntz, user_id, event_type, value, props)``.
This module maps every row to one endpoint-security event with the store's schema
(see FIXTURES.md §2).  It is a pure projection: Catalyst prunes the scan to the five
columns it reads and the mapping runs inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EVENT_COLUMNS
from ..session import configure

# Fixed values of the view (must equal the oracle's):
#   epoch of 2024-01-01 00:00:00 UTC in ms = 1704067200000; time compressed 10x;
#   logins come in bursts of 8 event ids on one endpoint; 10 endpoints, 13 users;
#   user_id % 7 == 0 leaves the user empty on non-login events;
#   process names: k % 3 -> 0 mimikatz.exe, 1 chrome.exe, 2 cmd.exe.
EPOCH_MS = 1704067200000
TIME_COMPRESSION = 10
LOGIN_BURST = 8
N_ENDPOINTS = 10
N_USERS = 13
PROCESS_NAMES = ("mimikatz.exe", "chrome.exe", "cmd.exe")


def _pick(key: Column, values: tuple[str, ...]) -> Column:
    expr = None
    for i, name in enumerate(values):
        expr = F.when(key == i, F.lit(name)) if expr is None else expr.when(key == i, F.lit(name))
    return expr


def fixture_events(raw: DataFrame) -> DataFrame:
    """Map the driver's generic events to security events (store schema)."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    ms = F.lit(EPOCH_MS) + F.expr(
        f"(unix_micros(CAST(ts AS TIMESTAMP)) - {EPOCH_MS * 1000}) div {TIME_COMPRESSION * 1000}"
    )
    et = F.col("et")
    mapped_type = (
        F.when(et == "click", "process")
        .when(et == "view", "network")
        .when(et == "signup", "file")
        .when((et == "error") | (F.col("k") < 70), "login")
        .when(F.col("k") < 85, "dns")
        .otherwise("registry")
    )
    typ = F.col("event_type")
    is_login = typ == "login"
    burst = F.expr(f"event_id div {LOGIN_BURST}")
    endpoint_no = F.when(is_login, burst % N_ENDPOINTS).otherwise(F.col("user_id") % N_ENDPOINTS)
    user_no = F.when(is_login, burst % N_USERS).otherwise(F.col("user_id") % N_USERS)
    kk = F.col("k")
    status = (
        F.when(typ == "file", F.when(kk % 4 == 0, "success").otherwise("write"))
        .when(typ == "process", F.when(kk % 5 == 0, "blocked").otherwise("success"))
        .when(typ == "login", F.when(kk % 6 == 0, "success").otherwise("failed"))
        .otherwise("allowed")
    )
    base = raw.select(
        "event_id",
        "user_id",
        F.col("event_type").alias("et"),
        "value",
        ms.alias("ts_ms"),
        k.alias("k"),
    ).withColumn("event_type", mapped_type)
    out = base.select(
        F.concat(F.lit("evt-"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("id"),
        F.timestamp_millis("ts_ms").alias("timestamp"),
        F.concat(F.lit("endpoint-"), endpoint_no.cast("string")).alias("endpoint_id"),
        typ.alias("event_type"),
        status.alias("status"),
        F.when(typ == "network", F.when(kk % 4 == 0, "inbound").otherwise("outbound"))
        .otherwise("")
        .alias("direction"),
        F.when(typ == "network", F.floor(F.col("value") * 100).cast("bigint"))
        .otherwise(F.lit(0).cast("bigint"))
        .alias("bytes"),
        F.lit("").alias("source_ip"),
        F.lit("").alias("destination_ip"),
        F.when(typ.isin("process", "network", "file"), _pick(kk % 3, PROCESS_NAMES))
        .otherwise("")
        .alias("process_name"),
        F.when((F.col("user_id") % 7 == 0) & ~is_login, F.lit(""))
        .otherwise(F.concat(F.lit("user-"), user_no.cast("string")))
        .alias("user"),
    )
    return out.withColumn("date", F.to_date("timestamp")).select(*EVENT_COLUMNS)


def load_fixture_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read ``{sf_dir}/events.parquet`` and return the security-event view."""
    configure(spark)
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    return fixture_events(raw)


# Hostname lookup rows (FIXTURES.md §2): endpoint-0..endpoint-7 are registered,
# endpoint-8 and endpoint-9 are left out on purpose so the lookup falls back to 'Unknown'.
FIXTURE_ENDPOINT_COUNT = 8


def fixture_endpoints(spark: SparkSession) -> DataFrame:
    """The small endpoints lookup table used by the hostname join."""
    configure(spark)
    return spark.range(FIXTURE_ENDPOINT_COUNT).select(
        F.concat(F.lit("endpoint-"), F.col("id").cast("string")).alias("endpoint_id"),
        F.concat(F.lit("host-"), F.col("id").cast("string")).alias("hostname"),
        F.concat(F.lit("10.0.0."), (F.col("id") + 1).cast("string")).alias("ip"),
        F.when(F.col("id") % 2 == 0, "windows").otherwise("linux").alias("os"),
        F.timestamp_millis(F.lit(EPOCH_MS) + F.col("id") * 3600000).alias("last_seen"),
    )
