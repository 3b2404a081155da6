"""Registered queries: one Spark plan per operator, each with its DuckDB oracle.

Every query reads the driver's tables from ``sf_dir`` (through the security-event view)
so its work grows with the data.  Columns are aliased identically on both sides; array
and struct results are rendered as text (``array_join`` / ``to_json`` is avoided for
nested values, whose formatting differs between engines) so the driver's value hash is
engine-neutral.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.ordinal import with_ordinal
from ..operators.rules import apply_rules
from ..sources.fixture import load_fixture_events
from . import oracles as O

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return deco


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_fixture_events(spark, sf_dir)


def detections(spark: SparkSession, sf_dir: str, scope: str = "global") -> DataFrame:
    """Detections derived from the events; materialised once because most request
    plans read them several times (summaries, top-k, the events lookup)."""
    return apply_rules(events(spark, sf_dir), scope=scope, materialize=True)


# ------------------------------------------------------------------ tables


@register("events_table", O.sql(f"SELECT {O.EVENTS_COLS} FROM ev2"))
def q_events_table(spark, sf_dir):
    return events(spark, sf_dir)


# ------------------------------------------------------------------ rules


@register("rules_global", O.sql("SELECT * FROM det", det=True))
def q_rules_global(spark, sf_dir):
    return detections(spark, sf_dir, "global")


@register("rules_endpoint", O.sql("SELECT * FROM det_ep", det_ep=True))
def q_rules_endpoint(spark, sf_dir):
    return detections(spark, sf_dir, "endpoint")


# ------------------------------------------------------------------ shared fixed parameters

from pyspark.sql import functions as F  # noqa: E402

from ..functions import scalars as X  # noqa: E402
from ..functions.parse import normalize_events  # noqa: E402
from ..functions.predicates import is_suspicious_process  # noqa: E402
from ..operators import views as V  # noqa: E402
from ..operators import filters as FL  # noqa: E402
from ..operators import joins as J  # noqa: E402
from ..operators import sorting as S  # noqa: E402
from ..operators import setops as U  # noqa: E402
from ..operators import lifecycle as L  # noqa: E402
from ..operators.rules import FAILED_LOGINS, FILE_WRITE_EXECUTE, SUSPICIOUS_PROCESS_NETWORK  # noqa: E402
from ..sources.fixture import fixture_endpoints  # noqa: E402
from . import dashboard as D  # noqa: E402
from . import requests as R  # noqa: E402

# Fixed query parameters (FIXTURES.md §2: as_of is 2024-01-03 12:00:00).
AS_OF = "2024-01-03 12:00:00"
ENDPOINT = "endpoint-3"
USER = "user-3"


def _events_text(df, alias: str = "events"):
    """Render an attached events array as (event_list, n_events)."""
    return df.withColumn("event_list", F.array_join(F.transform(alias, lambda e: e["id"]), ",")).withColumn(
        "n_events", F.size(alias).cast("bigint")
    ).drop(alias)


J4_SQL = """
pairs AS (SELECT DISTINCT d.id detection_id, u.eid event_id
          FROM {det} d, unnest(string_split(d.event_ids, ',')) u(eid) WHERE u.eid <> ''),
m AS (SELECT p.detection_id, e.id, e."timestamp" FROM pairs p JOIN ev2 e ON e.id = p.event_id)"""


def _j4(det_cte: str, body: str) -> str:
    return ", " + J4_SQL.format(det=det_cte).strip() + ",\n" + body.strip() + "\n"


def _det_with_events_sql(src: str) -> str:
    return f"""SELECT d.id, d."timestamp", d.rule_id, d.severity, d.endpoint_id, d.description, d.event_ids, d.date,
  coalesce(string_agg(m.id, ',' ORDER BY m."timestamp", m.id), '') event_list, count(m.id) n_events
FROM {src} d LEFT JOIN m ON m.detection_id = d.id
GROUP BY d.id, d."timestamp", d.rule_id, d.severity, d.endpoint_id, d.description, d.event_ids, d.date"""


# ------------------------------------------------------------------ parse / normalise


@register("normalize_events", O.sql(f"SELECT {O.EVENTS_COLS} FROM ev2"))
def q_normalize_events(spark, sf_dir):
    ev = events(spark, sf_dir)
    shouting = ev.select(
        *[
            F.upper(c).alias(c) if c in ("event_type", "status", "direction", "process_name") else F.col(c)
            for c in ev.columns
        ]
    )
    return normalize_events(shouting)


@register("with_month", O.sql("""SELECT id, date, CAST(year(date)*100+month(date) AS INTEGER) "month",
  CAST(hour("timestamp") AS INTEGER) "hour", CAST(minute("timestamp") AS INTEGER) "minute" FROM ev2"""))
def q_with_month(spark, sf_dir):
    ev = events(spark, sf_dir)
    return ev.select(
        "id", "date", X.yyyymm("date").alias("month"),
        F.hour("timestamp").alias("hour"), F.minute("timestamp").alias("minute"),
    )


# ------------------------------------------------------------------ single rules


@register("rule_failed_logins", O.sql("SELECT * FROM det WHERE rule_id = 'RULE-001'", det=True))
def q_rule_failed_logins(spark, sf_dir):
    return apply_rules(events(spark, sf_dir), [FAILED_LOGINS])


@register("rule_suspicious_network", O.sql("SELECT * FROM det WHERE rule_id = 'RULE-002'", det=True))
def q_rule_suspicious_network(spark, sf_dir):
    return apply_rules(events(spark, sf_dir), [SUSPICIOUS_PROCESS_NETWORK])


@register("rule_write_execute", O.sql("SELECT * FROM det WHERE rule_id = 'RULE-003'", det=True))
def q_rule_write_execute(spark, sf_dir):
    return apply_rules(events(spark, sf_dir), [FILE_WRITE_EXECUTE])


# ------------------------------------------------------------------ views


@register("detection_summary", O.sql("""SELECT date, rule_id, severity, count(*) detection_count,
  count(DISTINCT endpoint_id) affected_endpoints FROM det GROUP BY date, rule_id, severity""", det=True))
def q_detection_summary(spark, sf_dir):
    return V.detection_summary(detections(spark, sf_dir))


@register("endpoint_detections", O.sql("SELECT * FROM a2", views=True))
def q_endpoint_detections(spark, sf_dir):
    return V.endpoint_detections(detections(spark, sf_dir))


@register("endpoint_events", O.sql("SELECT * FROM a3", views=True))
def q_endpoint_events(spark, sf_dir):
    return V.endpoint_events(events(spark, sf_dir))


@register("user_events", O.sql("SELECT * FROM a4", views=True))
def q_user_events(spark, sf_dir):
    return V.user_events(events(spark, sf_dir))


@register("user_detections", O.sql("SELECT \"user\", date, severity, rule_id, CAST(detection_count AS BIGINT) detection_count FROM a5", views=True))
def q_user_detections(spark, sf_dir):
    return V.user_detections(detections(spark, sf_dir), events(spark, sf_dir))


@register("endpoint_details_view", O.sql("""SELECT endpoint_id, primary_user, last_seen, total_events,
  unique_event_types, unique_users, array_to_string(recent_event_types, ',') recent_event_types FROM a6""", views=True))
def q_endpoint_details_view(spark, sf_dir):
    a6 = V.endpoint_details_view(events(spark, sf_dir))
    return a6.withColumn("recent_event_types", F.array_join("recent_event_types", ","))


@register("user_details_view", O.sql("""SELECT "user", last_seen, total_events, unique_event_types,
  unique_endpoints, array_to_string(recent_endpoints, ',') recent_endpoints FROM a7""", views=True))
def q_user_details_view(spark, sf_dir):
    a7 = V.user_details_view(events(spark, sf_dir))
    return a7.withColumn("recent_endpoints", F.array_join("recent_endpoints", ","))


@register("endpoint_event_summary", O.sql("""SELECT endpoint_id, event_type, CAST(sum(event_count) AS BIGINT) event_count,
  max(last_seen) last_seen, CAST(sum(unique_users) AS BIGINT) unique_users FROM a3 GROUP BY endpoint_id, event_type""", views=True))
def q_endpoint_event_summary(spark, sf_dir):
    return V.endpoint_event_summary(V.endpoint_events(events(spark, sf_dir)))


@register("endpoint_detection_summary", O.sql("""SELECT endpoint_id, CAST(sum(detection_count) AS BIGINT) detection_count,
  max(max_severity) max_severity FROM a2 GROUP BY endpoint_id""", views=True))
def q_endpoint_detection_summary(spark, sf_dir):
    return V.endpoint_detection_summary(V.endpoint_detections(detections(spark, sf_dir)))


@register("user_event_summary", O.sql("""SELECT "user", event_type, CAST(sum(event_count) AS BIGINT) event_count,
  max(last_seen) last_seen, CAST(sum(unique_endpoints) AS BIGINT) unique_endpoints FROM a4 GROUP BY "user", event_type""", views=True))
def q_user_event_summary(spark, sf_dir):
    return V.user_event_summary(V.user_events(events(spark, sf_dir)))


@register("user_detection_summary", O.sql("""SELECT "user", max(severity) max_severity,
  CAST(sum(detection_count) AS BIGINT) detection_count, count(DISTINCT rule_id) unique_rules FROM a5 GROUP BY "user" """, views=True))
def q_user_detection_summary(spark, sf_dir):
    return V.user_detection_summary(V.user_detections(detections(spark, sf_dir), events(spark, sf_dir)))


@register("endpoint_list_kpis", O.sql(f"""SELECT count(*) total,
  count(*) FILTER (WHERE CAST(last_seen AS DATE) = CAST({O.AS_OF} AS DATE)) active_today,
  CAST(coalesce(sum(total_events), 0) AS BIGINT) total_events FROM a6""", views=True))
def q_endpoint_list_kpis(spark, sf_dir):
    return V.list_kpis(R.list_endpoints(events(spark, sf_dir)), AS_OF)


@register("user_list_kpis", O.sql(f"""SELECT count(*) total,
  count(*) FILTER (WHERE CAST(last_seen AS DATE) = CAST({O.AS_OF} AS DATE)) active_today,
  CAST(coalesce(sum(total_events), 0) AS BIGINT) total_events FROM a7""", views=True))
def q_user_list_kpis(spark, sf_dir):
    return V.list_kpis(R.list_users(events(spark, sf_dir)), AS_OF)


@register("event_type_share", O.sql(f"""SELECT event_type, count, CAST(count AS DOUBLE) / max(count) OVER () * 100.0 pct_of_max
FROM (SELECT event_type, CAST(sum(event_count) AS BIGINT) count FROM a3
      WHERE date >= CAST({O.AS_OF} AS DATE) - 1 GROUP BY event_type ORDER BY count DESC, event_type LIMIT 10)""", views=True))
def q_event_type_share(spark, sf_dir):
    a3 = V.endpoint_events(events(spark, sf_dir))
    return V.pct_of_max(D.event_type_distribution(a3, AS_OF).select("event_type", "count"), "count")


@register("user_endpoint_pairs", O.sql("SELECT DISTINCT \"user\", endpoint_id FROM ev2 WHERE \"user\" <> ''"))
def q_user_endpoint_pairs(spark, sf_dir):
    return V.user_endpoint_pairs(events(spark, sf_dir))


@register("table_health", O.sql("""SELECT 'events' "table", count(*) "rows", 'OK' state FROM ev2
UNION ALL SELECT 'detections', count(*), CASE WHEN count(*) >= 1 THEN 'OK' ELSE 'EMPTY' END FROM det
UNION ALL SELECT 'endpoints', count(*), 'OK' FROM endpoints
UNION ALL SELECT 'detections_late', count(*), 'EMPTY' FROM det WHERE "timestamp" > TIMESTAMP '2030-01-01'
UNION ALL SELECT 'archive', CAST(NULL AS BIGINT), 'MISSING'""", det=True, endpoints=True))
def q_table_health(spark, sf_dir):
    ev = events(spark, sf_dir)
    det = detections(spark, sf_dir)
    return V.table_health(
        {
            "events": ev,
            "detections": det,
            "endpoints": fixture_endpoints(spark),
            "detections_late": det.where(F.col("timestamp") > F.lit("2030-01-01").cast("timestamp")),
            "archive": None,
        }
    )


@register("event_type_counts", O.sql("SELECT event_type, count(*) event_count FROM ev2 GROUP BY event_type"))
def q_event_type_counts(spark, sf_dir):
    return V.event_type_counts(events(spark, sf_dir))


@register("latest_by_key", O.sql("""SELECT id, "timestamp", rule_id, severity, endpoint_id, description, event_ids, date
FROM (SELECT *, row_number() OVER (PARTITION BY severity, rule_id, "timestamp" ORDER BY id DESC) rn FROM det) WHERE rn = 1""", det=True))
def q_latest_by_key(spark, sf_dir):
    return V.latest_by_key(detections(spark, sf_dir), ["severity", "rule_id", "timestamp"], "id")


@register("merge_partials", O.sql("""SELECT endpoint_id, event_type, CAST(sum(event_count) AS BIGINT) event_count,
  min(first_seen) first_seen, max(last_seen) last_seen FROM a3 GROUP BY endpoint_id, event_type""", views=True))
def q_merge_partials(spark, sf_dir):
    a3 = V.endpoint_events(events(spark, sf_dir))
    return V.merge_partials(a3, ["endpoint_id", "event_type"], sums=["event_count"], mins=["first_seen"], maxs=["last_seen"])


# ------------------------------------------------------------------ parse round trip


@register("parse_roundtrip", O.sql(f"SELECT {O.EVENTS_COLS} FROM ev2"))
def q_parse_roundtrip(spark, sf_dir):
    """Events serialised to wire JSON (epoch-ms timestamps) and parsed back."""
    from ..functions.parse import parse_events

    ev = events(spark, sf_dir)
    wire = ev.select(
        F.to_json(
            F.struct(
                "id",
                F.unix_millis("timestamp").alias("timestamp"),
                *[c for c in ev.columns if c not in ("id", "timestamp", "date")],
            )
        ).alias("value")
    )
    return parse_events(wire)


# ------------------------------------------------------------------ filters (F1-F12) and paging

_EV_ORDER = 'ORDER BY "timestamp" DESC, id'


@register("get_events_page", O.sql(f"SELECT {O.EVENTS_COLS} FROM ev2 {_EV_ORDER} LIMIT 100 OFFSET 40"))
def q_get_events_page(spark, sf_dir):
    return R.get_events(events(spark, sf_dir), limit=100, offset=40)


@register("get_events_filtered", O.sql(f"""SELECT {O.EVENTS_COLS} FROM ev2
WHERE endpoint_id = '{ENDPOINT}' AND event_type = 'login'
  AND "timestamp" >= TIMESTAMP '2024-01-02 00:00:00' AND "timestamp" <= TIMESTAMP '2024-01-03 06:00:00'
{_EV_ORDER} LIMIT 100"""))
def q_get_events_filtered(spark, sf_dir):
    return R.get_events(
        events(spark, sf_dir), endpoint_id=ENDPOINT, event_type="login",
        from_="2024-01-02 00:00:00", to="2024-01-03 06:00:00",
    )


@register("get_events_user", O.sql(f"""SELECT {O.EVENTS_COLS} FROM ev2
WHERE "user" = '{USER}' AND event_type = 'process' {_EV_ORDER} LIMIT 50"""))
def q_get_events_user(spark, sf_dir):
    return R.events_by_user(events(spark, sf_dir), USER, event_type="process", limit=50)


@register("events_by_endpoint", O.sql(f"""SELECT {O.EVENTS_COLS} FROM ev2
WHERE endpoint_id = '{ENDPOINT}' {_EV_ORDER} LIMIT 100 OFFSET 5"""))
def q_events_by_endpoint(spark, sf_dir):
    return R.events_by_endpoint(events(spark, sf_dir), ENDPOINT, offset=5)


@register("get_detections_filtered", O.sql(_j4("det", f"""
pg AS (SELECT * FROM det WHERE severity = 3 AND "timestamp" >= TIMESTAMP '2024-01-02 00:00:00'
       {_EV_ORDER} LIMIT 100)
""" ) + _det_with_events_sql("pg"), det=True))
def q_get_detections_filtered(spark, sf_dir):
    out = R.get_detections(detections(spark, sf_dir), events(spark, sf_dir), severity=3, from_="2024-01-02 00:00:00")
    return _events_text(out)


@register("get_detections_user", O.sql(_j4("det", f"""
pg AS (SELECT * FROM det WHERE rule_id = 'RULE-002'
         AND endpoint_id IN (SELECT DISTINCT endpoint_id FROM ev2 WHERE "user" = '{USER}')
       {_EV_ORDER} LIMIT 100)
""") + _det_with_events_sql("pg"), det=True))
def q_get_detections_user(spark, sf_dir):
    out = R.detections_by_user(detections(spark, sf_dir), events(spark, sf_dir), USER, rule_id="RULE-002")
    return _events_text(out)


@register("get_detections_page", O.sql(_j4("det", f"""
pg AS (SELECT * FROM det {_EV_ORDER} LIMIT 100 OFFSET 10)
""") + _det_with_events_sql("pg"), det=True))
def q_get_detections_page(spark, sf_dir):
    # severity 0 and empty strings are "no filter"
    out = R.get_detections(detections(spark, sf_dir), events(spark, sf_dir), severity=0, rule_id="", offset=10)
    return _events_text(out)


@register("filter_in", O.sql(f"SELECT {O.EVENTS_COLS} FROM ev2 WHERE endpoint_id IN ('endpoint-1','endpoint-4','endpoint-9')"))
def q_filter_in(spark, sf_dir):
    return FL.filter_in(events(spark, sf_dir), "endpoint_id", ["endpoint-1", "endpoint-4", "endpoint-9"])


@register("recent_days", O.sql(f"SELECT * FROM a3 WHERE date >= CAST({O.AS_OF} AS DATE) - 1", views=True))
def q_recent_days(spark, sf_dir):
    return FL.recent_days(V.endpoint_events(events(spark, sf_dir)), AS_OF, 1)


@register("recent_hours", O.sql(f"""SELECT "user", last_seen, total_events, unique_event_types, unique_endpoints,
  array_to_string(recent_endpoints, ',') recent_endpoints FROM a7 WHERE last_seen >= {O.AS_OF} - INTERVAL 24 HOUR""", views=True))
def q_recent_hours(spark, sf_dir):
    a7 = FL.recent_hours(V.user_details_view(events(spark, sf_dir)), AS_OF, 24)
    return a7.withColumn("recent_endpoints", F.array_join("recent_endpoints", ","))


@register("search_endpoints", O.sql("""SELECT endpoint_id, primary_user "user", last_seen, total_events event_count, unique_users,
  array_to_string(recent_event_types, ',') recent_event_types FROM a6
WHERE contains(lower(endpoint_id), '-1') OR contains(lower(primary_user), '-1')""", views=True))
def q_search_endpoints(spark, sf_dir):
    df = FL.search_rows(R.list_endpoints(events(spark, sf_dir)), "-1", ["endpoint_id", "user"])
    return df.withColumn("recent_event_types", F.array_join("recent_event_types", ","))


@register("search_users", O.sql("""SELECT "user", last_seen, total_events event_count, unique_endpoints FROM a7
WHERE contains(lower("user"), 'user-1')""", views=True))
def q_search_users(spark, sf_dir):
    return FL.search_rows(R.list_users(events(spark, sf_dir)), "USER-1", ["user"])


@register("suspicious_process_events", O.sql(f"""SELECT {O.EVENTS_COLS} FROM ev2 WHERE
  contains(lower(process_name), 'mimikatz') OR contains(lower(process_name), 'psexec')
  OR contains(lower(process_name), 'powershell.exe') OR contains(lower(process_name), 'cmd.exe')
  OR contains(lower(process_name), 'rundll32.exe')"""))
def q_suspicious_process_events(spark, sf_dir):
    ev = events(spark, sf_dir)
    return ev.where(is_suspicious_process("process_name"))


@register("get_event_by_id", O.sql(f"SELECT {O.EVENTS_COLS} FROM ev2 WHERE id = 'evt-000000042'"))
def q_get_event_by_id(spark, sf_dir):
    return FL.get_by_id(events(spark, sf_dir), "evt-000000042")


@register("page_count", O.sql("SELECT CAST(ceil(count(*) / 10.0) AS BIGINT) pages FROM ev2"))
def q_page_count(spark, sf_dir):
    return S.page_count(events(spark, sf_dir), 10)


@register("page_number", O.sql(f"SELECT {O.EVENTS_COLS} FROM ev2 {_EV_ORDER} LIMIT 10 OFFSET 20"))
def q_page_number(spark, sf_dir):
    return S.page_number(events(spark, sf_dir), S.newest_first(), 3, 10)


# ------------------------------------------------------------------ joins


@register("events_with_hostnames", O.sql("""SELECT e.id, e."timestamp", e.endpoint_id,
  coalesce(nullif(p.hostname, ''), 'Unknown') hostname
FROM ev2 e LEFT JOIN endpoints p ON p.endpoint_id = e.endpoint_id""", endpoints=True))
def q_events_with_hostnames(spark, sf_dir):
    ev = events(spark, sf_dir).select("id", "timestamp", "endpoint_id")
    return J.add_hostnames(ev, fixture_endpoints(spark))


@register("detections_with_events", O.sql(_j4("det", "x AS (SELECT 1)") + _det_with_events_sql("det"), det=True))
def q_detections_with_events(spark, sf_dir):
    return _events_text(J.attach_events(detections(spark, sf_dir), events(spark, sf_dir)))


# ------------------------------------------------------------------ requests (Q2, Q4, Q7-Q10)


@register("live_events", O.sql(f"SELECT {O.EVENTS_COLS} FROM ev2 {_EV_ORDER} LIMIT 20"))
def q_live_events(spark, sf_dir):
    return R.live_events(events(spark, sf_dir))


@register("live_detections", O.sql(_j4("det", f"pg AS (SELECT * FROM det {_EV_ORDER} LIMIT 20)") + _det_with_events_sql("pg"), det=True))
def q_live_detections(spark, sf_dir):
    return _events_text(R.live_detections(detections(spark, sf_dir), events(spark, sf_dir)))


@register("list_endpoints", O.sql("""SELECT endpoint_id, primary_user "user", last_seen, total_events event_count, unique_users,
  array_to_string(recent_event_types, ',') recent_event_types FROM a6""", views=True))
def q_list_endpoints(spark, sf_dir):
    return R.list_endpoints(events(spark, sf_dir)).withColumn("recent_event_types", F.array_join("recent_event_types", ","))


@register("list_users", O.sql("""SELECT "user", last_seen, total_events event_count, unique_endpoints FROM a7""", views=True))
def q_list_users(spark, sf_dir):
    return R.list_users(events(spark, sf_dir))


def _endpoint_part(part: str):
    def fn(spark, sf_dir):
        out = R.endpoint_details(events(spark, sf_dir), lambda: detections(spark, sf_dir), ENDPOINT)[part]
        if part == "details":
            out = out.withColumn("recent_event_types", F.array_join("recent_event_types", ","))
        if part == "detections":
            out = _events_text(out)
        return out

    return fn


_ENDPOINT_SQL = {
    "details": O.sql(f"""SELECT endpoint_id, primary_user "user", last_seen, total_events event_count, unique_event_types,
  unique_users, array_to_string(recent_event_types, ',') recent_event_types FROM a6 WHERE endpoint_id = '{ENDPOINT}'""", views=True),
    "eventSummary": O.sql(f"""SELECT endpoint_id, event_type, CAST(sum(event_count) AS BIGINT) event_count, max(last_seen) last_seen,
  CAST(sum(unique_users) AS BIGINT) unique_users FROM a3 WHERE endpoint_id = '{ENDPOINT}' GROUP BY endpoint_id, event_type""", views=True),
    "events": O.sql(f"SELECT {O.EVENTS_COLS} FROM ev2 WHERE endpoint_id = '{ENDPOINT}' {_EV_ORDER} LIMIT 20"),
    "detectionSummary": O.sql(f"""SELECT endpoint_id, CAST(sum(detection_count) AS BIGINT) detection_count, max(max_severity) max_severity
  FROM a2 WHERE endpoint_id = '{ENDPOINT}' GROUP BY endpoint_id""", views=True),
    "detections": O.sql(_j4("det", f"pg AS (SELECT * FROM det WHERE endpoint_id = '{ENDPOINT}' {_EV_ORDER} LIMIT 20)")
                        + _det_with_events_sql("pg"), det=True),
}
for _part, _sql in _ENDPOINT_SQL.items():
    register(f"endpoint_details_{_part}", _sql)(_endpoint_part(_part))


def _user_part(part: str):
    def fn(spark, sf_dir):
        out = R.user_details(events(spark, sf_dir), lambda: detections(spark, sf_dir), USER)[part]
        if part == "details":
            out = out.withColumn("recent_endpoints", F.array_join("recent_endpoints", ","))
        if part == "detections":
            out = _events_text(out)
        return out

    return fn


_USER_EPS = f"(SELECT unnest(recent_endpoints) FROM a7 WHERE \"user\" = '{USER}')"
_USER_SQL = {
    "details": O.sql(f"""SELECT "user", last_seen, total_events event_count, unique_event_types, unique_endpoints,
  array_to_string(recent_endpoints, ',') recent_endpoints FROM a7 WHERE "user" = '{USER}'""", views=True),
    "eventSummary": O.sql(f"""SELECT "user", event_type, CAST(sum(event_count) AS BIGINT) event_count, max(last_seen) last_seen,
  CAST(sum(unique_endpoints) AS BIGINT) unique_endpoints FROM a4 WHERE "user" = '{USER}' GROUP BY "user", event_type""", views=True),
    "events": O.sql(f"SELECT {O.EVENTS_COLS} FROM ev2 WHERE \"user\" = '{USER}' {_EV_ORDER} LIMIT 20"),
    "detectionSummary": O.sql(f"""SELECT "user", max(severity) max_severity, CAST(sum(detection_count) AS BIGINT) detection_count,
  count(DISTINCT rule_id) unique_rules FROM a5 WHERE "user" = '{USER}' GROUP BY "user" """, views=True),
    "endpoints": O.sql(f"""SELECT endpoint_id, primary_user "user", last_seen, total_events event_count FROM a6
  WHERE endpoint_id IN {_USER_EPS}""", views=True),
    "detections": O.sql(_j4("det", f"pg AS (SELECT * FROM det WHERE endpoint_id IN {_USER_EPS} {_EV_ORDER} LIMIT 20)")
                        + _det_with_events_sql("pg"), views=True),
}
for _part, _sql in _USER_SQL.items():
    register(f"user_details_{_part}", _sql)(_user_part(_part))


# ------------------------------------------------------------------ dashboard


def _snapshot(spark, sf_dir):
    return D.dashboard_snapshot(events(spark, sf_dir), detections(spark, sf_dir), AS_OF)


_DAY = f"date >= CAST({O.AS_OF} AS DATE) - 1"
_LIVE = f"last_seen >= {O.AS_OF} - INTERVAL 24 HOUR"
_DASH = {
    "severity": f"""SELECT CAST(row_number() OVER (ORDER BY severity) AS INTEGER) rank, severity, count FROM
  (SELECT severity, CAST(sum(detection_count) AS BIGINT) count FROM a5 WHERE {_DAY} GROUP BY severity)""",
    "event_types": f"""SELECT CAST(row_number() OVER (ORDER BY count DESC, event_type) AS INTEGER) rank, event_type, count FROM
  (SELECT event_type, CAST(sum(event_count) AS BIGINT) count FROM a3 WHERE {_DAY} GROUP BY event_type
   ORDER BY count DESC, event_type LIMIT 10)""",
    "active_endpoints": f"""SELECT CAST(row_number() OVER (ORDER BY total_events DESC, endpoint_id) AS INTEGER) rank,
  endpoint_id, primary_user "user", total_events event_count FROM
  (SELECT * FROM a6 WHERE {_LIVE} ORDER BY total_events DESC, endpoint_id LIMIT 50)""",
    "active_users": f"""SELECT CAST(row_number() OVER (ORDER BY total_events DESC, "user") AS INTEGER) rank,
  "user", total_events event_count, unique_endpoints FROM
  (SELECT * FROM a7 WHERE {_LIVE} ORDER BY total_events DESC, "user" LIMIT 50)""",
    "recent_events": f"""SELECT CAST(row_number() OVER ({_EV_ORDER}) AS INTEGER) rank, r.id, r."timestamp", r.endpoint_id,
  r.event_type, r."user", coalesce(nullif(p.hostname, ''), 'Unknown') hostname FROM
  (SELECT * FROM ev2 {_EV_ORDER} LIMIT 20) r LEFT JOIN endpoints p ON p.endpoint_id = r.endpoint_id""",
    "recent_detections": f"""SELECT CAST(row_number() OVER ({_EV_ORDER}) AS INTEGER) rank, r.id, r."timestamp", r.endpoint_id,
  r.rule_id, r.severity, coalesce(nullif(p.hostname, ''), 'Unknown') hostname FROM
  (SELECT * FROM det {_EV_ORDER} LIMIT 20) r LEFT JOIN endpoints p ON p.endpoint_id = r.endpoint_id""",
}


def _dash_part(part: str):
    def fn(spark, sf_dir):
        ev = events(spark, sf_dir)
        return D.dashboard_section(part, ev, lambda: detections(spark, sf_dir), AS_OF, fixture_endpoints(spark))

    return fn


for _part, _sql in _DASH.items():
    register(f"dashboard_{_part}", O.sql(_sql, views=True, endpoints=True))(_dash_part(_part))


@register("dashboard_totals", O.sql(f"""SELECT CAST({O.AS_OF} AS DATE) snapshot_date, CAST(hour({O.AS_OF}) AS INTEGER) snapshot_hour,
  CAST(minute({O.AS_OF}) AS INTEGER) snapshot_minute, {O.AS_OF} snapshot_timestamp,
  (SELECT CAST(coalesce(sum(event_count), 0) AS BIGINT) FROM a3 WHERE {_DAY}) total_events,
  (SELECT CAST(coalesce(sum(detection_count), 0) AS BIGINT) FROM a2 WHERE {_DAY}) total_detections""", views=True))
def q_dashboard_totals(spark, sf_dir):
    return D.dashboard_totals(events(spark, sf_dir), lambda: detections(spark, sf_dir), AS_OF)


@register("dashboard_event_type_pct", O.sql(f"""SELECT event_type, count, CAST(count AS DOUBLE) / max(count) OVER () * 100.0 pct_of_max FROM
  (SELECT event_type, CAST(sum(event_count) AS BIGINT) count FROM a3 WHERE {_DAY} GROUP BY event_type
   ORDER BY count DESC, event_type LIMIT 10)""", views=True))
def q_dashboard_event_type_pct(spark, sf_dir):
    stats = D.dashboard_stats(_snapshot(spark, sf_dir), fixture_endpoints(spark))
    return V.pct_of_max(stats["event_types"].select("event_type", "count"), "count")


# ------------------------------------------------------------------ scalars

_TITLE = "CASE WHEN {c} IS NULL OR {c} = '' THEN 'Unknown' ELSE array_to_string(list_transform(string_split({c}, '_'), lambda w: upper(w[1]) || w[2:]), ' ') END"


@register("event_labels", O.sql(f"""SELECT id, {_TITLE.format(c='event_type')} type_label, {_TITLE.format(c='status')} status_label,
  strftime("timestamp", '%b %d, %Y %H:%M:%S') time_label, substring(id, 1, 8) short_id,
  CASE WHEN "user" IS NULL OR "user" = '' THEN 'Unknown' ELSE "user" END user_label,
  CAST(trunc((epoch_ms({O.AS_OF}) - epoch_ms("timestamp")) / 1000.0) AS BIGINT) age_seconds,
  CAST(year("timestamp")*100+month("timestamp") AS INTEGER) yyyymm FROM ev2"""))
def q_event_labels(spark, sf_dir):
    ev = events(spark, sf_dir)
    return ev.select(
        "id",
        X.title_words("event_type").alias("type_label"),
        X.title_words("status").alias("status_label"),
        X.date_label("timestamp").alias("time_label"),
        X.short_id("id").alias("short_id"),
        X.default("user", "Unknown").alias("user_label"),
        X.elapsed_seconds("timestamp", AS_OF).alias("age_seconds"),
        X.yyyymm("timestamp").alias("yyyymm"),
    )


@register("detection_labels", O.sql("""SELECT id, CASE WHEN severity = 1 THEN 'Low' WHEN severity IN (2, 3) THEN 'Medium'
  WHEN severity = 4 THEN 'High' WHEN severity = 5 THEN 'Critical' ELSE 'Unknown' END severity_name,
  CASE WHEN length(description) > 30 THEN substring(description, 1, 30) || '...' ELSE description END short_description,
  substring(id, 1, 8) short_id, """ + _TITLE.format(c="lower(replace(rule_id, '-', '_'))") + """ rule_label FROM det""", det=True))
def q_detection_labels(spark, sf_dir):
    det = detections(spark, sf_dir)
    return det.select(
        "id",
        X.severity_name("severity").alias("severity_name"),
        X.truncate_text("description", 30).alias("short_description"),
        X.short_id("id").alias("short_id"),
        X.title_words(F.lower(F.regexp_replace("rule_id", "-", "_"))).alias("rule_label"),
    )


@register("page_hosts", O.sql("""SELECT page_id, CASE WHEN url IS NULL OR url = '' THEN '' ELSE
  split_part(split_part(CASE WHEN contains(url, '//') THEN split_part(url, '/', 3) ELSE split_part(url, '/', 1) END, ':', 1), '?', 1) END host
FROM pages"""))
def q_page_hosts(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", X.url_host("url").alias("host"))


# ------------------------------------------------------------------ sorting


def _hosts_a6(spark, sf_dir):
    a6 = V.endpoint_details_view(events(spark, sf_dir)).select("endpoint_id", "total_events")
    return a6.join(fixture_endpoints(spark).select("endpoint_id", "hostname"), "endpoint_id", "left")


@register("sort_nulls_last_asc", O.sql("""SELECT a.endpoint_id, a.total_events, p.hostname,
  row_number() OVER (ORDER BY p.hostname ASC NULLS LAST, a.endpoint_id) AS place FROM a6 a
LEFT JOIN endpoints p ON p.endpoint_id = a.endpoint_id""", views=True, endpoints=True))
def q_sort_nulls_last_asc(spark, sf_dir):
    hosts = _hosts_a6(spark, sf_dir)
    order = S.nulls_last_keys(hosts, "hostname", True, key="endpoint_id")
    return with_ordinal(hosts, order, "place").withColumn("place", F.col("place") + 1)


@register("sort_nulls_last_desc", O.sql("""SELECT a.endpoint_id, a.total_events, p.hostname,
  row_number() OVER (ORDER BY p.hostname DESC NULLS LAST, a.endpoint_id) AS place FROM a6 a
LEFT JOIN endpoints p ON p.endpoint_id = a.endpoint_id""", views=True, endpoints=True))
def q_sort_nulls_last_desc(spark, sf_dir):
    hosts = _hosts_a6(spark, sf_dir)
    order = S.nulls_last_keys(hosts, "hostname", False, key="endpoint_id")
    return with_ordinal(hosts, order, "place").withColumn("place", F.col("place") + 1)


@register("top_endpoints", O.sql("""SELECT endpoint_id, total_events FROM a6 ORDER BY total_events DESC, endpoint_id LIMIT 3""", views=True))
def q_top_endpoints(spark, sf_dir):
    a6 = V.endpoint_details_view(events(spark, sf_dir)).select("endpoint_id", "total_events")
    return S.top_k(a6, 3, "total_events", "endpoint_id")


@register("first_types", O.sql("""SELECT endpoint_id, array_to_string(recent_event_types[1:5], ',') first_types FROM a6""", views=True))
def q_first_types(spark, sf_dir):
    a6 = V.endpoint_details_view(events(spark, sf_dir))
    return a6.select("endpoint_id", F.array_join(S.first_n("recent_event_types", 5), ",").alias("first_types"))


# ------------------------------------------------------------------ set operations


@register("merge_live", O.sql(f"""held AS (SELECT id, "timestamp", endpoint_id, event_type FROM ev2
   WHERE "timestamp" < {O.AS_OF} {_EV_ORDER} LIMIT 20),
fresh AS (SELECT id, "timestamp", endpoint_id, upper(event_type) event_type FROM ev2
   WHERE "timestamp" < {O.AS_OF} + INTERVAL 1 HOUR {_EV_ORDER} LIMIT 20)
SELECT * FROM held UNION ALL SELECT * FROM fresh WHERE id NOT IN (SELECT id FROM held)""".replace("held AS", ", held AS", 1)))
def q_merge_live(spark, sf_dir):
    ev = events(spark, sf_dir).select("id", "timestamp", "endpoint_id", "event_type")
    cut = X.to_ts(AS_OF)
    held = S.latest(ev.where(F.col("timestamp") < cut), 20)
    fresh = S.latest(ev.where(F.col("timestamp") < cut + F.expr("INTERVAL 1 HOUR")), 20).withColumn(
        "event_type", F.upper("event_type")
    )
    return U.merge_live(fresh, held)


@register("union_endpoint_ids", O.sql(f"""SELECT endpoint_id FROM (SELECT endpoint_id FROM ev2 {_EV_ORDER} LIMIT 20)
UNION SELECT endpoint_id FROM (SELECT endpoint_id FROM det {_EV_ORDER} LIMIT 20)""", det=True))
def q_union_endpoint_ids(spark, sf_dir):
    return U.union_ids(S.latest(events(spark, sf_dir), 20), S.latest(detections(spark, sf_dir), 20))


# ------------------------------------------------------------------ lifecycle (L1, L3)


@register("events_retention", O.sql(f"""SELECT {O.EVENTS_COLS} FROM ev2
WHERE CAST(date + INTERVAL 30 DAY AS TIMESTAMP) >= TIMESTAMP '2024-02-01 12:00:00'"""))
def q_events_retention(spark, sf_dir):
    return L.apply_retention(events(spark, sf_dir), 30, "2024-02-01 12:00:00")


@register("detections_retention", O.sql("""SELECT * FROM det
WHERE CAST(date + INTERVAL 90 DAY AS TIMESTAMP) >= TIMESTAMP '2024-04-01 00:00:00'""", det=True))
def q_detections_retention(spark, sf_dir):
    return L.apply_retention(detections(spark, sf_dir), 90, "2024-04-01 00:00:00")


@register("compact_detections", O.sql("SELECT * FROM det", det=True))
def q_compact_detections(spark, sf_dir):
    det = detections(spark, sf_dir)
    return L.compact(det.unionByName(det), "id", "timestamp")


# ------------------------------------------------------------------ views through rollups (M3, M4)
# The streaming upkeep keeps rollups and derives the views from them; over the whole
# table the result must equal the direct views, so they share the same oracles.

from ..streaming import rollups as RU  # noqa: E402


def _rollups(spark, sf_dir):
    ev = events(spark, sf_dir)
    return RU.event_rollup(ev), RU.detection_rollup(detections(spark, sf_dir))


@register("rollup_endpoint_events", ORACLES["endpoint_events"])
def q_rollup_endpoint_events(spark, sf_dir):
    return RU.endpoint_events(RU.event_rollup(events(spark, sf_dir)))


@register("rollup_user_events", ORACLES["user_events"])
def q_rollup_user_events(spark, sf_dir):
    return RU.user_events(RU.event_rollup(events(spark, sf_dir)))


@register("rollup_endpoint_details", ORACLES["endpoint_details_view"])
def q_rollup_endpoint_details(spark, sf_dir):
    a6 = RU.endpoint_details_view(RU.event_rollup(events(spark, sf_dir)))
    return a6.withColumn("recent_event_types", F.array_join("recent_event_types", ","))


@register("rollup_user_details", ORACLES["user_details_view"])
def q_rollup_user_details(spark, sf_dir):
    a7 = RU.user_details_view(RU.event_rollup(events(spark, sf_dir)))
    return a7.withColumn("recent_endpoints", F.array_join("recent_endpoints", ","))


@register("rollup_detection_summary", ORACLES["detection_summary"])
def q_rollup_detection_summary(spark, sf_dir):
    return RU.detection_summary(RU.detection_rollup(detections(spark, sf_dir)))


@register("rollup_endpoint_detections", ORACLES["endpoint_detections"])
def q_rollup_endpoint_detections(spark, sf_dir):
    return RU.endpoint_detections(RU.detection_rollup(detections(spark, sf_dir)))


@register("rollup_user_detections", ORACLES["user_detections"])
def q_rollup_user_detections(spark, sf_dir):
    er, dr = _rollups(spark, sf_dir)
    return RU.user_detections(dr, er)


@register("dashboard_zip_active_endpoints", O.sql(_DASH["active_endpoints"], views=True, endpoints=True))
def q_dashboard_zip_active_endpoints(spark, sf_dir):
    """The section stored as parallel arrays (the reference's snapshot columns),
    zipped back into records by position."""
    snap = _snapshot(spark, sf_dir)
    parallel = snap.select(
        F.transform("active_endpoints", lambda r: r["endpoint_id"]).alias("active_endpoint_ids"),
        F.transform("active_endpoints", lambda r: r["user"]).alias("active_endpoint_users"),
        F.transform("active_endpoints", lambda r: r["event_count"]).alias("active_endpoint_counts"),
    )
    zipped = J.zip_arrays(
        parallel,
        {"endpoint_id": "active_endpoint_ids", "user": "active_endpoint_users", "event_count": "active_endpoint_counts"},
        "records",
    )
    return zipped.select(F.posexplode("records").alias("pos", "r")).select(
        (F.col("pos") + 1).cast("int").alias("rank"), "r.endpoint_id", "r.user", "r.event_count"
    )


# queries that go through stored tables, the stream job and rollups
from . import stored  # noqa: E402, F401
