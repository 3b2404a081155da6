"""DuckDB SQL for the correctness gate.

Each registered query in ``__spark_entry__`` has an independent SQL statement here that
DuckDB runs over the driver's parquet views.  The statements share CTE fragments: the
security-event view (``ev``), the rule matches (``det`` / ``det_ep``) and the store's
summary views.  They are written from the operator definitions, not generated from the
Spark plans, so a mismatch points at a real difference.
"""

from __future__ import annotations

AS_OF = "TIMESTAMP '2024-01-03 12:00:00'"

# security-event view over the driver's ``events`` table (FIXTURES.md §2)
EV = """
e AS (SELECT event_id, user_id, event_type et, value, ts,
             CAST(json_extract_string(props,'$.k') AS BIGINT) k FROM events),
t AS (SELECT *, CASE WHEN et='click' THEN 'process' WHEN et='view' THEN 'network'
        WHEN et='signup' THEN 'file' WHEN et='error' OR k<70 THEN 'login'
        WHEN k<85 THEN 'dns' ELSE 'registry' END event_type FROM e),
ev AS (
SELECT 'evt-'||lpad(CAST(event_id AS VARCHAR),9,'0') id,
  make_timestamp((1704067200000 + (epoch_us(ts)-1704067200000000)//10000)*1000) "timestamp",
  'endpoint-'||CAST(CASE WHEN event_type='login' THEN (event_id//8)%10 ELSE user_id%10 END AS VARCHAR) endpoint_id,
  event_type,
  CASE WHEN event_type='file' THEN (CASE WHEN k%4=0 THEN 'success' ELSE 'write' END)
       WHEN event_type='process' THEN (CASE WHEN k%5=0 THEN 'blocked' ELSE 'success' END)
       WHEN event_type='login' THEN (CASE WHEN k%6=0 THEN 'success' ELSE 'failed' END)
       ELSE 'allowed' END status,
  CASE WHEN event_type='network' THEN (CASE WHEN k%4=0 THEN 'inbound' ELSE 'outbound' END) ELSE '' END direction,
  CASE WHEN event_type='network' THEN CAST(floor(value*100) AS BIGINT) ELSE 0 END bytes,
  '' source_ip, '' destination_ip,
  CASE WHEN event_type IN ('process','network','file')
       THEN (CASE k%3 WHEN 0 THEN 'mimikatz.exe' WHEN 1 THEN 'chrome.exe' ELSE 'cmd.exe' END) ELSE '' END process_name,
  CASE WHEN user_id%7=0 AND event_type<>'login' THEN ''
       ELSE 'user-'||CAST(CASE WHEN event_type='login' THEN (event_id//8)%13 ELSE user_id%13 END AS VARCHAR) END "user"
FROM t),
ev2 AS (SELECT *, CAST("timestamp" AS DATE) date FROM ev)"""

EVENTS_COLS = (
    'id, "timestamp", endpoint_id, event_type, status, direction, bytes, source_ip, '
    'destination_ip, process_name, "user", date'
)

_LEAD_FIELDS = (
    ("id", "id"),
    ("ts_ms", "ms"),
    ('"timestamp"', "t"),
    ("endpoint_id", "ep"),
    ("event_type", "et"),
    ("status", "st"),
    ("direction", "dir"),
    ("process_name", "pn"),
    ('"user"', "u"),
)


def _nx(name: str, partition: str) -> str:
    leads = ",\n  ".join(
        f"lead({col},{i}) OVER w AS {alias}{i}" for i in (1, 2) for col, alias in _LEAD_FIELDS
    )
    return f"""{name} AS (SELECT *,
  {leads}
 FROM (SELECT *, epoch_ms("timestamp") ts_ms FROM ev2)
 WINDOW w AS ({partition}ORDER BY ts_ms, id))"""


def _det(name: str, nx: str) -> str:
    suspicious = " OR ".join(
        f"lower(process_name) LIKE '%{p}%'"
        for p in ("mimikatz", "psexec", "powershell.exe", "cmd.exe", "rundll32.exe")
    )
    return f"""{name}_m AS (
 SELECT 'RULE-001' rule_id, 3 severity, endpoint_id,
   'Multiple failed login attempts for user: '||"user" description,
   id||','||id1||','||id2 event_ids, t2 "timestamp"
 FROM {nx} WHERE event_type='login' AND status='failed'
   AND et1='login' AND st1='failed' AND u1="user" AND ep1=endpoint_id
   AND et2='login' AND st2='failed' AND u2="user" AND ep2=endpoint_id
   AND ms2-ts_ms < 300000
 UNION ALL
 SELECT 'RULE-002', 4, endpoint_id,
   'Suspicious process with network activity: '||process_name,
   id||','||id1, t1
 FROM {nx} WHERE event_type='process' AND ({suspicious})
   AND et1='network' AND dir1='outbound' AND pn1=process_name AND ms1-ts_ms < 60000
 UNION ALL
 SELECT 'RULE-003', 5, ep1,
   'File written then executed: '||process_name,
   id||','||id1, t1
 FROM {nx} WHERE event_type='file' AND status='write'
   AND et1='process' AND st1='success' AND pn1=process_name AND ms1-ts_ms < 300000),
{name} AS (SELECT sha256(rule_id||'|'||event_ids) id, "timestamp", rule_id,
   CAST(severity AS INTEGER) severity, endpoint_id, description, event_ids,
   CAST("timestamp" AS DATE) date FROM {name}_m)"""


DET = _nx("nx", "") + ",\n" + _det("det", "nx")
DET_EP = _nx("nxe", "PARTITION BY endpoint_id ") + ",\n" + _det("det_ep", "nxe")

# summary views
VIEWS = """
a2 AS (SELECT endpoint_id, date, count(DISTINCT rule_id) unique_rules,
         count(*) detection_count, max(severity) max_severity
       FROM det GROUP BY endpoint_id, date),
a3 AS (SELECT endpoint_id, date, event_type, count(*) event_count,
         min("timestamp") first_seen, max("timestamp") last_seen, count(DISTINCT "user") unique_users
       FROM ev2 GROUP BY endpoint_id, date, event_type),
a4 AS (SELECT "user", date, event_type, count(*) event_count,
         min("timestamp") first_seen, max("timestamp") last_seen, count(DISTINCT endpoint_id) unique_endpoints
       FROM ev2 WHERE "user" <> '' GROUP BY "user", date, event_type),
a5 AS (SELECT p."user", d.date, d.severity, d.rule_id, count(*) detection_count
       FROM det d JOIN (SELECT DISTINCT "user", endpoint_id FROM ev2 WHERE "user" <> '') p
         ON d.endpoint_id = p.endpoint_id
       GROUP BY p."user", d.date, d.severity, d.rule_id),
a6 AS (SELECT endpoint_id, first("user" ORDER BY "timestamp", "user") primary_user,
         max("timestamp") last_seen, count(*) total_events,
         count(DISTINCT event_type) unique_event_types, count(DISTINCT "user") unique_users,
         list_sort(list_distinct(list(event_type)))[1:10] recent_event_types
       FROM ev2 GROUP BY endpoint_id),
a7 AS (SELECT "user", max("timestamp") last_seen, count(*) total_events,
         count(DISTINCT event_type) unique_event_types, count(DISTINCT endpoint_id) unique_endpoints,
         list_sort(list_distinct(list(endpoint_id)))[1:10] recent_endpoints
       FROM ev2 WHERE "user" <> '' GROUP BY "user")"""

# the endpoints lookup rows of the fixture (endpoint-0..7)
ENDPOINTS = """
endpoints AS (SELECT 'endpoint-'||CAST(i AS VARCHAR) endpoint_id, 'host-'||CAST(i AS VARCHAR) hostname,
   '10.0.0.'||CAST(i+1 AS VARCHAR) ip, CASE WHEN i%2=0 THEN 'windows' ELSE 'linux' END os,
   make_timestamp((1704067200000 + i*3600000)*1000) last_seen FROM range(8) r(i))"""


def sql(body: str, *, det: bool = False, det_ep: bool = False, views: bool = False, endpoints: bool = False, matched: str | None = None) -> str:
    """``matched``: a query for the events that the rules see, all of ``ev2`` if not given."""
    parts = [EV]
    if matched is not None:
        parts.append(f"ev3 AS ({matched})")
    if det or views:
        parts.append(DET if matched is None else DET.replace("FROM ev2", "FROM ev3"))
    if det_ep:
        parts.append(DET_EP)
    if views:
        parts.append(VIEWS)
    if endpoints:
        parts.append(ENDPOINTS)
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n" + body.strip()
