"""Registered queries that go through the stored tables, the stream job and the rollups.

Each writes the security-event view (or messages made from it) to a scratch folder of the
session's shared checkpoint folder, runs the real operator on it and returns what it left.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.parse import parse_events
from ..operators import lifecycle as L
from ..operators.filters import filter_events
from ..operators.joins import attach_events
from ..functions.parse import parse_events_with_quarantine
from ..operators import sorting as S
from ..operators.rules import FAILED_LOGINS, Rule, RuleRegistry, Step, apply_rules
from ..operators.watchlist import on_watch_list
from ..schema import DETECTION_COLUMNS, DETECTIONS, EVENT_COLUMNS, EVENTS
from ..session import materialize, scratch_table_path
from ..sources.events import load_table, read_event_file, read_raw_events
from ..sources.sinks import export_csv, publish_detections, table_store, write_table
from ..sources.store import Store
from ..streaming import pipeline as P
from ..streaming import rollups as RU
from ..streaming.global_order import GlobalRuleBatches
from . import oracles as O
from . import requests as R
from .catalog import AS_OF, ORACLES, detections, events, register

MESSAGE_FIELDS = [c for c in EVENT_COLUMNS if c not in ("timestamp", "date")]


def messages(ev, **changed):
    """Wire JSON of events, ``changed`` fields replaced."""
    fields = {"timestamp": F.unix_millis("timestamp"), **{c: F.col(c) for c in MESSAGE_FIELDS}} | changed
    return ev.select(F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()])).alias("value"))


# ------------------------------------------------------------------ S3, S4, S6, L1-L3


@register("stored_events", O.sql(f"""SELECT {O.EVENTS_COLS} FROM ev2
WHERE endpoint_id = 'endpoint-3' AND "timestamp" >= TIMESTAMP '2024-01-02 00:00:00' AND "timestamp" <= TIMESTAMP '2024-01-02 12:00:00'"""))
def q_stored_events(spark, sf_dir):
    path = scratch_table_path(spark, "stored-events")
    write_table(events(spark, sf_dir), path, "events")
    stored = load_table(spark, path, "events")
    return filter_events(stored, "endpoint-3", from_="2024-01-02 00:00:00", to="2024-01-02 12:00:00").select(*EVENT_COLUMNS)


@register("stored_expire", O.sql(f"SELECT {O.EVENTS_COLS} FROM ev2"))
def q_stored_expire(spark, sf_dir):
    """The events are also stored as if they were older; those months go."""
    path = scratch_table_path(spark, "stored-expire")
    ev = events(spark, sf_dir)
    old = ev.withColumn("timestamp", F.col("timestamp") - F.expr("INTERVAL 400 DAYS")).withColumn("date", F.to_date("timestamp"))
    write_table(ev.unionByName(old), path, "events")
    L.expire(spark, path, 30, "2024-01-31 00:00:00")
    return L.apply_retention(load_table(spark, path, "events"), 30, "2024-01-31 00:00:00").select(*EVENT_COLUMNS)


@register("stored_compact", O.sql("SELECT * FROM det", det=True))
def q_stored_compact(spark, sf_dir):
    path = scratch_table_path(spark, "stored-compact")
    det = detections(spark, sf_dir)
    for _ in range(2):
        write_table(det, path, "detections")
    months = [r[0] for r in load_table(spark, path, "detections").select("month").distinct().collect()]
    L.compact_months(spark, path, "detections", "id", "timestamp", months)
    return load_table(spark, path, "detections").select(*det.columns)


@register("truncated_events", O.sql("""SELECT 'before' AS state, CAST(month(date) + 100 * year(date) AS INTEGER) AS month, count(*) AS rows FROM ev2 GROUP BY ALL
UNION ALL SELECT 'after', CAST(month(date) + 100 * year(date) AS INTEGER), count(*) FROM ev2 WHERE event_type = 'login' GROUP BY ALL"""))
def q_truncated_events(spark, sf_dir):
    """Rows a month before, and after emptying the table and storing the logins anew."""
    path = scratch_table_path(spark, "truncated")
    write_table(events(spark, sf_dir), path, "events")
    count = lambda state: load_table(spark, path, "events").groupBy("month").agg(F.count("*").alias("rows")).select(F.lit(state).alias("state"), "month", "rows")
    before = count("before")
    L.truncate_tables(spark, {path: "events"})
    write_table(events(spark, sf_dir).where("event_type = 'login'"), path, "events")
    return before.unionByName(count("after"))


# ------------------------------------------------------------------ stream job


def _streamed(spark, sf_dir, scope):
    root = scratch_table_path(spark, f"stream-{scope}")
    ev = events(spark, sf_dir)
    messages(ev).write.text(f"{root}/src")
    # a message from the far future lets the watermark pass every event
    flush = spark.range(1).select(F.lit('{"id":"flush","timestamp":1800000000000,"event_type":"flush","endpoint_id":"flush"}').alias("value"))
    flush.write.mode("append").text(f"{root}/src")
    for q in P.run_pipeline(spark, read_raw_events(spark, f"{root}/src"), f"{root}/out", scope=scope, trigger={"availableNow": True}).values():
        q.awaitTermination()
    return P.Layout(f"{root}/out")


@register("stream_rules_global", O.sql("SELECT * FROM det", det=True))
def q_stream_rules_global(spark, sf_dir):
    layout = _streamed(spark, sf_dir, "global")
    return P.stored(spark, layout.detections, "detections").select(*DETECTION_COLUMNS)


@register("stream_rules_endpoint", O.sql("SELECT * FROM det_ep", det_ep=True))
def q_stream_rules_endpoint(spark, sf_dir):
    layout = _streamed(spark, sf_dir, "endpoint")
    return P.stored(spark, layout.detections, "detections").select(*DETECTION_COLUMNS)


@register("stream_events_stored", O.sql(f"SELECT {O.EVENTS_COLS} FROM ev2"))
def q_stream_events_stored(spark, sf_dir):
    layout = _streamed(spark, sf_dir, "global")
    return P.stored(spark, layout.events, "events").where("id <> 'flush'").select(*EVENT_COLUMNS)


# ------------------------------------------------------------------ rollups in batches (M2, M3)


@register("rollup_incremental", O.sql("SELECT * FROM a3", views=True))
def q_rollup_incremental(spark, sf_dir):
    path = scratch_table_path(spark, "rollup-incremental")
    ev = events(spark, sf_dir)
    for batch in range(4):
        RU.write_partial(RU.event_rollup(ev.where(F.pmod(F.xxhash64("id"), F.lit(4)) == batch)), path, batch)
        RU.compact_rollup(spark, path, batch, "events", every=2)
    return RU.endpoint_events(RU.read_rollup(spark, path, "events"))


# ------------------------------------------------------------------ E1, P4, P5, J4


LARGE_TRANSFER = Rule(
    rule_id="RULE-100", severity=2, description="Large transfer",
    steps=(Step("transfer", lambda e, m: (e["event_type"] == "network") & (e["bytes"] > 5000)),),
    within_ms=1000, endpoint_step="transfer",
    message=lambda m: F.concat(F.lit("Large transfer: "), m["transfer"]["bytes"].cast("string")),
)


@register("rule_large_transfer", O.sql("""SELECT sha256('RULE-100|' || id) AS id, "timestamp", 'RULE-100' AS rule_id, CAST(2 AS INTEGER) AS severity,
  endpoint_id, 'Large transfer: ' || bytes AS description, id AS event_ids, date FROM ev2 WHERE event_type = 'network' AND bytes > 5000"""))
def q_rule_large_transfer(spark, sf_dir):
    return apply_rules(events(spark, sf_dir), [LARGE_TRANSFER])


@register("parse_textual_numbers", O.sql(f"SELECT {O.EVENTS_COLS} FROM ev2"))
def q_parse_textual_numbers(spark, sf_dir):
    """Numbers as text with fractions, booleans and nested values in unused fields."""
    value = messages(
        events(spark, sf_dir),
        bytes=F.concat(F.col("bytes").cast("string"), F.lit(".7")),
        timestamp=F.unix_millis("timestamp").cast("string"),
        extra=F.struct(F.lit(True).alias("a"), F.array(F.lit(1), F.lit(2)).alias("b")),
    )
    return parse_events(value)


@register("detections_full_events", O.sql("""SELECT d.id AS detection_id, e.* FROM (
  SELECT DISTINCT id, unnest(string_split(event_ids, ',')) AS event_id FROM det) d JOIN ev2 e ON e.id = d.event_id""", det=True))
def q_detections_full_events(spark, sf_dir):
    out = attach_events(detections(spark, sf_dir), events(spark, sf_dir))
    return out.select(F.col("id").alias("detection_id"), F.explode("events").alias("e")).select("detection_id", *[F.col(f"e.{c}") for c in EVENT_COLUMNS])


# ------------------------------------------------------------------ stored tables beside streams (L3, M3, T5)

ONCE = {"availableNow": True}
FLUSH = '{"id":"flush","timestamp":1800000000000,"event_type":"flush","endpoint_id":"flush"}'


def _await(*queries):
    for q in queries:
        q.awaitTermination()


def _part(ev, i: int, n: int):
    return ev.where(F.pmod(F.xxhash64("id"), F.lit(n)) == i)


@register("stream_compacted", O.sql(f"SELECT {O.EVENTS_COLS}, CAST(1 AS BIGINT) AS times_followed FROM ev2"))
def q_stream_compacted(spark, sf_dir):
    """The job stores half of the events, the table is compacted, the job goes on after a restart, the
    table is compacted again; a query follows the table all the while.  Returns the table, and how
    often that query saw each row."""
    root = scratch_table_path(spark, "stream-compacted")
    ev, layout = events(spark, sf_dir), P.Layout(f"{root}/out")
    copy = Store(spark, f"{root}/followed", EVENTS, months=False)
    for half in range(2):
        for part in range(2):
            messages(_part(ev, 2 * half + part, 4)).write.mode("append").text(f"{root}/src")
        _await(*P.run_pipeline(spark, read_raw_events(spark, f"{root}/src", maxFilesPerTrigger=8), layout.root, trigger=ONCE).values())
        store = table_store(spark, layout.events, "events")
        _await(store.follow(lambda rows, i: copy.append(rows.select(*EVENT_COLUMNS), i, "copy"), f"{root}/copying", ONCE, commits=1))
        L.compact_months(spark, layout.events, "events", "id", "timestamp", store.months_live())
    seen = copy.read().groupBy("id").agg(F.count("*").alias("times_followed"))
    return load_table(spark, layout.events, "events").select(*EVENT_COLUMNS).join(seen, "id", "left").select(*EVENT_COLUMNS, "times_followed")


@register("stream_replayed", O.sql("SELECT * FROM a3", views=True))
def q_stream_replayed(spark, sf_dir):
    """Every micro-batch of the job is handled twice, and the rollups are kept up between; the view
    still counts each event once."""
    layout = P.Layout(scratch_table_path(spark, "stream-replayed"))
    P.create_tables(spark, layout)
    job = P.Job(layout, GlobalRuleBatches(layout.root, detections=layout.detections))
    for batch in range(4):
        for _ in range(2):
            job(messages(_part(events(spark, sf_dir), batch, 4)), batch)
        _await(*P.start_rollups(spark, layout, trigger=ONCE).values())
    return P.current_views(spark, layout)["endpoint_events"]


# Rows of every 37th event come at the end; those more than the delay behind by then are late.
_HELD = "CAST(substr(id, 5) AS BIGINT) % 37 = 0"
_DELAY_MS = 2 * 3_600_000


@register("stream_disordered", O.sql("SELECT * FROM det", det=True, matched=f"""SELECT * FROM ev2 WHERE NOT ({_HELD}
  AND epoch_ms("timestamp") <= (SELECT max(epoch_ms("timestamp")) FROM ev2 WHERE NOT ({_HELD})) - {_DELAY_MS})"""))
def q_stream_disordered(spark, sf_dir):
    """Many micro-batches, events out of order by up to the delay, then late ones: detections are
    those of the events that were not late, in order."""
    root = scratch_table_path(spark, "stream-disordered")
    layout, ev = P.Layout(f"{root}/out"), events(spark, sf_dir)
    ms = F.unix_millis("timestamp")
    lo, hi = ev.agg(F.min(ms), F.max(ms)).first()
    width = max(1, (hi + _DELAY_MS - lo) // 5 + 1)
    late = F.expr(_HELD)
    arrival = F.floor((ms + F.pmod(F.xxhash64("id"), F.lit(_DELAY_MS)) - lo) / width)
    parts = [messages(ev.where(~late & (arrival == chunk))) for chunk in range(5)]
    parts += [messages(ev.where(late)), spark.range(1).select(F.lit(FLUSH).alias("value"))]
    P.create_tables(spark, layout)
    for part in parts:  # all tasks write files of a part; what is new when the job goes on is its next micro-batch
        part.write.mode("append").text(f"{root}/src")
        _await(P.start_job(read_raw_events(spark, f"{root}/src"), layout, scope="global", trigger=ONCE, delay="2 hours")[0])
    return P.stored(spark, layout.detections, "detections").select(*DETECTION_COLUMNS)


def _served(spark, sf_dir, name):
    """A deployment after some batches: stored tables, rollups, one refresh of the live lists."""
    layout = P.Layout(scratch_table_path(spark, name))
    P.create_tables(spark, layout)
    write_table(events(spark, sf_dir), layout.events, "events")
    write_table(detections(spark, sf_dir), layout.detections, "detections")
    _await(*P.start_rollups(spark, layout, trigger=ONCE).values())
    P.refresh_live(spark, layout, as_of=AS_OF)
    return layout


@register("live_list_events", O.sql(f"""SELECT {O.EVENTS_COLS} FROM ev2 ORDER BY "timestamp" DESC, id LIMIT 20"""))
def q_live_list_events(spark, sf_dir):
    """The live list after a refresh that finds more events than the one before."""
    layout = _served(spark, sf_dir, "live")
    P.refresh_live(spark, layout, as_of=AS_OF)
    return P.live_list(spark, layout.live_events, "events")


@register("live_snapshot", ORACLES["dashboard_totals"])
def q_live_snapshot(spark, sf_dir):
    """M5, Q6: the newest row of the snapshot table."""
    snap = P.newest_snapshot(spark, _served(spark, sf_dir, "snapshot"))
    return snap.select("snapshot_date", "snapshot_hour", "snapshot_minute", "snapshot_timestamp", "total_events", "total_detections")


# ------------------------------------------------------------------ requests on stored tables


def _two_years(spark, sf_dir, name):
    """The events stored with copies of themselves from each of the 23 months before; a write for each, as
    the sort of all at once has 24 times the rows in a task and spills."""
    path, ev = scratch_table_path(spark, name), materialize(events(spark, sf_dir), name)
    for n in range(24):
        back = ev.withColumn("timestamp", F.col("timestamp") - F.make_ym_interval(F.lit(0), F.lit(n)))
        aged = back.withColumn("id", F.concat("id", F.lit(f"-{n}"))).withColumn("date", F.to_date("timestamp")).select(*EVENT_COLUMNS)
        write_table(aged, path, "events")
    return table_store(spark, path, "events")


@register("newest_stored", O.sql(f"""SELECT {O.EVENTS_COLS} FROM (SELECT * REPLACE (id || '-0' AS id) FROM ev2) ORDER BY "timestamp" DESC, id LIMIT 20"""))
def q_newest_stored(spark, sf_dir):
    return R.newest_stored(_two_years(spark, sf_dir, "newest-stored"))


@register("keyset_pages", O.sql(f"""SELECT {O.EVENTS_COLS} FROM ev2 ORDER BY "timestamp" DESC, id LIMIT 40 OFFSET 80"""))
def q_keyset_pages(spark, sf_dir):
    """The third page of 40, reached by the cursor of the page before."""
    ev, cursor = events(spark, sf_dir), None
    for _ in range(2):
        last = S.page_after(ev, S.newest_keys(), cursor, 40).tail(1)
        cursor = (last[0]["timestamp"], last[0]["id"]) if last else cursor
    return S.page_after(ev, S.newest_keys(), cursor, 40)


# ------------------------------------------------------------------ F11 with a long list

_NAME = "process_name || '/' || \"user\" || '/' || id"


@register("watch_list_large", O.sql(f"""SELECT n.id, min(p.pattern) AS watch_pattern FROM (SELECT id, lower({_NAME}) AS name FROM ev2) n
LEFT JOIN (SELECT DISTINCT lower(split_part(c_name, '#', 2))[3:] AS pattern FROM customer
  UNION SELECT unnest(['MIMIKATZ', 'psexec', 'é', 'user-1/', 'x'])) p ON p.pattern <> '' AND contains(n.name, lower(p.pattern)) GROUP BY n.id"""
  .replace("min(p.pattern)", "min(lower(p.pattern))")))
def q_watch_list_large(spark, sf_dir):
    """Names of events against a list with a pattern for each customer."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    numbers = customers.select(F.substring(F.lower(F.split_part("c_name", F.lit("#"), F.lit(2))), 3, 1000).alias("p"))
    listed = numbers.unionByName(spark.createDataFrame([(x,) for x in ("MIMIKATZ", "psexec", "é", "user-1/", "x")], "p string"))
    named = events(spark, sf_dir).select("id", F.concat_ws("/", "process_name", "user", "id").alias("name"))
    return on_watch_list(named, "name", listed).select("id", "watch_pattern")


# ------------------------------------------------------------------ messages and files

_N = "CAST(substr(id, 5) AS BIGINT)"
# one kind of odd message for each remainder; {x} is an SQL text of the field's JSON or null to leave it out
_FIELDS = {
    "id": f"CASE WHEN {_N} % 12 = 7 THEN NULL WHEN {_N} % 24 = 15 THEN 'null' ELSE '\"' || id || '\"' END",
    "timestamp": f"CASE WHEN {_N} % 12 = 6 THEN NULL WHEN {_N} % 24 = 5 THEN '\"' || ms || '.9\"' ELSE ms END",
    "endpoint_id": "'\"' || endpoint_id || '\"'",
    "event_type": f"CASE WHEN {_N} % 12 = 9 THEN '[1, 2]' ELSE '\"' || event_type || '\"' END",
    "status": f"CASE {_N} % 12 WHEN 1 THEN NULL WHEN 10 THEN 'true' ELSE '\"' || status || '\"' END",
    "bytes": f"CASE {_N} % 12 WHEN 5 THEN NULL WHEN 4 THEN '\"' || bytes || '.7\"' WHEN 2 THEN '\"many\"' ELSE CAST(bytes AS {{text}}) END",
    "process_name": f"CASE {_N} % 12 WHEN 3 THEN '{{{{\"a\": 1}}}}' ELSE '\"' || process_name || '\"' END",
    "user": f"CASE {_N} % 12 WHEN 2 THEN 'null' WHEN 11 THEN '5' ELSE '\"' || {{q}}user{{q}} || '\"' END",
}
_DEFAULT_MS = 1704067200000


def _message(text: str, q: str, millis: str, joined) -> str:
    """SQL of a message: its fields joined, cut off in the middle for one remainder."""
    parts = [f"'\"{name}\": ' || ({field.format(text=text, q=q)})" for name, field in _FIELDS.items()]
    body = joined(parts)
    return f"(SELECT *, '{{' || {body} || CASE WHEN {_N} % 12 = 8 THEN '' ELSE '}}' END AS value FROM (SELECT *, CAST({millis} AS {text}) AS ms FROM ev2))"


_PARSED = f"""SELECT CASE WHEN {_N} % 12 = 7 OR {_N} % 24 = 15 THEN 'gen-' || sha256(value) ELSE id END AS id,
  CASE WHEN {_N} % 12 = 6 THEN make_timestamp({_DEFAULT_MS} * 1000) ELSE "timestamp" END AS "timestamp", endpoint_id,
  CASE WHEN {_N} % 12 = 9 THEN '' ELSE event_type END AS event_type, CASE {_N} % 12 WHEN 1 THEN '' WHEN 10 THEN 'true' ELSE status END AS status,
  CASE WHEN {_N} % 12 IN (5, 2) THEN 0 ELSE bytes END AS bytes, CASE WHEN {_N} % 12 = 3 THEN '' ELSE process_name END AS process_name,
  CASE {_N} % 12 WHEN 2 THEN 'null' WHEN 11 THEN '5' ELSE "user" END AS "user", false AS bad
FROM m WHERE {_N} % 12 <> 8
UNION ALL SELECT value, NULL, NULL, NULL, NULL, NULL, NULL, NULL, true FROM m WHERE {_N} % 12 = 8"""


@register("parse_odd_messages", O.sql("").rstrip() + ",\nm AS "
          + _message("VARCHAR", '"', 'epoch_ms("timestamp")', lambda parts: "concat_ws(', ', " + ", ".join(parts) + ")") + "\n" + _PARSED)
def q_parse_odd_messages(spark, sf_dir):
    """Messages with missing, null, nested, textual and cut-off content: events by the coercion table, and the quarantine."""
    sql = _message("STRING", "`", "unix_millis(timestamp)", lambda parts: "concat_ws(', ', " + ", ".join(parts) + ")")
    raw = _messages_of(spark, sf_dir, sql)
    good, bad = parse_events_with_quarantine(raw, default_ts_ms=F.lit(_DEFAULT_MS).cast("bigint"))
    out = good.select("id", "timestamp", "endpoint_id", "event_type", "status", "bytes", "process_name", "user", F.lit(False).alias("bad"))
    return out.unionByName(bad.select(F.col("value").alias("id"), F.lit(True).alias("bad")), allowMissingColumns=True)


def _messages_of(spark, sf_dir, sql):
    name = "tracehound_odd_messages"
    events(spark, sf_dir).createOrReplaceTempView(name)
    return spark.sql(f"SELECT value FROM {sql.replace('FROM ev2', f'FROM {name}')}")


@register("event_file_source", O.sql(f"SELECT {O.EVENTS_COLS} FROM ev2"))
def q_event_file_source(spark, sf_dir):
    """Files of one JSON array each."""
    path = scratch_table_path(spark, "event-files")
    lines = messages(events(spark, sf_dir)).withColumn("file", F.pmod(F.xxhash64("value"), F.lit(7)))
    arrays = lines.groupBy("file").agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ",\n"), F.lit("]")).alias("value"))
    arrays.write.partitionBy("file").text(path)
    return read_event_file(spark, f"{path}/file=*").select(*EVENT_COLUMNS)


_WIRE = "id string, timestamp bigint, ruleId string, severity int, endpointId string, description string, eventIds string"


@register("published_detections", O.sql("""SELECT id, epoch_ms("timestamp") AS "timestamp", rule_id AS "ruleId", severity, endpoint_id AS "endpointId",
  description, event_ids AS "eventIds", CAST(2 AS BIGINT) AS copies FROM det""", det=True))
def q_published_detections(spark, sf_dir):
    """Published twice (at least once); consumers fold the copies by id."""
    path, det = scratch_table_path(spark, "published"), detections(spark, sf_dir)
    for _ in range(2):
        publish_detections(det, path=path)
    wire = spark.read.text(path).select(F.from_json("value", _WIRE).alias("d")).select("d.*")
    return wire.groupBy(*wire.columns).agg(F.count("*").alias("copies"))


@register("exported_csv", O.sql("""SELECT id, "timestamp", rule_id, severity, endpoint_id, description || ', "quoted"' AS description, event_ids, date,
  (SELECT count(*) FROM det) AS lines FROM det""", det=True))
def q_exported_csv(spark, sf_dir):
    """Exported with commas and quotes in a text, and read again; ``lines`` counts the lines without headers."""
    path = scratch_table_path(spark, "csv")
    export_csv(detections(spark, sf_dir).withColumn("description", F.concat("description", F.lit(', "quoted"'))), path)
    lines = spark.read.text(path).where("NOT startswith(value, 'id,timestamp')").agg(F.count("*").alias("lines"))
    back = spark.read.schema(DETECTIONS).option("header", True).option("escape", '"').csv(path)
    return back.withColumn("lines", F.lit(lines.first()[0]))


@register("rules_registry", ORACLES["rule_large_transfer"].replace("FROM ev2 WHERE event_type = 'network' AND bytes > 5000", """FROM ev2 WHERE event_type = 'network' AND bytes > 5000
UNION ALL SELECT * FROM det WHERE rule_id = 'RULE-001'""").replace("ev2 AS (SELECT *, CAST(\"timestamp\" AS DATE) date FROM ev)", "ev2 AS (SELECT *, CAST(\"timestamp\" AS DATE) date FROM ev),\n" + O.DET))
def q_rules_registry(spark, sf_dir):
    """C11: a registry of one of the default rules and one of the user's."""
    registry = RuleRegistry.builder().add(FAILED_LOGINS).add(LARGE_TRANSFER).build()
    return apply_rules(events(spark, sf_dir), registry)
