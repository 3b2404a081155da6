"""Event-sequence rules with strict contiguity (``next``) and a time limit (``within``).

A rule is a list of named steps.  Step ``i`` must be the event that immediately follows
step ``i-1`` in the stream order ``(timestamp, id)``; each step has a condition on its
own event and on the events matched by earlier steps; the last step must lie strictly
less than ``within_ms`` after the first.  There is no skipping after a match, so every
event starts its own attempt (four failed logins give two RULE-001 matches).

Batch evaluation attaches the next ``K-1`` events of every event once for all rules
(:func:`tracehound.operators.ordinal.next_rows`, exact and skew-proof); every rule is a
Column expression over those structs, hits are collected into an array per event and
exploded.  No Python runs per row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import is_suspicious_process
from ..schema import DETECTION_COLUMNS
from ..session import materialize as write_and_read
from .ordinal import next_rows, next_rows_single_window

# fields of an event a rule may look at: all of them
MATCH_FIELDS = (
    "id",
    "ts_ms",
    "timestamp",
    "endpoint_id",
    "event_type",
    "status",
    "direction",
    "bytes",
    "source_ip",
    "destination_ip",
    "process_name",
    "user",
)

Cond = Callable[[Column, dict[str, Column]], Column]


@dataclass(frozen=True)
class Step:
    """One named step; ``cond(event, earlier)`` gets the step's event struct and a map
    of the structs matched by earlier steps (by step name)."""

    name: str
    cond: Cond


@dataclass(frozen=True)
class Rule:
    rule_id: str
    severity: int
    description: str
    steps: tuple[Step, ...]
    within_ms: int
    endpoint_step: str
    message: Callable[[dict[str, Column]], Column]
    cite: tuple[str, ...] | None = None  # steps whose events are listed; all of them if None

    def __post_init__(self):
        if not 1 <= self.severity <= 5:
            raise ValueError("severity must be 1..5")
        if not self.steps:
            raise ValueError("a rule needs at least one step")
        if self.endpoint_step not in {s.name for s in self.steps}:
            raise ValueError(f"unknown endpoint step {self.endpoint_step!r}")
        if self.cite is not None and not set(self.cite) <= {s.name for s in self.steps}:
            raise ValueError(f"unknown cited step in {self.cite!r}")

    def citing(self, *steps: str) -> "Rule":
        """The same rule listing only the events of the named steps."""
        return replace(self, cite=steps)


@dataclass
class RuleRegistry:
    rules: list[Rule] = field(default_factory=list)

    @staticmethod
    def builder() -> "RuleRegistry":
        return RuleRegistry()

    def add(self, rule: Rule) -> "RuleRegistry":
        self.rules.append(rule)
        return self

    def build(self) -> "RuleRegistry":
        ids = [r.rule_id for r in self.rules]
        if len(ids) != len(set(ids)):
            raise ValueError("duplicate rule id")
        return self

    @staticmethod
    def default() -> "RuleRegistry":
        return RuleRegistry([FAILED_LOGINS, SUSPICIOUS_PROCESS_NETWORK, FILE_WRITE_EXECUTE])

    @property
    def max_steps(self) -> int:
        return max((len(r.steps) for r in self.rules), default=0)


# ---------------------------------------------------------------- the three rules


def _is(e: Column, event_type: str, status: str | None = None, direction: str | None = None) -> Column:
    cond = e["event_type"] == event_type
    if status is not None:
        cond = cond & (e["status"] == status)
    if direction is not None:
        cond = cond & (e["direction"] == direction)
    return cond


def _same_user_endpoint(e: Column, first: Column) -> Column:
    return (
        first["user"].isNotNull()
        & e["user"].isNotNull()
        & (first["user"] == e["user"])
        & (first["endpoint_id"] == e["endpoint_id"])
    )


def _same_process(e: Column, earlier: Column) -> Column:
    return earlier["process_name"].isNotNull() & (earlier["process_name"] == e["process_name"])


def _text(c: Column) -> Column:
    # string concatenation of a missing value prints "null"
    return F.coalesce(c, F.lit("null"))


# Fixed values of the three rules: ids, severities, descriptions, limits and messages.
FAILED_LOGINS = Rule(
    rule_id="RULE-001",
    severity=3,
    description="Multiple failed login attempts detected",
    steps=(
        Step("first", lambda e, m: _is(e, "login", "failed")),
        Step("second", lambda e, m: _is(e, "login", "failed") & _same_user_endpoint(e, m["first"])),
        Step("third", lambda e, m: _is(e, "login", "failed") & _same_user_endpoint(e, m["first"])),
    ),
    within_ms=5 * 60 * 1000,
    endpoint_step="first",
    message=lambda m: F.concat(
        F.lit("Multiple failed login attempts for user: "),
        F.coalesce(m["first"]["user"], F.lit("unknown")),
    ),
)

SUSPICIOUS_PROCESS_NETWORK = Rule(
    rule_id="RULE-002",
    severity=4,
    description="Suspicious process with network activity",
    steps=(
        Step("process", lambda e, m: _is(e, "process") & is_suspicious_process(e["process_name"])),
        Step("network", lambda e, m: _is(e, "network", direction="outbound") & _same_process(e, m["process"])),
    ),
    within_ms=60 * 1000,
    endpoint_step="process",
    message=lambda m: F.concat(
        F.lit("Suspicious process with network activity: "), _text(m["process"]["process_name"])
    ),
)

FILE_WRITE_EXECUTE = Rule(
    rule_id="RULE-003",
    severity=5,
    description="File written then executed",
    steps=(
        Step("fileWrite", lambda e, m: _is(e, "file", "write")),
        Step("fileExecute", lambda e, m: _is(e, "process", "success") & _same_process(e, m["fileWrite"])),
    ),
    within_ms=5 * 60 * 1000,
    endpoint_step="fileExecute",
    message=lambda m: F.concat(
        F.lit("File written then executed: "), _text(m["fileWrite"]["process_name"])
    ),
)


# ---------------------------------------------------------------- evaluation


def prepare_events(events: DataFrame) -> DataFrame:
    """Project the fields rules read and add epoch milliseconds."""
    return events.select(
        *[c for c in MATCH_FIELDS if c != "ts_ms"], F.unix_millis("timestamp").alias("ts_ms")
    )


def _rule_hit(rule: Rule, steps_structs: list[Column]) -> Column:
    """Struct of the detection if ``rule`` matches starting at the current event, else null."""
    matched: dict[str, Column] = {}
    cond = None
    for step, ev in zip(rule.steps, steps_structs):
        c = ev.isNotNull() & step.cond(ev, dict(matched))
        cond = c if cond is None else cond & c
        matched[step.name] = ev
    first = steps_structs[0]
    last = steps_structs[len(rule.steps) - 1]
    cond = cond & ((last["ts_ms"] - first["ts_ms"]) < F.lit(rule.within_ms))
    cited = [s.name for s in rule.steps if rule.cite is None or s.name in rule.cite]
    event_ids = F.concat_ws(",", *[matched[name]["id"] for name in cited])
    detection = F.struct(
        F.sha2(F.concat(F.lit(rule.rule_id + "|"), event_ids), 256).alias("id"),
        last["timestamp"].alias("timestamp"),
        F.lit(rule.rule_id).alias("rule_id"),
        F.lit(rule.severity).cast("int").alias("severity"),
        matched[rule.endpoint_step]["endpoint_id"].alias("endpoint_id"),
        rule.message(matched).alias("description"),
        event_ids.alias("event_ids"),
    )
    return F.when(F.coalesce(cond, F.lit(False)), detection)


def apply_rules(
    events: DataFrame,
    registry: RuleRegistry | Sequence[Rule] | None = None,
    scope: str = "global",
    strategy: str = "ordinal",
    num_partitions: int | None = None,
    materialize: bool = False,
) -> DataFrame:
    """Run every rule over ``events``; one row per match with the detections schema.

    ``scope="global"``: "next" is the next event of the whole stream (reference
    meaning).  ``scope="endpoint"``: the next event of the same endpoint.
    ``strategy="ordinal"`` is the scalable exact form; ``"single"`` is a plain window
    (one task for the global scope), kept to prove the two equal in tests.
    ``materialize=True`` writes the detections (a small table) once to the shared
    checkpoint folder so plans that read them several times do not recompute the rules.
    """
    if registry is None:
        registry = RuleRegistry.default()
    rules = registry.rules if isinstance(registry, RuleRegistry) else list(registry)
    spark = events.sparkSession
    if not rules:
        return spark.createDataFrame([], _detections_struct_schema())
    if scope not in ("global", "endpoint"):
        raise ValueError("scope must be 'global' or 'endpoint'")
    k = max(len(r.steps) for r in rules) - 1
    part = ("endpoint_id",) if scope == "endpoint" else ()
    prepared = prepare_events(events)
    payload = [c for c in MATCH_FIELDS]
    order = ("ts_ms", "id")
    if k == 0:
        with_next = prepared
    elif strategy == "single":
        with_next = next_rows_single_window(prepared, order, k, payload, part, prefix="_n")
    elif strategy == "ordinal":
        with_next = next_rows(prepared, order, k, payload, part, prefix="_n", num_partitions=num_partitions)
    else:
        raise ValueError("strategy must be 'ordinal' or 'single'")
    current = F.struct(*[F.col(c) for c in payload])
    structs = [current] + [F.col(f"_n{i}") for i in range(1, k + 1)]
    hits = F.array(*[_rule_hit(r, structs) for r in rules])
    out = (
        with_next.select(F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("d"))
        .select("d.*")
        .withColumn("date", F.to_date("timestamp"))
    )
    out = out.select(*DETECTION_COLUMNS)
    if materialize:
        out = write_and_read(out, "detections")
    return out


def _detections_struct_schema():
    from ..schema import DETECTIONS

    return DETECTIONS
