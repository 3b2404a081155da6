"""tracehound: security-event analytics on Spark.

Typical use::

    from tracehound import local_session, read_raw_events, parse_events, normalize_events
    from tracehound import apply_rules, RuleRegistry, get_detections, dashboard_snapshot

    events = normalize_events(parse_events(read_raw_events(spark, path, stream=False)))
    detections = apply_rules(events, RuleRegistry.default(), scope="global")
"""

from .functions.parse import normalize_events, parse_events, parse_events_with_quarantine, with_date, with_month
from .operators.filters import filter_detections, filter_events, filter_in, multi_filter, recent_days, recent_hours
from .operators.joins import add_hostnames, attach_events
from .operators.ordinal import next_rows, with_ordinal
from .operators.rules import FAILED_LOGINS, FILE_WRITE_EXECUTE, SUSPICIOUS_PROCESS_NETWORK, Rule, RuleRegistry, Step, apply_rules
from .operators.views import latest_by_key, merge_partials
from .plans.dashboard import dashboard_snapshot, dashboard_stats
from .plans.requests import (
    endpoint_details,
    get_detections,
    get_events,
    list_endpoints,
    list_users,
    live_detections,
    live_events,
    user_details,
)
from .session import configure, local_session
from .sources.events import load_table, read_event_file, read_raw_events
from .sources.sinks import export_csv, publish_detections, write_detections, write_events

__all__ = [
    "FAILED_LOGINS", "FILE_WRITE_EXECUTE", "SUSPICIOUS_PROCESS_NETWORK", "Rule", "RuleRegistry", "Step",
    "add_hostnames", "apply_rules", "attach_events", "configure", "dashboard_snapshot",
    "dashboard_stats", "endpoint_details", "export_csv", "filter_detections", "filter_events", "filter_in",
    "get_detections", "get_events", "latest_by_key", "list_endpoints", "list_users", "live_detections",
    "live_events", "load_table", "local_session", "merge_partials", "multi_filter", "next_rows",
    "normalize_events", "parse_events", "parse_events_with_quarantine", "publish_detections", "read_event_file",
    "read_raw_events", "recent_days", "recent_hours", "user_details", "with_date", "with_month", "with_ordinal",
    "write_detections", "write_events",
]
