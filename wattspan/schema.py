"""Schemas of spans and findings, enumerations in their order, and detection thresholds."""

from __future__ import annotations

from dataclasses import dataclass

SOURCE = "struct<endpoint:string,method:string>"
GROUPING = "array<struct<key:string,value:string>>"
CODE = "struct<function:string,filepath:string,lineno:int,namespace:string>"
SPANS = (
    "timestamp string, trace_id string, span_id string, parent_span_id string, link_trace_id string, service string, "
    f"grouping {GROUPING}, cloud_region string, event_type string, operation string, target string, duration_us long, source {SOURCE}, "
    f"status_code int, response_size_bytes long, code {CODE}, instrumentation_scopes array<string>"
)

# Names of event types, finding types and severities, in the order in which findings are sorted.
EVENT_TYPES = ("sql", "http_out", "messaging")
FINDING_TYPES = (
    "n_plus_one_sql", "n_plus_one_http", "n_plus_one_messaging", "redundant_sql", "redundant_http", "slow_sql", "slow_http", "slow_messaging",
    "excessive_fanout", "chatty_service", "pool_saturation", "serialized_calls",
)
SEVERITIES = ("critical", "warning", "info")
CONFIDENCES = ("ci_batch", "daemon_staging", "daemon_production", "unknown")
#: Finding types whose repeated calls count as avoidable I/O.
AVOIDABLE = ("n_plus_one_sql", "n_plus_one_http", "n_plus_one_messaging", "redundant_sql", "redundant_http")


@dataclass(frozen=True)
class Thresholds:
    """Defaults of the detectors; every detector also takes its own as keyword arguments."""

    n_plus_one: int = 5
    window_ms: int = 500
    slow_ms: int = 500
    slow_min: int = 3
    fanout: int = 20
    chatty: int = 15
    pool: int = 10
    serialized: int = 3
    sanitizer: str = "auto"
