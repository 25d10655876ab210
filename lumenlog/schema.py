"""Tables' schemas, the six criteria and the parameters' defaults."""

from __future__ import annotations

from dataclasses import dataclass, fields
from typing import Any

from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

#: Criteria by id.
CRITERIA = {1: "it_security", 2: "performance_degradation", 3: "failure_prediction", 4: "anomaly", 5: "compliance_audit", 6: "operational_risk"}


def _struct(**kinds) -> StructType:
    return StructType([StructField(n, k()) for n, k in kinds.items()])


EVENT = _struct(
    id=StringType, system_id=LongType, log_source_id=LongType, timestamp=TimestampType, received_at=TimestampType, message=StringType, severity=StringType, host=StringType, source_ip=StringType, service=StringType,
    facility=StringType, program=StringType, trace_id=StringType, span_id=StringType, raw=StringType, normalized_hash=StringType, external_id=StringType, connector_id=StringType, acknowledged_at=TimestampType, template_id=StringType, scored_at=TimestampType,
)
EVENT_SCORE = _struct(event_id=StringType, criterion_id=IntegerType, score=DoubleType, score_type=StringType)
WINDOW = _struct(system_id=LongType, from_ts=TimestampType, to_ts=TimestampType, trigger=StringType)
TEMPLATE = _struct(pattern_hash=StringType, system_id=LongType, template_text=StringType, first_seen=TimestampType, last_seen=TimestampType, occurrence_count=LongType)
FINDING = _struct(
    id=LongType, system_id=LongType, text=StringType, severity=StringType, criterion_slug=StringType, status=StringType, fingerprint=StringType, occurrence_count=LongType, consecutive_misses=IntegerType, created_at=TimestampType, last_seen_at=TimestampType,
)
NORMAL_TEMPLATE = _struct(id=LongType, system_id=LongType, pattern_regex=StringType, host_pattern=StringType, program_pattern=StringType, enabled=BooleanType)


@dataclass(frozen=True)
class Settings:
    """Every parameter, with the values that the pipeline uses."""

    window_minutes: int = 5
    w_meta: float = 0.7
    w_meta_recalc: float = 0.7
    score_days: int = 7
    unscored_hours: int = 48
    score_limit: int = 5000
    scoring_message_chars: int = 512
    ingest_message_chars: int = 8192
    cache_ttl_minutes: int = 360
    low_score_threshold: float = 0.0
    low_score_least_count: int = 5
    skip_severities: tuple[str, ...] = ("debug",)
    finding_threshold: float = 0.5
    max_new_findings: int = 5
    max_open_findings: int = 50
    recurring_days: int = 14
    alert_min_score: float = 0.75
    alert_throttle_seconds: int = 0
    retention_days: int = 90
    future_drift_seconds: int = 300
    watermark: str = "48 hours"

    @classmethod
    def merged(cls, *overrides: dict[str, Any] | None) -> Settings:
        """Defaults with the given values laid over, later ones first; unknown keys and nulls are passed over."""
        known = {f.name for f in fields(cls)}
        values: dict[str, Any] = {}
        for o in overrides:
            values |= {k: v for k, v in (o or {}).items() if k in known and v is not None}
        return cls(**values)
