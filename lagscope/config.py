"""Thresholds, enumerations and names used by every operator."""

from __future__ import annotations

from dataclasses import dataclass

# Wire names of the lag classes.
GROWING = "GROWING_LAG"
STALLED = "STALLED_CONSUMER"
CATCHUP = "CATCHUP_IN_PROGRESS"
HERD = "THUNDERING_HERD"
SINGLE_STALL = "SINGLE_PARTITION_STALL"
HEALTHY = "HEALTHY"

# Score multiplier of each lag class.
CLASS_MULTIPLIER = {
    GROWING: 1.5,
    STALLED: 2.0,
    SINGLE_STALL: 1.8,
    HERD: 1.2,
    CATCHUP: 0.5,
    HEALTHY: 0.0,
}

# Enumerations of a recommendation and of a severity.
RECOMMENDATION_TYPES = (
    "CONSUMER_RESTART",
    "CONSUMER_SCALE_OUT",
    "PARTITION_REBALANCE",
    "TOPIC_PARTITION_INCREASE",
    "BROKER_SCALE",
    "MESSAGE_SKIP",
    "CONFIG_CHANGE",
    "PREFERRED_REPLICA_ELECTION",
    "BROKER_HEALTH_CHECK",
)
PRIORITIES = ("IMMEDIATE", "WITHIN_15MIN", "WITHIN_1HOUR", "ADVISORY")
RISK_LEVELS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
GROUNDINGS = ("RUNBOOK", "HISTORICAL_INCIDENT", "HEURISTIC_ONLY")
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")

# Topic-name prefixes left out of lag analysis, and of cluster scans.
LAG_EXCLUDED_PREFIXES = ("__", "kafka.ops")
SCAN_EXCLUDED_PREFIXES = ("__",)

# Topics that analysis events are published to.
ANALYSIS_TOPIC = "kafka.ops.analysis.completed"
RECOMMENDATION_TOPIC = "kafka.ops.scaling.recommended"
DEAD_LETTER_TOPIC = "dead.letter.queue"

# Lag classes a runbook can be tagged with, and the tag of an untagged one.
RUNBOOK_KEYWORDS = (GROWING, STALLED, SINGLE_STALL, HERD, CATCHUP)
DEFAULT_TAGS = (GROWING,)


@dataclass(frozen=True)
class Thresholds:
    """Every tunable of the lag, health and alert operators, with the usual defaults.

    ``bucket_seconds`` is not part of any result: it is the length of the time slices
    that windows are split into, so that one busy key is spread over many tasks. Nor is
    ``shuffle_tasks``: the number of tasks that whole rows are dealt to, for more rows than the
    session's shuffle partitions can take (``session.tasks_for``).
    """

    stall_seconds: int = 600
    history_seconds: int = 600
    min_elapsed_seconds: float = 30.0
    skew_factor: float = 5.0
    catchup_velocity: float = -100.0
    growing_velocity: float = 500.0
    herd_lag: int = 50_000
    herd_velocity: float = 50.0
    problem_factor: float = 3.0
    score_ceiling: int = 1_000_000
    medium_score: float = 0.2
    high_score: float = 0.4
    critical_score: float = 0.7
    imbalance_share: float = 0.40
    hotspot_factor: float = 3.0
    hotspot_cleared_factor: float = 2.0
    fair_share_tolerance: float = 0.10
    escalation_lag: int = 500_000
    escalation_seconds: int = 900
    dedup_ttl_seconds: int = 600
    drop_zero_lag_history: bool = False
    bucket_seconds: int = 86_400
    shuffle_tasks: int | None = None


DEFAULTS = Thresholds()
