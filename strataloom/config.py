"""Settings of a session."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass
class Config:
    max_batch_size: int = 10_000
    runtime_id: str | None = None
    default_namespace: str = "default"
    lock_timeout_ms: int = 5_000
    lease_ttl_ms: int = 30_000
    commit_attempts: int = 3
    event_poll_interval_ms: int = 1_000
    event_claim_limit: int = 100
    max_events_per_iteration: int = 1_000
    event_claim_lease_ms: int = 30_000
    event_retention_ms: int = 7 * 24 * 3600 * 1000
    session_heartbeat_interval_ms: int = 5_000
    session_ttl_ms: int = 60_000
    event_max_attempts: int = 10
    event_backoff_base_ms: int = 250
    event_backoff_max_ms: int = 30_000
    max_event_chain_depth: int = 20
    max_commit_chain_depth: int = 16
