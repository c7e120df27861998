"""Limits of the engine.  Defaults are fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass

U_MAX = 9223372036854775807  # largest unsigned value that is carried


@dataclass(frozen=True)
class Params:
    window_ms: int = 60_000
    history: int = 5
    baseline_floor: int = 100_000
    spend_min: int = 1_000_000
    multiplier: int = 3
    silence_ms: int = 120_000
    late_ms: int = 120_000
    future_ms: int = 60_000
    vote_ttl_ms: int = 180_000
    quorum: int = 2
    gap: int = 256
    inputs: int = 4096  # records of a manifest
    watchers: int = 16
    lease_ms: int = 30_000  # of a page in flight
    subscription_ms: int = 300_000
    retry_ms: tuple[int, ...] = (1000, 2000, 4000, 8000, 16000, 32000, 60000)


DEFAULT = Params()
