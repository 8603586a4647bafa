"""Parameters of the zone jobs."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Params:
    # Fixed values.
    atr_window: int = 20
    horizon: int = 5
    swing_k: tuple[float, ...] = (0.5, 1.0, 1.5, 2.0)
    swing_window: int = 3
    confirm_most: int = 20
    half_width: float = 0.1
    swing_keep: float = 6.0
    round_multipliers: tuple[int, ...] = (10, 20, 100)
    round_radius: float = 3.0
    cluster_eps: float = 0.5
    zones_per_side: int = 4
    paths: int = 10_000
    lookback: int = 500
    seed: int = 0
    density_eps: float = 0.25
    identity_match: float = 0.25
    breach: float = 0.25
    reaction: float = 0.5
    publish: dict = field(default_factory=lambda: {"p_touch": 0.60, "p_hold": 0.65, "confidence": 0.70, "dq": 0.80, "suppress": 0.7, "event_risk": 0.7})


DEFAULT = Params()
