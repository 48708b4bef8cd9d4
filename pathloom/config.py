"""Settings of the operators."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class FoldConfig:
    """bounds: inclusive upper bounds of the numeric buckets; field_bounds: other bounds under a key; gaps in milliseconds."""

    bounds: tuple[int, ...] = (0, 1, 10, 100, 1000)
    field_bounds: dict[str, tuple[int, ...]] = field(default_factory=dict)
    burst_gap_ms: int = 50
    idle_gap_ms: int = 5000


@dataclass(frozen=True)
class HeuristicsConfig:
    dependency_threshold: float = 0.5
    min_frequency: int = 1


@dataclass(frozen=True)
class InductiveConfig:
    min_count: int = 1
    #: Distinct commands, and pairs of them that follow each other, which the driver may hold of one level of the tree;
    #: beyond this the miner refuses.
    max_commands: int = 100_000
    max_edges: int = 4_000_000


@dataclass(frozen=True)
class ReportConfig:
    top_n: int = 20
    rare_support: float = 0.01
    error_rate: float = 0.05
    dead_floor: float = 0.01
    #: Rare failing patterns that are listed, the worst first; None lists all, of which there can be two to the power of
    #: a session's actions.
    rare_n: int | None = 1000
    min_support: int = 1
    #: None: patterns of any length.
    max_length: int | None = None


@dataclass(frozen=True)
class ScoreConfig:
    """Differential scoring: pairs seen more than min_normal times, scores of at least keep."""

    min_normal: int = 5
    keep: float = 0.67
