"""Schemas, settings and results. Points are one DataFrame; everything that the server holds is small and lives on the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: The name of the numerical map that results belong to; change it with any change of results.
MAP_VERSION = "fairspark-1"
POINTS = T.StructType([T.StructField("client", T.LongType(), False), T.StructField("local_row", T.LongType(), False), T.StructField("group_id", T.IntegerType(), False), T.StructField("features", T.ArrayType(T.DoubleType(), False), False)])
SLICES = "client long, group_id int, slot int, selected_idx long, rep array<double>, anchor array<double>, mult long, k_e int, n_e long"
REMOVED = "client long, local_row long"


def whole(value, name: str, low: int, high: int | None = None) -> int:
    """An integer in range; booleans are not integers."""
    if isinstance(value, bool) or not hasattr(value, "__index__") or type(value).__name__ == "bool_":
        raise ValueError(f"{name} must be an integer")
    value = value.__index__()
    if value < low or high is not None and value > high:
        raise ValueError(f"{name} is out of range")
    return value


@dataclass(frozen=True)
class Grid:
    """Coordinates are clipped to [-clip, clip] and rounded half to even to multiples of 2**-bits."""

    bits: int = 12
    clip: float = 8.0

    def __post_init__(self):
        most = 2.0**52 / (1 << whole(self.bits, "bits", 0, 30))  # doubles hold every encoded coordinate exactly
        if not 0 < self.clip <= most:
            raise ValueError(f"clip must be over 0 and at most {most:g} at {self.bits} bits")

    @property
    def scale(self) -> int:
        return 1 << self.bits

    @property
    def largest(self) -> int:
        return round(self.clip * self.scale)

    def safe_rows(self, d: int, largest: int | None = None) -> int:
        """Rows whose sum of squared norms stays below 2**59; raises if one row does not."""
        return safe_rows(whole(d, "dimension", 1, 4096), self.largest if largest is None else largest)


def safe_rows(d: int, largest: int) -> int:
    worst = d * largest * largest
    if d < 1 or largest < 0 or worst > 1 << 59:
        raise ValueError("unsafe range of squares")
    return (1 << 59) // max(worst, 1)


@dataclass(frozen=True)
class Settings:
    """k centers, `rounds` of refinement, `groups` protected groups.

    bisections: candidates of the two-group update. steps, line_bits: Frank-Wolfe of the many-group update, used if
    groups > 2 or many_groups is set. gamma: grid of the anchors sent to the server, 0 for none.
    """

    k: int = 10
    rounds: int = 0
    groups: int = 2
    bisections: int = 6
    gamma: float = 0.0
    grid: Grid = field(default_factory=Grid)
    anchor_rounds: int = 0
    many_groups: bool = False
    steps: int = 12
    line_bits: int = 6

    def __post_init__(self):
        for name, low, high in (("k", 1, None), ("rounds", 0, None), ("groups", 2, None), ("bisections", 0, 256), ("anchor_rounds", 0, None), ("steps", 0, 256), ("line_bits", 0, 32)):
            whole(getattr(self, name), name, low, high)
        if not math.isfinite(self.gamma) or self.gamma < 0:
            raise ValueError("gamma must be finite and not negative")

    @property
    def frank_wolfe(self) -> bool:
        return self.many_groups or self.groups > 2


Center = tuple[float, ...]


@dataclass
class Stats:
    """Exact counts, vector sums and sums of squared norms by group and cluster, dense."""

    n: list[list[int]]
    s: list[list[list[int]]]
    ss: list[list[int]]

    @staticmethod
    def zero(groups: int, k: int, d: int) -> Stats:
        return Stats([[0] * k for _ in range(groups)], [[[0] * d for _ in range(k)] for _ in range(groups)], [[0] * k for _ in range(groups)])

    def plus(self, other: Stats, sign: int = 1) -> Stats:
        pair = lambda a, b: [x + sign * y for x, y in zip(a, b, strict=True)]
        return Stats([pair(a, b) for a, b in zip(self.n, other.n, strict=True)], [[pair(x, y) for x, y in zip(a, b, strict=True)] for a, b in zip(self.s, other.s, strict=True)], [pair(a, b) for a, b in zip(self.ss, other.ss, strict=True)])


@dataclass
class Anchors:
    """The server's input in the order of client, group and slot; the weight of a row is exact."""

    owner: list[tuple[int, int, int]]
    rows: list[Center]
    weights: list[Fraction]


@dataclass
class Model:
    """A trained or replayed model. cache: one DataFrame for each round with assignments and distance bounds, None if not kept."""

    settings: Settings
    seed: int
    sizes: tuple[int, ...]
    slices: DataFrame
    anchors: Anchors
    trajectory: list[list[Center]]
    stats: list[Stats]
    digests: list[str]
    updates: list[dict]
    points: DataFrame | None = None
    cache: list[DataFrame] | None = None
    work: list[dict] = field(default_factory=list)
    fallback_round: int | None = None
    replayable: bool = True
    timing: dict = field(default_factory=dict)

    @property
    def centers(self) -> list[Center]:
        return self.trajectory[-1]
