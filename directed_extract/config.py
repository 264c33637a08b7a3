"""Strategies, thresholds and scoring rules as immutable configuration."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Strategy:
    """A language-model detector: its model, how it cuts texts into windows, and its weight as evidence."""

    name: str
    model: str | None
    chunk_target: int | None
    chunk_overlap: int | None
    chunk_min: int | None
    chunk_max: int | None
    temperature: float | None
    weight: float | None

    @property
    def is_valid(self) -> bool:
        """Target and minimum above 0, overlap not negative, maximum above minimum, temperature in [0, 1], weight above 0."""
        values = (self.name, self.model, self.chunk_target, self.chunk_overlap, self.chunk_min, self.chunk_max, self.temperature, self.weight)
        if any(v is None for v in values):
            return False
        return self.chunk_target > 0 and self.chunk_overlap >= 0 and self.chunk_min > 0 and self.chunk_max > self.chunk_min and 0 <= self.temperature <= 1 and self.weight > 0

    @property
    def can_run(self) -> bool:
        """The weaker guard at run time; a strategy that fails it has no windows."""
        return bool(self.chunk_target and self.chunk_target > 0 and self.chunk_overlap is not None and self.chunk_overlap >= 0)


# The four strategies, in their order.
STRATEGIES = (
    Strategy("llama32_max_sensitivity", "llama3.2:3b", 100, 40, 50, 150, 0.1, 1.0),
    Strategy("llama32_balanced", "llama3.2:3b", 60, 30, 30, 90, 0.3, 1.0),
    Strategy("llama32_high_precision", "llama3.2:3b", 30, 15, 15, 45, 0.0, 1.0),
    Strategy("qwen25_diversity", "qwen2.5:3b", 20, 10, 10, 30, 0.5, 0.5),
)
#: Name and weight of the exact detector among the strategies.
REGEX, REGEX_WEIGHT = "regex", 1.0


@dataclass(frozen=True)
class Thresholds:
    """Confidence levels and the least confidence of an accepted entity."""

    high: float = 0.9
    medium: float = 0.7
    low: float = 0.5
    min_accept: float = 0.5

    def updated(self, **new: float) -> Thresholds:
        """A copy with new values; those outside [0, 1] are ignored, unknown names are an error."""
        return replace(self, **{k: v for k, v in new.items() if v is not None and 0 <= v <= 1})


@dataclass(frozen=True)
class Rules:
    """How evidence becomes confidence."""

    regex_factor: float = 1.5
    extra_strategy: float = 0.2
    model_only_factor: float = 0.8
    least: float = 0.0
    most: float = 1.0


def select(names: Iterable[str], strategies: Iterable[Strategy] = STRATEGIES) -> list[Strategy]:
    """The strategies of these names in their own order; ``all`` selects all, unknown names nothing."""
    names = list(names)
    return [s for s in strategies if "all" in names or s.name in names]


def by_name(name: str, strategies: Iterable[Strategy] = STRATEGIES) -> Strategy | None:
    return next((s for s in strategies if s.name == name), None)


def by_model(model: str, strategies: Iterable[Strategy] = STRATEGIES) -> list[Strategy]:
    return [s for s in strategies if s.model == model]


def overridden(strategies: list[Strategy], index: int, target: int | None = None, overlap: int | None = None, least: int | None = None, most: int | None = None, temperature: float | None = None) -> list[Strategy]:
    """A new list in which one strategy has other sizes. A new target sets minimum and maximum too, unless they are given."""
    if index >= len(strategies):
        return list(strategies)
    s = strategies[index]
    if target is not None:
        s = replace(s, chunk_target=target, chunk_min=max(5, int(target * 0.5)), chunk_max=max(target, int(target * 2)))
    given = {"chunk_overlap": overlap, "chunk_min": least, "chunk_max": most, "temperature": temperature}
    s = replace(s, **{k: v for k, v in given.items() if v is not None})
    return [*strategies[:index], s, *strategies[index + 1 :]]


def from_table(df: DataFrame, most: int = 1000) -> list[Strategy]:
    """The strategies of a table, by ``ord``; the exact detector's row has no model and is left out. Refuses large tables."""
    rows = df.orderBy("ord").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} strategies")
    return [Strategy(r["name"], r.model, r.chunk_target, r.chunk_overlap, r.chunk_min, r.chunk_max, r.temperature, r.weight) for r in rows if r.model is not None]


def weights_frame(spark: SparkSession, strategies: Iterable[Strategy]) -> DataFrame:
    """``(ord, strategy, weight)``, the exact detector first."""
    rows = [(0, REGEX, REGEX_WEIGHT)] + [(i, s.name, float(s.weight or 0.0)) for i, s in enumerate(strategies, 1)]
    return spark.createDataFrame(rows, "ord int, strategy string, weight double")
