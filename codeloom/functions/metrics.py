"""Pluggable evaluators: a name, a description and a column with a score in [0, 1]."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Metric:
    name: str
    description: str
    score: Callable[[], Column]


_METRICS: dict[str, Metric] = {}


def register_metric(name: str, description: str, score: Callable[[], Column]) -> Metric:
    """``score`` is called when the metric is used and returns its column."""
    _METRICS[name] = Metric(name, description, score)
    return _METRICS[name]


def metrics() -> dict[str, Metric]:
    return dict(_METRICS)


def evaluate(df: DataFrame, name: str, check: bool = True) -> DataFrame:
    """Adds ``metric`` and ``score``; with ``check`` a score outside [0, 1] fails the job."""
    metric = _METRICS[name]
    score = metric.score().cast("double")
    if check:
        score = F.when(score.isNull() | score.between(0.0, 1.0), score).otherwise(
            F.raise_error(F.concat(F.lit(f"score of {name} outside [0, 1]: "), score.cast("string"))).cast("double"))
    return df.withColumns({"metric": F.lit(metric.name), "score": score})


def out_of_range(scores: DataFrame) -> DataFrame:
    """Rows whose score is outside [0, 1]."""
    return scores.where(~F.col("score").between(0.0, 1.0))
