"""Hot-spot ranking: hourly severity series, a seasonal forecast, a recency-weighted fallback."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.stats import exp_decay, round_even
from tidemark.operators.detectors.base import age_hours

HISTORY_H, HORIZON_H, SEASON_H = 72, 48, 24


def hourly_series(samples: DataFrame, as_of: Column, history_h: int = HISTORY_H) -> DataFrame:
    """One array of `history_h` hourly sums per (layer, region), oldest first, gaps as zero."""
    age = age_hours(as_of, F.col("event_time"))
    hourly = (
        samples.filter((age >= 0) & (age < history_h))
        .groupBy("layer", "region", (F.lit(history_h - 1) - F.floor(age)).cast("int").alias("slot"))
        .agg(F.sum(F.col("severity").cast("double")).alias("s"))
    )
    filled = F.map_from_entries(F.collect_list(F.struct("slot", "s")))
    by_bucket = hourly.groupBy("layer", "region").agg(filled.alias("m"))
    series = F.transform(
        F.sequence(F.lit(0), F.lit(history_h - 1)), lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0.0))
    )
    return by_bucket.select("layer", "region", series.alias("series"))


def recency_scores(samples: DataFrame, as_of: Column, scale_h: float = 12.0, boost: float = 1.5, recent_h: float = 6.0) -> DataFrame:
    age = F.greatest(F.lit(0.0), age_hours(as_of, F.col("event_time")))
    weight = exp_decay(age, scale_h) * F.when(age <= recent_h, boost).otherwise(1.0)
    return samples.groupBy("layer", "region").agg(
        F.sum(F.col("severity") * weight).alias("recency_score"),
        F.max("severity").alias("max_historical_severity"),
        F.count(F.lit(1)).alias("evidence_count"),
    )


def _seasonal_forecast(series: np.ndarray, horizon: int) -> np.ndarray | None:
    """Ridge regression on lags 1, 2, the season and its successor, iterated forward."""
    n = len(series)
    if n < max(2 * SEASON_H, 12) or series.max() - series.min() <= 1e-9:
        return None
    lags = np.array([1, 2, SEASON_H, SEASON_H + 1])
    rows = np.arange(lags.max(), n)
    x = np.column_stack([np.ones(len(rows)), *[series[rows - lag] for lag in lags]])
    penalty = np.eye(x.shape[1])
    penalty[0, 0] = 0
    beta = np.linalg.solve(x.T @ x + penalty, x.T @ series[rows])
    ceiling = 4 * series.max()
    path = list(series)
    for _ in range(horizon):
        value = beta[0] + sum(b * path[-lag] for b, lag in zip(beta[1:], lags))
        path.append(float(min(max(value, 0.0), ceiling)))
    return np.array(path[n:])


def hotspots(samples: DataFrame, as_of: Column, history_h: int = HISTORY_H, horizon_h: int = HORIZON_H, **recency) -> DataFrame:
    """Buckets by expected severity over the horizon; short or flat series fall back to recency.

    A bucket reaches Python as one row of `history_h` numbers, whatever its number of events.
    """

    @F.pandas_udf("struct<total:double,peak:double,mean:double>")
    def forecast(series: pd.Series) -> pd.DataFrame:
        out = []
        for values in series:
            path = None if values is None else _seasonal_forecast(np.asarray(values, dtype=float), horizon_h)
            out.append((None,) * 3 if path is None else (float(path.sum()), float(path.max()), float(path.mean())))
        return pd.DataFrame(out, columns=["total", "peak", "mean"])

    predicted = hourly_series(samples, as_of, history_h).withColumn("f", forecast("series")).drop("series")
    scored = recency_scores(samples, as_of, **recency).join(predicted, ["layer", "region"], "left")
    seasonal = F.col("f.total").isNotNull()
    return scored.select(
        "layer", "region", round_even(F.coalesce("f.total", "recency_score"), 3).alias("score"),
        F.when(seasonal, "seasonal").otherwise("recency_weighted_fallback").alias("method"),
        round_even(F.col("f.peak"), 3).alias("forecast_max"), round_even(F.col("f.mean"), 3).alias("forecast_mean"),
        "max_historical_severity", "evidence_count",
    ).orderBy(F.desc("score"), "layer", "region")
