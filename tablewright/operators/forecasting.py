"""Additive Holt-Winters forecasts of resampled series.

Spark reduces any number of rows to one row per period and series; each series,
then as long as its calendar, is fitted in a task of its own.

For given smoothing weights the one-step errors are linear in the starting level,
trend and season, so the best start is a least-squares solution; only the weights
are searched, over a grid that is refined around its best point.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablewright.functions.columns import col, field_type
from tablewright.operators.timeseries import resample

# Periods per season, and the width of the approximate range.
SEASONS = {"Day": 7, "Week": 4, "Month": 12, "Quarter": 4}
RANGE_WIDTH = 1.96
LEAST_PERIODS = 6


def forecast_series(
    df: DataFrame, date: str, value: str, periods: int, frequency: str, series: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Return the history (``date, value``) and the forecast (``date, forecast,
    lower, upper``), both led by the ``series`` fields if given.

    A history of fewer than six periods raises an error; among several series it has NULL
    forecasts, and the others theirs.
    """
    if frequency not in SEASONS:
        raise ValueError(f"Unsupported frequency: {frequency}")
    periods = int(periods)
    if periods < 1:
        raise ValueError("At least one period must be forecast.")
    keys = list(series or [])
    totals = resample(df, date, value, frequency, "sum", keys)
    history = totals.select(*[col(k) for k in keys], col(date), col(value).cast("double").alias("value"))
    lengths = history.groupBy(*[col(k) for k in keys]).agg(F.count("*").alias("n"))
    if not keys and (lengths.first()["n"] or 0) < LEAST_PERIODS:
        raise ValueError(f"A forecast needs a history of {LEAST_PERIODS} periods or more.")

    names = [f"k{i}" for i in range(len(keys))]
    rows = history.select(
        *[col(k).alias(n) for k, n in zip(keys, names)], F.lit(0).alias("all"), col(date).alias("t"), "value"
    )
    output = T.StructType(
        [T.StructField(n, field_type(history, k)) for n, k in zip(names, keys)]
        + [T.StructField("last", T.DateType()), T.StructField("h", T.IntegerType())]
        + [T.StructField(n, T.DoubleType()) for n in ("forecast", "lower", "upper")]
    )
    season = SEASONS[frequency]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        if len(pdf) < LEAST_PERIODS:  # one of several series: a row for each period, without figures
            ahead, spread = np.full(periods, np.nan), np.nan
        else:
            ahead, spread = holt_winters(pdf["value"].to_numpy(dtype=float), season, periods)
        result = pd.DataFrame({"last": pdf["t"].iloc[-1], "h": np.arange(1, periods + 1), "forecast": ahead})
        result["lower"] = ahead - RANGE_WIDTH * spread
        result["upper"] = ahead + RANGE_WIDTH * spread
        for n in names:
            result[n] = pdf[n].iloc[0]
        return result[[f.name for f in output]]

    fitted = rows.groupBy(*(names or ["all"])).applyInPandas(fit, output)
    return history, fitted.select(
        *[F.col(n).alias(k) for n, k in zip(names, keys)],
        _label_after(F.col("last"), F.col("h"), frequency).alias(date),
        "forecast", "lower", "upper",
    )


def _label_after(last: Column, steps: Column, frequency: str) -> Column:
    if frequency in ("Day", "Week"):
        return F.date_add(last, steps * (1 if frequency == "Day" else 7))
    return F.last_day(F.add_months(last, steps * (1 if frequency == "Month" else 3)))


def holt_winters(y: np.ndarray, season: int, periods: int) -> tuple[np.ndarray, float]:
    """Forecast ``periods`` steps and return the standard deviation of the errors.

    The season takes part only when the history holds two full ones.
    """
    m = season if len(y) >= 2 * season else 0
    scale = float(np.abs(y).max()) or 1.0
    y = y / scale
    weights = _search(y, m)
    start = _best_start(_gram(y, m, weights[None])[0])[0]
    level, trend, seasonal = start[0], start[1], list(start[2:])
    errors = np.empty(len(y))
    for t, observed in enumerate(y):
        old = seasonal.pop(0) if m else 0.0
        error = errors[t] = observed - level - trend - old
        level, trend = level + trend + weights[0] * error, trend + weights[0] * weights[1] * error
        if m:
            seasonal.append(old + weights[2] * error)
    h = np.arange(1, periods + 1)
    ahead = level + trend * h + (np.array(seasonal)[(h - 1) % m] if m else 0.0)
    return ahead * scale, float(np.std(errors, ddof=1)) * scale


def _search(y: np.ndarray, m: int) -> np.ndarray:
    """Weights (level, trend, season) of the least squared error.

    The trend weight is at most the level weight, and level and season weights sum
    to at most one; searching their shares of that room makes the room a cube.
    """
    low, high = 1e-4, 1 - 1e-4
    axes = [np.linspace(low, high, 9)] * (3 if m else 2)
    best, best_error, width = None, np.inf, (high - low) / 8
    for _ in range(9):
        points = np.stack(np.meshgrid(*axes, indexing="ij"), -1).reshape(-1, len(axes))
        weights = np.zeros((len(points), 3))
        weights[:, 0] = points[:, 0]
        weights[:, 1] = points[:, 1] * points[:, 0]
        if m:
            weights[:, 2] = points[:, 2] * (1 - points[:, 0])
        errors = np.array([_best_start(g)[1] for g in _gram(y, m, weights)])
        lowest = int(errors.argmin())
        if errors[lowest] < best_error:
            best, best_error, centre = weights[lowest], errors[lowest], points[lowest]
        axes = [np.unique(np.clip(c + width * np.array([-1, -0.5, 0, 0.5, 1]), low, high)) for c in centre]
        width /= 2
    return best


def _gram(y: np.ndarray, m: int, weights: np.ndarray) -> np.ndarray:
    """Per weight vector, the inner products of the errors' coefficients.

    Level, trend, season and error are tracked as linear forms in the unknown start
    plus a constant, held in the last place.
    """
    width = 2 + m + 1
    shape = (len(weights), width)
    level, trend = np.zeros(shape), np.zeros(shape)
    level[:, 0] = trend[:, 1] = 1.0
    seasonal = []
    for i in range(m):
        form = np.zeros(shape)
        form[:, 2 + i] = 1.0
        seasonal.append(form)
    a, g = weights[:, 0:1], weights[:, 2:3]
    # The trend follows the change of level, so it moves by its weight times the
    # level's own correction.
    ab = weights[:, 0:1] * weights[:, 1:2]
    total = np.zeros((len(weights), width, width))
    for t, observed in enumerate(y):
        error = -(level + trend)
        error[:, -1] += observed
        if m:
            error -= seasonal[t % m]
            seasonal[t % m] = seasonal[t % m] + g * error
        total += error[:, :, None] * error[:, None, :]
        level = level + trend + a * error
        trend = trend + ab * error
    return total


def _best_start(gram: np.ndarray) -> tuple[np.ndarray, float]:
    inner, cross, constant = gram[:-1, :-1], gram[:-1, -1], gram[-1, -1]
    start = -np.linalg.lstsq(inner, cross, rcond=1e-12)[0]
    return start, float(constant + 2 * cross @ start + start @ inner @ start)
