"""FORECAST.ETS: triple exponential smoothing with additive trend and season, by group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values of each smoothing parameter on the first grid, rounds of finer grids around the best one, seasons looked for at most, steps of a series at most.
GRID, FINER, MOST_SEASON, MOST_STEPS = 9, 4, 60, 8784


def smoothed(y: np.ndarray, season: int, alpha: np.ndarray, beta: np.ndarray, gamma: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Sums of squared one-step errors for arrays of parameters, and the last states (level, trend, season's indices).

    The start is the mean of the first season, the mean step between the first two seasons, and the first season's distances to its mean.
    """
    many, m = len(alpha), max(1, season)
    if len(y) >= 2 * m:
        trend = np.full(many, (y[m:2 * m] - y[:m]).mean() / m)
    else:
        trend = np.full(many, (y[-1] - y[0]) / max(1, len(y) - 1))
    head = y[:m].mean()
    level = np.full(many, head) - (trend * (m + 1) / 2 if m > 1 else 0)
    index = np.zeros((m, many)) if season <= 1 else np.tile((y[:m] - head)[:, None], (1, many))
    if m > 1:  # the season's own slope belongs to the trend
        index = index - trend * (np.arange(m) - (m - 1) / 2)[:, None]
    else:
        level = np.full(many, y[0]) - trend
    error = np.zeros(many)
    for t, v in enumerate(y):
        s = index[t % m]
        gap = v - (level + trend + s)
        error += gap * gap
        level = level + trend + alpha * gap
        trend = trend + alpha * beta * gap
        if season > 1:
            index[t % m] = s + gamma * (1 - alpha) * gap
    return error, (level, trend, index)


def season_of(y: np.ndarray, most: int = MOST_SEASON) -> int:
    """Length of the season: the lag of the highest autocorrelation of the series without its straight line, if that is a peak above chance; else 1."""
    n = len(y)
    x = np.arange(n)
    if n < 6:
        return 1
    rest = y - np.polyval(np.polyfit(x, y, 1), x)
    power = (rest * rest).sum()
    if power <= 1e-12 * max(1.0, (y * y).sum()):
        return 1
    lags = np.arange(1, min(most, n // 2) + 1)
    r = np.array([(rest[k:] * rest[:-k]).sum() / power * n / (n - k) for k in lags])
    best, bound = 1, 2.5 / np.sqrt(n)
    for i in range(1, len(r)):
        peak = r[i] >= r[i - 1] and (i + 1 == len(r) or r[i] > r[i + 1])
        if peak and r[i] > bound and (best == 1 or r[i] > r[best - 1] + 0.02):
            best = int(lags[i])
    return best


def fitted(y: np.ndarray, season: int) -> tuple[tuple[float, float, float], float, tuple]:
    """((alpha, beta, gamma), sum of squared errors, last states): least errors on a grid, and on finer ones around its best point."""
    low, high = np.zeros(3), np.ones(3)
    best, least = np.full(3, 0.5), np.inf
    for _ in range(FINER + 1):
        axes = [np.linspace(a, b, GRID) for a, b in zip(low, high, strict=True)]
        if season <= 1:
            axes[2] = np.zeros(1)
        grid = np.stack([g.reshape(-1) for g in np.meshgrid(*axes, indexing="ij")])
        error, _ = smoothed(y, season, *grid)
        i = int(np.argmin(error))
        if error[i] < least:
            best, least = grid[:, i], float(error[i])
        width = (high - low) / (GRID - 1)
        low, high = np.maximum(0, best - width), np.minimum(1, best + width)
    _, (level, trend, index) = smoothed(y, season, *(np.array([p]) for p in best))
    return tuple(map(float, best)), least, (float(level[0]), float(trend[0]), index[:, 0])


def extended(y: np.ndarray, steps: int, season: int | None = None) -> tuple[np.ndarray, float, int]:
    """(values of the next steps, root mean squared one-step error, season)."""
    m = season_of(y) if season is None else season
    if 2 * m > len(y):  # a season has to be seen twice
        m = 1
    _, error, (level, trend, index) = fitted(y, m)
    k = np.arange(1, steps + 1)
    return level + k * trend + index[(len(y) + k - 1) % len(index)], float(np.sqrt(error / len(y))), m


def forecast_ets(df: DataFrame, group: str, step: Column, value: Column, ahead: int, season: int | None = None, fill: str = "interpolate") -> DataFrame:
    """(group, step, forecast, rmse, season): the next `ahead` steps of each group's series.

    `step` is a whole number in which steps follow each other by one, such as the number of a month; values of one step are averaged by Spark before a series is put
    together, so a series is one short list whatever the group's rows: at most MOST_STEPS steps, or an error. Steps without a value are interpolated, or
    zero with fill="zero". A season of 1 means none; None looks for one. Null groups are one group, null steps and values are left out, and a group with
    fewer than two steps has no forecast.
    """
    each = df.select(F.col(group).alias("g"), step.cast("long").alias("t"), value.cast("double").alias("v")).where("t IS NOT NULL AND v IS NOT NULL AND NOT isnan(v)")
    cells = each.groupBy("g", "t").agg(F.avg("v").alias("v"))
    spans = cells.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("t", "v"))).alias("s")).where(F.size("s") > 1)
    kind = df.schema[group].dataType

    def run(batches):
        for batch in batches:
            groups, out = batch.column(0).to_pylist(), []
            for g, s in zip(groups, batch.column(1).to_pylist(), strict=True):
                t = np.array([x["t"] for x in s], np.int64)
                if t[-1] - t[0] >= MOST_STEPS:
                    raise ValueError(f"a series of over {MOST_STEPS} steps: take longer steps")
                every = np.arange(t[0], t[-1] + 1)
                known = np.array([x["v"] for x in s], float)
                y = np.interp(every, t, known)
                if fill == "zero":
                    y[~np.isin(every, t)] = 0
                values, rmse, m = extended(y, ahead, season)
                out += [(g, int(t[-1]) + k + 1, float(v), rmse, m) for k, v in enumerate(values)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], batch.schema.field(0).type), *(pa.array([r[i] for r in out], k) for i, k in ((1, pa.int64()), (2, pa.float64()), (3, pa.float64()), (4, pa.int32())))],
                                             [group, "step", "forecast", "rmse", "season"])

    return spans.mapInArrow(run, f"`{group}` {kind.simpleString()}, step long, forecast double, rmse double, season int")
