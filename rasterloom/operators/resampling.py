"""Bootstrap intervals: seeded kernels over small samples, one group to a task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


METRICS = ("precision", "recall", "f1", "accuracy", "positive_share", "positive_pixels")


def rescaled(share: np.ndarray, n: int, population: float, replicates: int, rng: np.random.Generator) -> np.ndarray:
    """Shares of the four cells in each replicate of a stratum: n - 1 draws, rescaled for the finite population.

    A census does not vary; a single point of a larger stratum has no known variance.
    """
    if n < 1 or population < n:
        raise ValueError("a stratum holds at least its sample")
    if population == n:
        return np.tile(share, (replicates, 1))
    if n == 1:
        raise ValueError("a single point of a larger stratum has no known variance")
    return share + np.sqrt(1 - n / population) * (rng.multinomial(n - 1, share, replicates) / (n - 1) - share)


def ratios(cells: np.ndarray) -> dict[str, np.ndarray]:
    """Metrics of confusion cells (tp, fp, fn, tn), NaN where a denominator is 0."""
    tp, fp, fn, tn = cells.T
    over = lambda a, b: np.divide(a, b, out=np.full(len(a), np.nan), where=b > 0)
    every = tp + fp + fn + tn
    return dict(zip(METRICS, (over(tp, tp + fp), over(tp, tp + fn), over(2 * tp, 2 * tp + fp + fn), over(tp + tn, every), over(tp + fn, every), tp + fn), strict=True))


def intervals(points: DataFrame, keys: list[str], replicates: int = 2000, seed: int = 42, level: float = 0.95, strata: tuple[str, ...] = ("stratum",)) -> DataFrame:
    """keys, metric, lower, upper, defined (replicates that have the metric), status: percentile intervals.

    points has keys, strata, population, truth, predicted (0/1), point_id. Quantiles are of the replicates that define a
    metric. Without complete labels, or with a single point of a larger stratum, the status is unavailable.
    """
    kinds = dict(points.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("point_id")
        head = {k: rows[k].iloc[0] for k in keys}
        groups = [(g, float(g["population"].iloc[0])) for _, g in rows.groupby(list(strata), sort=True)]
        ok = rows[["truth", "predicted"]].notna().all().all() and all(n >= len(g) and (len(g) > 1 or n == len(g)) for g, n in groups)
        if not ok:
            return pd.DataFrame([head | {"metric": m, "lower": None, "upper": None, "defined": 0, "status": "unavailable"} for m in METRICS])
        rng, cells = np.random.default_rng(seed), np.zeros((replicates, 4))
        for g, n in groups:
            t, p = g["truth"].to_numpy(bool), g["predicted"].to_numpy(bool)
            share = np.bincount(np.where(p, np.where(t, 0, 1), np.where(t, 2, 3)), minlength=4) / len(g)
            cells += n * rescaled(share, len(g), n, replicates, rng)
        out = []
        for m, x in ratios(cells).items():
            x = x[np.isfinite(x)]
            lower, upper = np.quantile(x, [(1 - level) / 2, (1 + level) / 2]) if len(x) else (None, None)
            out.append(head | {"metric": m, "lower": lower, "upper": upper, "defined": len(x), "status": "complete"})
        return pd.DataFrame(out)

    return points.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", metric string, lower double, upper double, defined long, status string")


def mean_interval(df: DataFrame, keys: list[str], value: str, order: str, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """Interval of a mean by resampling with replacement within each group."""
    kinds = dict(df.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values(order)[value].dropna().to_numpy(float)
        rng = np.random.default_rng(seed)
        means = x[rng.integers(0, len(x), (replicates, len(x)))].mean(1) if len(x) else np.array([np.nan])
        lo, hi = np.quantile(means, [0.025, 0.975])
        return pd.DataFrame([{**{k: rows[k].iloc[0] for k in keys}, "mean": x.mean() if len(x) else None, "lo": lo, "hi": hi, "n": len(x)}])

    return df.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", mean double, lo double, hi double, n long")
