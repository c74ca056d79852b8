"""Regressions with non-negative slopes on scaled features, cross-validated by group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nonnegative_fit(gram: np.ndarray, cross: np.ndarray, tolerance: float = 1e-10) -> np.ndarray:
    """Least squares with coefficients of at least zero from normal equations, by active sets."""
    n = len(cross)
    x, free = np.zeros(n), np.zeros(n, bool)
    for _ in range(3 * n + 10):
        slope = cross - gram @ x
        slope[free] = -np.inf
        j = int(slope.argmax())
        if slope[j] <= tolerance:
            break
        free[j] = True
        while True:
            s = np.zeros(n)
            s[free] = np.linalg.lstsq(gram[np.ix_(free, free)], cross[free], rcond=None)[0]
            low = free & (s <= tolerance)
            if not low.any():
                x = s
                break
            step = np.min(x[low] / np.maximum(x[low] - s[low], 1e-300))
            x = x + step * (s - x)
            free &= x > tolerance
            x[~free] = 0
    return x


def fit(df: DataFrame, features: list[str], target: str, by: str) -> DataFrame:
    """For each group: intercept, coefficients on features scaled to 0..1, R2, rows.

    Spark sums counts, extremes and products of columns (partial sums before the
    shuffle); a group's solver sees only those sums, so its size doesn't matter.
    """
    good = df.where(" and ".join(f"{c} is not null and not isnan({c})" for c in [*features, target]))
    cols = [*features, target]
    sums = [F.count("*").alias("n"), *[F.sum(c).alias(f"s_{c}") for c in cols], *[F.min(c).alias(f"lo_{c}") for c in features], *[F.max(c).alias(f"hi_{c}") for c in features]]
    sums += [F.sum(F.col(a) * F.col(b)).alias(f"p_{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]
    agg = good.groupBy(by).agg(*sums)
    k = len(features)

    @F.pandas_udf("intercept double, coefficients array<double>, r2 double")
    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, r in rows.iterrows():
            n = float(r["n"])
            mean = np.array([r[f"s_{c}"] / n for c in cols])
            cov = np.array([[r[f"p_{min(i, j)}_{max(i, j)}"] / n - mean[i] * mean[j] for j in range(k + 1)] for i in range(k + 1)])
            span = np.array([r[f"hi_{c}"] - r[f"lo_{c}"] or 1.0 for c in features])  # a constant feature adds nothing
            low = np.array([r[f"lo_{c}"] for c in features])
            b = nonnegative_fit(cov[:k, :k] / np.outer(span, span), cov[:k, k] / span)
            fitted = float(2 * b @ (cov[:k, k] / span) - b @ (cov[:k, :k] / np.outer(span, span)) @ b)
            out.append((float(mean[k] - b @ ((mean[:k] - low) / span)), b.tolist(), fitted / cov[k, k] if cov[k, k] > 0 else None))
        return pd.DataFrame(out, columns=["intercept", "coefficients", "r2"])

    return agg.select(by, "n", solve(F.struct(*agg.columns)).alias("m")).select(by, "n", "m.*")
