"""Aggregate expressions for comparing two height columns.

Everything is built from mergeable aggregates (count, sum, central moments, min, max),
so one map-side-combined pass serves any grouping.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

from understory.functions.exprs import ColumnLike, as_col


def rounded(columns: dict[str, Column], digits: int = 6) -> list[Column]:
    return [F.round(c, digits).alias(name) for name, c in columns.items()]


def named(columns: dict[str, Column]) -> list[Column]:
    return [c.alias(name) for name, c in columns.items()]


def r2_score(truth: ColumnLike, other: ColumnLike) -> Column:
    """1 - SSE/SST with ``truth`` as the truth; NULL when it does not vary."""
    truth, other = as_col(truth), as_col(other)
    sse = F.sum((truth - other) * (truth - other))
    sst = F.var_pop(truth) * F.count(truth)
    return F.lit(1.0) - F.try_divide(sse, sst)


def rmse(truth: ColumnLike, other: ColumnLike) -> Column:
    d = as_col(truth) - as_col(other)
    return F.sqrt(F.avg(d * d))


def prediction_errors(pred: ColumnLike, ref: ColumnLike) -> dict[str, Column]:
    """Ten error measures of a prediction against its reference."""
    pred, ref = as_col(pred), as_col(ref)
    e = pred - ref
    size = F.abs(e)

    def share(limit: float) -> Column:
        return F.avg(F.when(size <= limit, 1.0).otherwise(0.0)) * 100.0

    return {
        "mse": F.avg(e * e), "rmse": F.sqrt(F.avg(e * e)), "mae": F.avg(size),
        "r2": r2_score(ref, pred), "mean_error": F.avg(e), "std_error": F.stddev_pop(e),
        "max_abs_error": F.max(size), "within_1m": share(1.0), "within_2m": share(2.0),
        "within_5m": share(5.0),
    }


def pair_statistics(x: ColumnLike, y: ColumnLike) -> dict[str, Column]:
    """Agreement of y with x (x is the truth), without the rank statistics."""
    x, y = as_col(x), as_col(y)
    return {
        "pearson_r": F.corr(x, y), "r2_score": r2_score(x, y), "rmse": rmse(x, y),
        "mae": F.avg(F.abs(x - y)), "bias": F.avg(y - x),
        "slope": F.regr_slope(y, x), "intercept": F.regr_intercept(y, x),
        "x_mean": F.avg(x), "y_mean": F.avg(y),
        "x_std": F.stddev_pop(x), "y_std": F.stddev_pop(y),
    }


def evaluation_statistics(ref: ColumnLike, pred: ColumnLike) -> dict[str, Column]:
    """The measures reported for a scenario and region."""
    ref, pred = as_col(ref), as_col(pred)
    return {
        "r2": r2_score(ref, pred), "rmse": rmse(ref, pred), "mae": F.avg(F.abs(pred - ref)),
        "bias": F.avg(pred - ref), "correlation": F.corr(ref, pred),
        "ref_mean": F.avg(ref), "pred_mean": F.avg(pred),
        "ref_std": F.stddev_pop(ref), "pred_std": F.stddev_pop(pred),
    }


def smooth_l1(d: ColumnLike, delta: float = 1.0) -> Column:
    """Huber loss of a difference."""
    size = F.abs(as_col(d))
    return (F.when(size < delta, F.lit(0.5) * size * size)
            .otherwise(F.lit(delta) * (size - F.lit(0.5 * delta))))


def t_statistic(r: ColumnLike, n: ColumnLike) -> Column:
    """Student statistic of a correlation coefficient."""
    r, n = as_col(r), as_col(n)
    rest = F.lit(1.0) - r * r
    return F.when((n > 2) & (rest > 0), r * F.sqrt((n - 2) / F.when(rest > 0, rest)))


def _beta_tail(a, b, x):
    """Regularised incomplete beta function by the modified Lentz continued fraction."""
    import math

    if not 0.0 < x < 1.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - _beta_tail(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 2000):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                          -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + numerator * d
            c = 1.0 + numerator / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            step = c * d
            value *= step
        if abs(step - 1.0) < 1e-15:
            break
    return front * value


@F.pandas_udf(DoubleType())
def two_sided_p(t: pd.Series, n: pd.Series) -> pd.Series:
    """p-value of a correlation's t statistic; applied to aggregated rows only."""
    out = []
    for value, count in zip(t, n):
        if pd.isna(value) or pd.isna(count) or count <= 2:
            out.append(None)
            continue
        dof = float(count) - 2.0
        out.append(_beta_tail(dof / 2.0, 0.5, dof / (dof + float(value) ** 2)))
    return pd.Series(out, dtype="float64")


# Two-sided normal critical values at 0.05, 0.01 and 0.001.
NORMAL_CRITICAL = {0.05: 1.959963984540054, 0.01: 2.5758293035489004, 0.001: 3.2905267314918945}
