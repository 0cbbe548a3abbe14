"""Statistics as Column expressions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def kolmogorov_p_value(statistic: Column, n_ref: Column, n_cur: Column) -> Column:
    """Asymptotic two-sample Kolmogorov-Smirnov p-value."""
    n_ref, n_cur = n_ref.cast("double"), n_cur.cast("double")
    lam = F.sqrt(F.try_divide(n_ref * n_cur, n_ref + n_cur)) * statistic
    terms = F.sequence(F.lit(1), F.lit(100))
    series = F.aggregate(
        terms,
        F.lit(0.0),
        lambda acc, k: acc
        + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * lam * lam),
    )
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.greatest(F.least(2 * series, F.lit(1.0)), F.lit(0.0)))


def _upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0.0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1.0
            term *= x / n
            total += term
        return max(0.0, 1.0 - total * front)
    # Continued fraction for the upper tail, evaluated from the front.
    tiny = 1e-300
    b = x + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2.0
        d = 1.0 / (an * d + b or tiny)
        c = b + an / c or tiny
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < 1e-15:
            break
    return front * h


@pandas_udf(DoubleType())
def chi2_p_value(statistic: pd.Series, dof: pd.Series) -> pd.Series:
    """Upper tail of the chi-squared distribution; one row per feature, never per record."""
    return pd.Series(
        [
            None if pd.isna(s) or pd.isna(k) else (_upper_gamma(k / 2.0, s / 2.0) if k > 0 else 1.0)
            for s, k in zip(statistic, dof)
        ],
        dtype="float64",
    )
