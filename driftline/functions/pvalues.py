"""p-values of the two tests, evaluated on small result frames."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

SERIES_TERMS = 100
# Below this the cut series has not settled, and the probability is 1 to all printed digits.
SERIES_FLOOR = 0.2


def kolmogorov_tail(d: Column, n: Column, m: Column) -> Column:
    """P(D >= d) for two samples of n and m values, from the Kolmogorov series.

    The series gives the limit for large samples. Its argument x = sqrt(e) * d, with
    e = n*m/(n+m), is moved by 1/(6 sqrt e) + (x-1)/(4e) (Vrbik 2018), which brings it to the
    finite-sample value up to order e**-1.5.
    """
    e = n.cast("double") * m.cast("double") / (n + m).cast("double")
    x = F.sqrt(e) * d
    lam = x + F.lit(1.0) / (F.lit(6.0) * F.sqrt(e)) + (x - F.lit(1.0)) / (F.lit(4.0) * e)
    terms = F.transform(
        F.sequence(F.lit(1), F.lit(SERIES_TERMS)),
        lambda k: F.when(k % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0))
        * F.exp(F.lit(-2.0) * k * k * lam * lam),
    )
    total = F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)
    return (
        F.when(d.isNull(), F.lit(None).cast("double"))
        .when(lam < SERIES_FLOOR, F.lit(1.0))
        .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))
    )


def _exact_ks_tail(d: float, n: int, m: int) -> float:
    """P(D >= d) by counting lattice paths from (0,0) to (n,m) that stay closer than d.

    Row by row, the number of inside paths is a running sum within a band; each row is scaled
    so that the counts neither overflow nor vanish.
    """
    step = n // math.gcd(n, m) * m
    h = int(round(d * step))
    if h <= 0:
        return 1.0
    dn, dm = step // n, step // m
    # inside: |i*dn - j*dm| < h
    j = np.arange(m + 1)
    row = np.where(j * dm < h, 1.0, 0.0)
    log_scale = 0.0
    for i in range(1, n + 1):
        low = max(0, (i * dn - h) // dm + 1)
        high = min(m, -((-(i * dn + h)) // dm) - 1)
        row[:low] = 0.0
        row[high + 1:] = 0.0
        row[low:high + 1] = np.cumsum(row[low:high + 1])
        top = row.max()
        if top == 0.0:
            return 1.0
        if top > 1e200:
            row /= top
            log_scale += math.log(top)
    log_inside = math.log(row[m]) + log_scale if row[m] > 0 else -math.inf
    log_all = math.lgamma(n + m + 1) - math.lgamma(n + 1) - math.lgamma(m + 1)
    return min(1.0, max(0.0, -math.expm1(min(0.0, log_inside - log_all))))


@F.pandas_udf(DoubleType())
def exact_ks_tail(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    """Exact two-sample p-value, null without a statistic; time grows with n times m."""
    return pd.Series([
        _exact_ks_tail(x, int(a), int(b))
        if x == x and x is not None and min(a, b) > 0 else None
        for x, a, b in zip(d, n, m)
    ], dtype="float64")


def _chi2_tail(x: float, dof: int) -> float:
    """Upper tail of chi-squared with whole degrees of freedom, in closed form."""
    if dof < 1 or not x >= 0:
        return math.nan
    half = x / 2.0
    if half == 0.0:
        return 1.0
    if dof % 2:
        total, power = math.erfc(math.sqrt(half)), 0.5
    else:
        total, power = math.exp(-half), 1.0
    while power < dof / 2.0 - 0.25:
        total += math.exp(power * math.log(half) - half - math.lgamma(power + 1.0))
        power += 1.0
    return min(1.0, total)


@F.pandas_udf(DoubleType())
def chi2_tail(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([
        _chi2_tail(float(a), int(b)) if a == a and b == b and b is not None else None
        for a, b in zip(x, dof)
    ], dtype="float64")
