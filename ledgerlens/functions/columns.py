"""Column functions shared by the operators. All are built-in expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

PI = math.pi
#: Degrees of freedom, and steps of a fraction, up to which chi-square tails are summed.
NEAR = 400


def flag(condition: Column) -> Column:
    """1 where a condition holds, 0 where it doesn't or is null."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def clean(x: Column) -> Column:
    """A number with NaN as null, so that comparisons with it don't hold."""
    return F.when(F.isnan(x), None).otherwise(x)


def cents(amount: Column) -> Column:
    return F.round(amount * 100).cast("long")


def _over(x: Column, w: WindowSpec | None) -> Column:
    return x.over(w) if w is not None else x


def moments(amount: Column, w: WindowSpec | None = None) -> tuple[Column, Column, Column]:
    """Count, sum and sum of squares of an amount in cents, exact, as an aggregate or over a window."""
    c = cents(amount).cast("decimal(19,0)")
    return _over(F.count(amount), w), _over(F.sum(c), w), _over(F.sum((c * c).cast("decimal(38,0)")), w)


def spread(n: Column, s: Column, q: Column) -> Column:
    """n q - s s as a double: n squared times the population variance, in squared cents."""
    return (n.cast("decimal(19,0)") * q - s.cast("decimal(38,0)") * s).cast("double")


def mean_of(n: Column, s: Column) -> Column:
    return F.try_divide(s.cast("double"), n.cast("double")) / 100


def stddev_of(n: Column, s: Column, q: Column) -> Column:
    """Sample standard deviation; null for fewer than two values."""
    return F.when(n > 1, F.sqrt(spread(n, s, q) / (n.cast("double") * (n - 1)))) / 100


def erfc(x: Column) -> Column:
    """Complementary error function of x >= 0, to 1.5e-7 (a published rational approximation)."""
    t = 1 / (1 + 0.3275911 * x)
    return t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)


def ks_p(d: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sample Kolmogorov-Smirnov p-value."""
    lam = d * F.sqrt(n.cast("double") * m / (n + m))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda a, k: a + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * lam * lam))
    return F.when(lam < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))


def chisq_p(x: Column, dof: Column) -> Column:
    """Upper tail of a chi-square statistic with whole degrees of freedom; null for none.

    Up to NEAR degrees and near their number, the lower tail's series; above,
    the upper tail's continued fraction. For more degrees, the cube-root
    approximation by a normal distribution.
    """
    a, h = dof / 2, x / 2
    even = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.floor(a), F.lit(NEAR)).cast("int"))), F.lit(0.0), lambda s, i: s + F.log(i.cast("double")))
    odd = F.aggregate(F.sequence(F.lit(1), F.least((dof + 1) / 2, F.lit(NEAR)).cast("int")), F.lit(math.log(math.sqrt(PI))), lambda s, i: s + F.log(i - 0.5))
    log_gamma = F.when(dof % 2 == 0, even).otherwise(odd)  # of a + 1
    front = F.exp(a * F.log(h) - h - log_gamma)
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(s, i):
        term = s["term"] * h / (a + i)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    lower = front * F.aggregate(F.sequence(F.lit(1), F.lit(8 * NEAR)), zero, add, lambda s: s["sum"])

    def deeper(s, k):
        """From the innermost step k of the fraction outwards."""
        i = NEAR + 1 - k
        return h + 2 * i + 1 - a - (i + 1) * (i + 1 - a) / s

    fraction = F.aggregate(F.sequence(F.lit(1), F.lit(NEAR + 1)), h + 2 * (NEAR + 1) + 1 - a, lambda s, k: deeper(s, k))
    upper = front * a / fraction
    spread_ = 2 / (9 * dof.cast("double"))
    z = (F.cbrt(x / dof) - (1 - spread_)) / F.sqrt(spread_)
    normal = F.when(z >= 0, erfc(z / math.sqrt(2)) / 2).otherwise(1 - erfc(-z / math.sqrt(2)) / 2)
    held = lambda p: F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))
    return F.when(dof > 0, F.when(x <= 0, 1.0).when(dof > NEAR, normal).when(h < a + 1, held(1 - lower)).otherwise(held(upper)))


def ks_exact(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    """Exact two-sample Kolmogorov-Smirnov p-values: one less the share of lattice paths that stay within d.

    Counts of paths to each point are built column by column; within a column,
    they are running sums over the points that are near enough.
    """
    def one(d, n, m):
        if d <= 0:
            return 1.0
        n, m = int(n), int(m)
        limit = (np.ceil(d * n * m - 1e-7) - 0.5) / (n * m)
        j = np.arange(m + 1) / m
        paths = (j <= limit).astype(float)
        for i in range(1, n + 1):
            near = np.abs(i / n - j) <= limit
            paths = np.cumsum(np.where(near, paths * i / (i + m), 0.0)) * near
        return float(min(1.0, max(0.0, 1 - paths[-1])))

    return pd.Series([one(*x) if pd.notna(x[0]) else None for x in zip(d, n, m)], dtype="float64")
