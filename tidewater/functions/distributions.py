"""Probability functions. The normal quantile and integer-df Student t are column expressions; the rest, which need a
continued fraction or a root, run in Arrow batches over one row per test."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rational approximation of the normal quantile (Wichura, Algorithm AS 241), lowest power first.
CENTRAL = (
    (3.3871328727963666080, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
MIDDLE = (
    (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187, 1.67638483018380384940, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
TAIL = (
    (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def _poly(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + F.lit(c)
    return out


def normal_quantile(p: Column) -> Column:
    """Quantile of the standard normal distribution; null outside (0, 1)."""
    q = p - F.lit(0.5)
    r = F.lit(0.180625) - q * q
    central = q * _poly(CENTRAL[0], r) / _poly(CENTRAL[1], r)
    s = F.sqrt(-F.log(F.least(p, F.lit(1.0) - p)))
    near, far = s - F.lit(1.6), s - F.lit(5.0)
    outer = F.when(s <= 5, _poly(MIDDLE[0], near) / _poly(MIDDLE[1], near)).otherwise(_poly(TAIL[0], far) / _poly(TAIL[1], far))
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.425, central).otherwise(F.signum(q) * outer))


def t_two_sided(t: Column, df: Column, most_df: int = 64) -> Column:
    """Two-sided p of Student's t for whole df up to most_df, by the closed finite series; null beyond."""
    theta = F.atan(F.abs(t) / F.sqrt(df))
    sin, cos = F.sin(theta), F.cos(theta)
    # the series' terms: cos^2 * 1/2, cos^4 * 1*3/(2*4), ... for even df; cos, cos^3 * 2/3, ... for odd
    even = F.aggregate(F.sequence(F.lit(1), F.greatest(F.floor(df / 2).cast("int") - 1, F.lit(1))), F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")), lambda a, k: F.struct((a["term"] * cos * cos * (2 * k - 1) / (2 * k)).alias("term"), (a["sum"] + a["term"] * cos * cos * (2 * k - 1) / (2 * k)).alias("sum")))["sum"]
    even = F.when(df == 2, F.lit(1.0)).otherwise(even)
    odd = F.aggregate(F.sequence(F.lit(1), F.greatest(F.floor((df - 3) / 2).cast("int"), F.lit(1))), F.struct(cos.alias("term"), cos.alias("sum")), lambda a, k: F.struct((a["term"] * cos * cos * (2 * k) / (2 * k + 1)).alias("term"), (a["sum"] + a["term"] * cos * cos * (2 * k) / (2 * k + 1)).alias("sum")))["sum"]
    odd = F.when(df == 1, F.lit(0.0)).when(df == 3, cos).otherwise(odd)
    inside = F.when(df % 2 == 0, sin * even).otherwise(2 / math.pi * (theta + sin * odd))
    return F.when((df >= 1) & (df <= most_df), F.lit(1.0) - inside)


def beta_regularized(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_regularized(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    out = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * out


def gamma_upper(a: float, x: float) -> float:
    """Upper regularized incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-17 * abs(total):
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    b = x + 1 - a
    c, d = 1e300, 1 / b
    out = d
    for i in range(1, 1000):
        b += 2
        d = 1 / (-i * (i - a) * d + b)
        c = b - i * (i - a) / c
        out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * out


def _missing(*values: float) -> bool:
    return any(pd.isna(v) for v in values)


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of Student's t, any positive df."""
    return pd.Series([None if _missing(a, b) or b <= 0 else beta_regularized(b / 2, 0.5, b / (b + a * a)) for a, b in zip(t, df, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def f_p_value(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    """Upper-tail p of F."""
    return pd.Series([None if _missing(a, m, n) or n <= 0 else beta_regularized(n / 2, m / 2, n / (n + m * a)) if a >= 0 else 1.0 for a, m, n in zip(f, df1, df2, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def chi2_p_value(x: pd.Series, df: pd.Series) -> pd.Series:
    """Upper-tail p of chi squared."""
    return pd.Series([None if _missing(a, b) or b <= 0 else gamma_upper(b / 2, a / 2) for a, b in zip(x, df, strict=True)], dtype=float)


def t_quantile_975(df: int) -> float:
    """0.975 quantile of Student's t, by bisection."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        if beta_regularized(df / 2, 0.5, df / (df + mid * mid)) > 0.05:
            low = mid
        else:
            high = mid
    return (low + high) / 2


#: Degrees of freedom with a quantile of their own; beyond, an expansion in 1 / df is exact to 1e-9.
_QUANTILES = [t_quantile_975(df) for df in range(1, 101)]


def t975(df: Column) -> Column:
    """0.975 quantile of Student's t for whole df >= 1."""
    z = 1.959963984540054
    terms = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384, (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160]
    far = F.lit(z)
    for k, c in enumerate(terms, 1):
        far = far + F.lit(c) / F.pow(df.cast("double"), F.lit(float(k)))
    return F.when((df >= 1) & (df <= len(_QUANTILES)), F.element_at(F.array(*map(F.lit, _QUANTILES)), F.greatest(df, F.lit(1)).cast("int"))).when(df > len(_QUANTILES), far)
