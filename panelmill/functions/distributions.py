"""Distribution functions that Spark SQL lacks, as column functions over Arrow batches."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NORMAL = NormalDist()


def _each(f):
    """A scalar function of one column as a column function; null and non-finite inputs give null."""

    def over(x: pd.Series) -> pd.Series:
        return pd.Series([f(v) if v is not None and math.isfinite(v) else None for v in x.tolist()], dtype="float64")

    return lambda x: F.pandas_udf(over, "double")(x)


normal_cdf = _each(NORMAL.cdf)
normal_quantile = _each(lambda p: NORMAL.inv_cdf(p) if 0 < p < 1 else None)


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function: series below a + 1, continued fraction above."""
    if x <= 0:
        return 1.0
    lead = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1 - total * lead
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h * lead


def lower_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - lower_beta(b, a, 1 - x)
    lead = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 1000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or 1e-300)
            c = 1 + top / c or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return lead * h


def f_upper(f: float, d1: float, d2: float) -> float:
    """Upper tail of the F distribution."""
    return lower_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def f_sf(f: Column, d1: Column, d2: Column) -> Column:
    def tail(f: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f_upper(x, p, q) if np.isfinite(x) and p > 0 and q > 0 else None for x, p, q in zip(f, a, b)], dtype="float64")

    return F.pandas_udf(tail, "double")(f.cast("double"), d1.cast("double"), d2.cast("double"))


def chi2_sf(x: Column, df: Column) -> Column:
    def tail(x: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([upper_gamma(b / 2, a / 2) if np.isfinite(a) and b > 0 else None for a, b in zip(x, k)], dtype="float64")

    return F.pandas_udf(tail, "double")(x.cast("double"), df.cast("double"))


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = 6371008.8) -> Column:
    """Great-circle metres on the mean sphere, as an expression."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def geodesic_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres along the WGS-84 ellipsoid by Vincenty's inverse formula; null where it does not converge."""
    a, f = 6378137.0, 1 / 298.257223563

    def inverse(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.Series:
        u1, u2 = (np.arctan((1 - f) * np.tan(np.radians(x.to_numpy(float)))) for x in (lat1, lat2))
        turn = np.radians(lon2.to_numpy(float) - lon1.to_numpy(float))
        lam = turn.copy()
        with np.errstate(all="ignore"):
            for _ in range(200):
                s = np.hypot(np.cos(u2) * np.sin(lam), np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam))
                c = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * np.cos(lam)
                arc = np.arctan2(s, c)
                sin_a = np.where(s == 0, 0, np.cos(u1) * np.cos(u2) * np.sin(lam) / np.where(s == 0, 1, s))
                cos2 = 1 - sin_a**2
                mid = np.where(cos2 == 0, 0, c - 2 * np.sin(u1) * np.sin(u2) / np.where(cos2 == 0, 1, cos2))
                k = f / 16 * cos2 * (4 + f * (4 - 3 * cos2))
                new = turn + (1 - k) * f * sin_a * (arc + k * s * (mid + k * c * (2 * mid**2 - 1)))
                step, lam = np.abs(new - lam), new
                if np.nanmax(step, initial=0) < 1e-12:
                    break
            q = cos2 * (a**2 / (a * (1 - f)) ** 2 - 1)
            big = 1 + q / 16384 * (4096 + q * (-768 + q * (320 - 175 * q)))
            small = q / 1024 * (256 + q * (-128 + q * (74 - 47 * q)))
            more = small * s * (mid + small / 4 * (c * (2 * mid**2 - 1) - small / 6 * mid * (4 * s**2 - 3) * (4 * mid**2 - 3)))
        return pd.Series(np.where(step < 1e-10, a * (1 - f) * big * (arc - more), np.nan))

    return F.pandas_udf(inverse, "double")(lon1, lat1, lon2, lat2)
