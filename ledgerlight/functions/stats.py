"""Student-t tail probability for the one-row hypothesis test, as a Spark
column expression: the regularised incomplete beta by its continued fraction
(modified Lentz), as in standard numerical references. Nothing is collected, and
no scientific library is needed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY = 1e-300

# Cohen's d bands and the significance level.
ALPHA = 0.05
EFFECT_BANDS = ((0.2, "Small effect"), (0.5, "Small to medium effect"), (0.8, "Medium effect"))
LARGE_EFFECT = "Large effect"
# Lanczos approximation of log-gamma (g = 7, nine coefficients).
LANCZOS_G = 7.0
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313,
           -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6,
           1.5056327351493116e-7)
CF_STEPS = 200


def lgamma_col(z: Column) -> Column:
    """log Gamma(z) for z >= 0.5 (Lanczos)."""
    zz = z - F.lit(1.0)
    x = F.lit(LANCZOS[0])
    for i, p in enumerate(LANCZOS[1:], start=1):
        x = x + F.lit(p) / (zz + F.lit(float(i)))
    t = zz + F.lit(LANCZOS_G + 0.5)
    return F.lit(0.5 * math.log(2 * math.pi)) + (zz + F.lit(0.5)) * F.log(t) - t + F.log(x)


def _guard(v: Column) -> Column:
    return F.when(F.abs(v) > F.lit(_TINY), v).otherwise(F.lit(_TINY))


def _beta_cf_col(a: Column, b: Column, x: Column) -> Column:
    qab, qap, qam = a + b, a + F.lit(1.0), a - F.lit(1.0)
    d0 = F.lit(1.0) / _guard(F.lit(1.0) - qab * x / qap)
    init = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"))

    def step(acc, m):
        m = m.cast("double")
        m2 = m * F.lit(2.0)
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d1 = F.lit(1.0) / _guard(F.lit(1.0) + aa * acc["d"])
        c1 = _guard(F.lit(1.0) + aa / acc["c"])
        aa2 = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d2 = F.lit(1.0) / _guard(F.lit(1.0) + aa2 * d1)
        c2 = _guard(F.lit(1.0) + aa2 / c1)
        return F.struct(c2.alias("c"), d2.alias("d"), (acc["h"] * d1 * c1 * d2 * c2).alias("h"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(CF_STEPS)), init, step)["h"]


def betainc_col(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta I_x(a, b) as a column expression."""
    ln_front = lgamma_col(a + b) - lgamma_col(a) - lgamma_col(b) + a * F.log(x) + b * F.log1p(-x)
    front = F.exp(ln_front)
    direct = front * _beta_cf_col(a, b, x) / a
    mirrored = F.lit(1.0) - front * _beta_cf_col(b, a, F.lit(1.0) - x) / b
    return (F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0))
            .when(x < (a + F.lit(1.0)) / (a + b + F.lit(2.0)), direct).otherwise(mirrored))


def t_two_sided_p_col(t: Column, df: Column) -> Column:
    """Two-sided Student-t p-value as a column expression."""
    dfd = df.cast("double")
    x = dfd / (dfd + t * t)
    return F.when(t.isNull() | dfd.isNull() | (dfd <= 0), F.lit(None).cast("double")) \
        .otherwise(betainc_col(dfd / F.lit(2.0), F.lit(0.5), x))
