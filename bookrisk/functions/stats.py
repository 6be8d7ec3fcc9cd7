"""Distribution tail probabilities as Spark column expressions (no UDF).

Each uses the expansion that converges fast where its argument lies, with as
many terms as double precision needs there.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

KS_TERMS = 12


def kolmogorov_sf(lam: Column) -> Column:
    """P(K > lambda) of the Kolmogorov distribution; 1 for lambda <= 0. Below
    1 the theta form sqrt(2 pi)/lambda sum exp(-(2k-1)^2 pi^2 / (8 lambda^2))
    of the lower tail, from 1 on 2 sum (-1)^(k-1) exp(-2 k^2 lambda^2); both
    are exact to double precision within 12 terms on their side."""
    safe = F.greatest(lam, F.lit(1e-9))
    theta = sum((F.exp(-((2 * k - 1) ** 2) * math.pi ** 2 / 8.0 / (safe * safe)) for k in range(1, KS_TERMS + 1)), F.lit(0.0))
    upper = sum(((-1.0) ** (k - 1) * F.exp(-2.0 * k * k * lam * lam) for k in range(1, KS_TERMS + 1)), F.lit(0.0))
    q = F.when(lam < 1, 1.0 - F.lit(math.sqrt(2 * math.pi)) / safe * theta).otherwise(2.0 * upper)
    return F.when(lam <= 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), q)))


def ks_p_value(d: Column, n1: Column, n2: Column) -> Column:
    """Asymptotic two-sample p-value of the KS statistic ``d``; null if a sample is empty."""
    ne = n1 * n2 / F.nullif(n1 + n2, F.lit(0))
    lam = (F.sqrt(ne) + 0.12 + 0.11 / F.nullif(F.sqrt(ne), F.lit(0.0))) * d
    return F.element_at(F.transform(F.array(lam), kolmogorov_sf), 1)  # lam is computed once


def _log_gamma_half(s2: Column) -> Column:
    """ln Gamma(s2 / 2 + 1) for a positive integer ``s2`` (exact recursion)."""
    # Gamma(1) = 1, Gamma(3/2) = sqrt(pi)/2; then Gamma(x + 1) = x Gamma(x)
    base = F.when(s2 % 2 == 0, F.lit(0.0)).otherwise(F.lit(math.log(math.sqrt(math.pi) / 2.0)))
    start = F.when(s2 % 2 == 0, F.lit(2)).otherwise(F.lit(3))
    steps = F.when(s2 >= start, F.sequence(start, s2, F.lit(2))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, base, lambda acc, j: acc + F.log(j / 2.0))


def chi2_sf(x: Column, dof: Column) -> Column:
    """P(X > x) for a chi-square with integer ``dof``, with s = dof/2 and
    h = x/2: one minus the power series of the lower tail for h < s + 1, the
    continued fraction of the upper tail above. Both need about 10 sqrt(s)
    terms for double precision, and get them."""
    s, h = dof / 2.0, x / 2.0
    log_gamma = _log_gamma_half(dof.cast("int"))  # ln Gamma(s + 1)
    steps = F.sequence(F.lit(1), (F.lit(60) + 10 * F.sqrt(s)).cast("int"))
    scale = s * F.log(h) - h - log_gamma

    def term(acc, n):
        t = acc["t"] * h / (s + n)
        return F.struct((acc["sum"] + t).alias("sum"), t.alias("t"))
    lower = F.exp(scale) * F.aggregate(steps, F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("t")), term)["sum"]

    def fraction(acc, n):  # modified Lentz steps
        b = acc["b"] + 2.0
        a = -n * (n - s)
        d = 1.0 / (a * acc["d"] + b)
        c = b + a / acc["c"]
        return F.struct(b.alias("b"), c.alias("c"), d.alias("d"), (acc["h"] * c * d).alias("h"))
    b0 = h + 1.0 - s
    start = F.struct(b0.alias("b"), F.lit(1e300).alias("c"), (1.0 / b0).alias("d"), (1.0 / b0).alias("h"))
    upper = F.exp(scale + F.log(s)) * F.aggregate(steps, start, fraction)["h"]
    p = F.when(h < s + 1, 1.0 - lower).otherwise(upper)
    return F.when(x <= 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))
