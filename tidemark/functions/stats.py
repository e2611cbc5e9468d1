"""Distributions: Column expressions that stay in the JVM, and scalar twins for the driver."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LOG10_E = math.log10(math.e)
#: Effective genome sizes by abbreviation.
GENOME_SIZES = {"hs": 2_913_022_398, "mm": 2_652_783_500, "ce": 100_286_401, "dm": 142_573_017}


def lgamma(x: Column) -> Column:
    """ln Gamma for x > 0: Stirling's series at x + 8, stepped back. Relative error below 1e-12."""
    z = x + 8.0
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, F.lit(5.0)))
    return series - reduce(lambda a, b: a + b, [F.log(x + float(k)) for k in range(8)])


def poisson_log10_sf(k: Column, lam: Column, stop: float = 0.0) -> Column:
    """log10 P(X > k): the largest term in log space times the sum of its neighbours' ratios, to both sides.

    With ``stop`` the upward sum ends with the first term that raises the logarithm by less than it. Null where lam is
    not positive. For negative k the probability is 1.
    """
    lam = lam.cast("double")
    k = k.cast("long")
    top = F.greatest(k + 1, F.floor(lam)).cast("long")
    n = F.least(F.ceil(12 * F.sqrt(F.greatest(lam, F.lit(1.0)))) + 60, F.lit(100_000)).cast("int")
    zero = F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s"))
    m = F.least(n.cast("long"), top - k - 1).cast("int")
    down = F.when(m > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(m, F.lit(1))), zero, lambda a, i: F.struct((a["t"] * (top - i + 1) / lam).alias("t"), (a["s"] + a["t"] * (top - i + 1) / lam).alias("s")), lambda a: a["s"])).otherwise(0.0)
    base = F.struct(F.lit(1.0).alias("t"), (1 + down).alias("s"), F.lit(False).alias("done"))

    def further(a, i):
        t = a["t"] * lam / (top + i)
        return F.when(a["done"], a).otherwise(F.struct(t.alias("t"), (a["s"] + t).alias("s"), (F.log1p(t / a["s"]) < stop).alias("done")))

    total = F.aggregate(F.sequence(F.lit(1), n), base, further, lambda a: a["s"])
    value = (top * F.log(lam) - lam - lgamma(top + 1.0)) * LOG10_E + F.log10(total)
    return F.when(lam > 0, F.when(k < 0, F.lit(0.0)).otherwise(F.least(value, F.lit(0.0))))


def pscore(treat: Column, lam: Column) -> Column:
    """-log10 of the upper Poisson tail above trunc(treat), to 5 decimals; terms below 1e-5 of the logarithm end the sum."""
    return F.round(-poisson_log10_sf(treat.cast("long"), lam, 1e-5) + F.lit(0.0), 5)


def poisson_log10_pmf(k: Column, lam: Column) -> Column:
    return (k * F.log(lam) - lam - lgamma(k + 1.0)) * LOG10_E


def poisson_cdf_of(k: Column, lam: Column) -> Column:
    """P(X <= k)."""
    return F.when(k < 0, F.lit(0.0)).otherwise(1 - F.pow(F.lit(10.0), poisson_log10_sf(k, lam)))


def binomial_log_pmf_of(x: Column, n: Column, p: Column) -> Column:
    """ln P(X = x) for 0 < p < 1; null where x is not in 0..n."""
    return F.when((x >= 0) & (x <= n), lgamma(n + 1.0) - lgamma(x + 1.0) - lgamma(n - x + 1.0) + x * F.log(p) + (n - x) * F.log1p(-p))


def binomial_cdf_of(x: Column, n: Column, p: Column, most: int = 10_000) -> Column:
    """P(X <= x) for 0 < p < 1, summed from x down over at most ``most`` terms (what is left is below 1e-12 by then)."""
    first = F.exp(binomial_log_pmf_of(x, n, p))
    start = F.struct(first.alias("t"), first.alias("s"))

    def further(a, i):
        t = a["t"] * i * (1 - p) / ((n - i + 1) * p)
        return F.struct(t.alias("t"), (a["s"] + t).alias("s"))

    down = F.when(x > 0, F.sequence(x.cast("int"), F.greatest(F.lit(1), (x - most).cast("int")), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.when(x < 0, 0.0).when(x >= n, 1.0).otherwise(F.least(F.lit(1.0), F.aggregate(down, start, further, lambda a: a["s"])))


def normal_pdf(x: Column, mean, var) -> Column:
    """Density of the normal distribution with this variance."""
    return F.exp(-F.pow(x - mean, F.lit(2.0)) / (2.0 * var)) / F.sqrt(2 * math.pi * F.lit(var) if not isinstance(var, Column) else 2 * math.pi * var)


def erf(x: Column) -> Column:
    """Error function: power series up to 3, continued fraction of the tail beyond; absolute error below 1e-10."""
    a = F.abs(x)
    zero = F.struct(a.cast("double").alias("t"), a.cast("double").alias("s"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(80)), zero, lambda c, i: F.struct((-c["t"] * a * a / i).alias("t"), (c["s"] - c["t"] * a * a / i / (2 * i + 1)).alias("s")), lambda c: c["s"])
    frac = F.aggregate(F.sequence(F.lit(60), F.lit(1)), F.lit(0.0), lambda c, i: (i / 2.0) / (a + c))
    tail = 1 - F.exp(-a * a) / (a + frac) / math.sqrt(math.pi)
    return F.signum(x) * F.when(a < 3, 2 / math.sqrt(math.pi) * series).otherwise(tail)


def normal_cdf(z: Column) -> Column:
    return (1 + erf(z / math.sqrt(2))) / 2


def chi2_cdf(x: Column, df: int) -> Column:
    """CDF of the chi-square distribution for 1 degree of freedom or an even number of them; 0 for x <= 0."""
    if df == 1:
        return F.when(x > 0, erf(F.sqrt(x / 2))).otherwise(0.0)
    return F.when(x > 0, 1 - F.pow(F.lit(10.0), -chi2_log10_sf(x, df))).otherwise(0.0)


def chi2_log10_sf(x: Column, df: int) -> Column:
    """-log10 of the upper tail for even ``df``: exp(-x/2) * sum of (x/2)^j / j! for j < df/2, summed relative to the last term."""
    if df % 2:
        raise ValueError("even degrees of freedom only")
    h, n = x / 2.0, df // 2
    if n == 1:
        return h * LOG10_E
    terms = [j * F.log(h) - math.lgamma(j + 1) for j in range(n)]
    top = F.greatest(*terms)
    total = reduce(lambda a, b: a + b, [F.exp(t - top) for t in terms])
    return F.when(h > 0, (h - top - F.log(total)) * LOG10_E).otherwise(0.0)


def fisher_log10(scores: list[Column]) -> Column:
    """-log10 of Fisher's combined probability of -log10 scores."""
    total = reduce(lambda a, b: a + b, scores)
    return chi2_log10_sf(2 * total / LOG10_E, 2 * len(scores))


# Scalars for the driver.


def poisson_sf(k: int, lam: float) -> float:
    """P(X > k)."""
    return 10 ** poisson_log10_sf_scalar(k, lam)


def poisson_log10_sf_scalar(k: int, lam: float) -> float:
    if k < 0:
        return 0.0
    top = max(k + 1, math.floor(lam))
    total, t, i = 1.0, 1.0, 1
    while i < 100_000:
        t *= lam / (top + i)
        total += t
        i += 1
        if t < total * 1e-17:
            break
    t = 1.0
    for i in range(1, top - k):
        t *= (top - i + 1) / lam
        total += t
        if t < total * 1e-17:
            break
    return min(0.0, (top * math.log(lam) - lam - math.lgamma(top + 1)) * LOG10_E + math.log10(total))


def poisson_cdf(k: int, lam: float) -> float:
    """P(X <= k), summed from the largest term down."""
    if k < 0:
        return 0.0
    top = min(k, math.floor(lam))
    total, t = 1.0, 1.0
    for i in range(1, top + 1):
        t *= (top - i + 1) / lam
        total += t
        if t < total * 1e-17:
            break
    t = 1.0
    for j in range(top + 1, k + 1):
        t *= lam / j
        total += t
    return min(1.0, math.exp(top * math.log(lam) - lam - math.lgamma(top + 1)) * total)


def poisson_cdf_inv(p: float, lam: float, most: int = 1000) -> int:
    """The smallest k up to ``most`` with CDF >= p; ``most`` where there is none."""
    c, t = math.exp(-lam), math.exp(-lam)
    for k in range(most):
        if c >= p:
            return k
        t *= lam / (k + 1)
        c += t
    return most


def poisson_sf_inv(q: float, lam: float, most: int = 1000) -> int:
    """The smallest k up to ``most`` with P(X > k) <= q; ``most`` where there is none."""
    return next((k for k in range(most) if poisson_sf(k, lam) <= q), most)


def binomial_log_pmf(x: int, n: int, p: float) -> float:
    return math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1) + x * math.log(p) + (n - x) * math.log1p(-p)


def binomial_pmf(x: int, n: int, p: float) -> float:
    return math.exp(binomial_log_pmf(x, n, p)) if 0 <= x <= n else 0.0


def binomial_coef(n: int, k: int) -> float:
    return math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1))


def binomial_cdf(x: int, n: int, p: float) -> float:
    """P(X <= x), from the nearer tail."""
    if x < 0:
        return 0.0
    if x >= n:
        return 1.0
    return min(1.0, _binomial_low(x, n, p)) if x <= n * p else max(0.0, 1 - _binomial_high(x, n, p))


def binomial_sf(x: int, n: int, p: float) -> float:
    """P(X > x)."""
    if x < 0:
        return 1.0
    if x >= n:
        return 0.0
    return _binomial_high(x, n, p) if x >= n * p else max(0.0, 1 - _binomial_low(x, n, p))


def _binomial_low(x: int, n: int, p: float) -> float:
    t = total = math.exp(binomial_log_pmf(x, n, p))
    for i in range(x, 0, -1):
        t *= i * (1 - p) / ((n - i + 1) * p)
        total += t
        if t < total * 1e-17:
            break
    return total


def _binomial_high(x: int, n: int, p: float) -> float:
    t = total = math.exp(binomial_log_pmf(x + 1, n, p))
    for i in range(x + 1, n):
        t *= (n - i) * p / ((i + 1) * (1 - p))
        total += t
        if t < total * 1e-17:
            break
    return total


def binomial_cdf_inv(cdf: float, n: int, p: float) -> int:
    """The smallest x with CDF(x) >= cdf."""
    t = c = math.exp(n * math.log1p(-p))
    for x in range(n + 1):
        if c >= cdf:
            return x
        t *= (n - x) * p / ((x + 1) * (1 - p))
        c += t
    return n


def duplication_probability(pmf: dict[int, float], n_obs: int, n: int) -> float:
    """Mean binomial upper tail of ``n_obs`` over the rates of a pmf."""
    return sum(w * binomial_sf(n_obs, n, r / n) for r, w in pmf.items())


def max_duplicates(genome_size: float, tags: int, p: float = 1e-5) -> int:
    """How many tags may share one position before chance at ``p`` is exceeded."""
    return max(1, binomial_cdf_inv(1 - p, int(tags), 1.0 / genome_size))
