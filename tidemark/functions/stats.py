"""Small statistics as expressions over arrays and counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def binomial_upper_tail(k: Column, n: Column, p: Column) -> Column:
    """P(X >= k) for X ~ Binomial(n, p), as a sum of exp(log terms).

    The log factorial is a Stirling series, so that the work per term does not grow
    with n; the shorter of the two tails is summed.
    """
    lgn = lambda x: log_factorial(x.cast("double"))

    def term(i: Column) -> Column:
        return F.exp(lgn(n) - lgn(i) - lgn(n - i) + i * F.log(p) + (n - i) * F.log1p(-p))

    def total(lo: Column, hi: Column) -> Column:
        return F.aggregate(F.sequence(lo, hi), F.lit(0.0), lambda acc, i: acc + term(i))

    upper = F.when(n - k <= k, total(k, n)).otherwise(1.0 - total(F.lit(0).cast("bigint"), k - 1))
    return (
        F.when(k <= 0, F.lit(1.0))
        .when(k > n, F.lit(0.0))
        .when(p <= 0, F.lit(0.0))
        .when(p >= 1, F.lit(1.0))
        .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), upper)))
    )


def log_factorial(x: Column) -> Column:
    """ln(x!) by Stirling's series at x + 10, stepped down by the ten skipped factors."""
    z = x + 10.0
    series = (
        (z + 0.5) * F.log(z) - z + 0.9189385332046727
        + 1.0 / (12.0 * z) - 1.0 / (360.0 * z * z * z) + 1.0 / (1260.0 * z * z * z * z * z)
    )
    skipped = F.lit(0.0)
    for step in range(1, 11):
        skipped = skipped + F.log(x + float(step))
    return series - skipped


def quantile_by_index(values: Column, q: float) -> Column:
    """sorted[int(q * (n - 1))]: no interpolation."""
    ordered = F.array_sort(values)
    at = F.floor(F.lit(q) * (F.size(values) - 1)).cast("int") + 1
    return F.element_at(ordered, at)


def cosine_distance(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return 1.0 - dot / F.nullif(norm(a) * norm(b), F.lit(0.0))


def exp_decay(age_hours: Column, scale_hours: float = 12.0) -> Column:
    """e^(-age/scale): an e-folding time, although the parameter is usually called a half-life."""
    return F.exp(-F.greatest(F.lit(0.0), age_hours) / F.lit(max(1.0, scale_hours)))


def linear_decay(age_hours: Column, zero_at: float = 6.0) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - age_hours / zero_at))


def round_even(x: Column, places: int) -> Column:
    """Half-even rounding of x * 10^places as a binary number; bround would round the decimal text of x."""
    factor = float(10 ** abs(places))
    return F.rint(x * factor) / factor if places >= 0 else F.rint(x / factor) * factor


def clamp(x: Column, lo, hi) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))
