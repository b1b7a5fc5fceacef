"""Statistics as expressions of built-in aggregates, so that they run partially on the map side and inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PI = 3.141592653589793


def pearson(x: Column, y: Column) -> Column:
    """Pearson correlation within [-1, 1]; NULL if either side is constant."""
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))  # greatest and least skip NULL


#: Levels of the continued fraction: 40 give full precision for any number of samples.
LEVELS = 60
#: Coefficients of gamma(a + 1/2) / gamma(a) / sqrt(a) in powers of 1/a from the first on, and the steps up to where they hold.
GAMMA_RATIO, STEPS_UP = (-1 / 8, 1 / 128, 5 / 1024, -21 / 32768, -399 / 262144, 869 / 4194304, 39325 / 33554432), 16


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _gamma_ratio(a: Column) -> Column:
    """gamma(a + 1/2) / gamma(a)."""
    up = a + STEPS_UP
    series = F.lit(0.0)
    for c in reversed(GAMMA_RATIO):
        series = (series + c) / up
    down = F.aggregate(F.sequence(F.lit(0), F.lit(STEPS_UP - 1)), F.lit(1.0), lambda x, j: x * (a + j) / (a + j + 0.5))
    return F.sqrt(up) * (1 + series) * down


def _fraction(x: Column, a: Column, b: Column) -> Column:
    """The continued fraction of the incomplete beta function, from its last level up."""

    def level(tail, m):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m - 1) * (a + b + m - 1) * x / ((a + 2 * m - 2) * (a + 2 * m - 1))
        return 1 + odd / (1 + even / tail)

    return 1 / F.aggregate(F.sequence(F.lit(LEVELS), F.lit(1)), F.lit(1.0), level)


def pearson_pvalue(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation r of n samples under the exact distribution (Student's t, n - 2 degrees).

    It is the regularised incomplete beta function of 1 - r^2 at (n - 2) / 2 and 1/2, by a continued fraction of a fixed
    number of levels: the same work for any n, and all digits of small values. NULL for NULL r and for n below 2.
    """
    whole = n.cast("double")

    def inside(s: Column) -> Column:
        r, half = s["r"], s["half"]
        front = s["ratio"] / PI**0.5 * F.exp(half * F.log1p(-r * r)) * r
        fraction = _let(F.struct(F.when(s["tail"], 1 - r * r).otherwise(r * r).alias("x"), F.when(s["tail"], half).otherwise(0.5).alias("a"), F.when(s["tail"], F.lit(0.5)).otherwise(half).alias("b")), lambda t: _fraction(t["x"], t["a"], t["b"]) / t["a"])
        return F.when(s["tail"], front * fraction).otherwise(1 - front * fraction)

    half = (whole - 2) / 2
    state = lambda s: F.struct(s["r"].alias("r"), s["half"].alias("half"), _gamma_ratio(s["half"]).alias("ratio"), (1 - s["r"] * s["r"] < (s["half"] + 1) / (s["half"] + 2.5)).alias("tail"))
    p = _let(F.struct(F.abs(r).alias("r"), half.alias("half")), lambda s: _let(state(s), inside))
    found = F.when(whole == 2, 1.0).when(F.abs(r) >= 1, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))
    return F.when(r.isNotNull() & (whole >= 2), found)


def central_squares(value: Column, weight: Column) -> Column:
    """Weighted sum of squared distances from the weighted mean, in one pass.

    Sum w v^2 - (sum w v)^2 / sum w, written with covariances, which the engine keeps centred: rounding errors grow with
    the distance of the values from 0, and not with its square.
    """
    wv = weight * value
    n = F.count(wv)
    return n * (F.covar_pop(value, wv) - F.try_divide(F.sum(wv), F.sum(weight)) * F.covar_pop(value, weight))


#: Reductions of a value by weights, over rows where both are there.
METHODS = ("mean", "sum", "std", "var", "sum_of_weights", "sum_of_squares")


def weighted(value: Column, weight: Column, method: str = "mean") -> Column:
    """Weighted reduction; NULL where there are no valid rows or the weights sum to 0 (sums: 0)."""
    if method not in METHODS:
        raise ValueError(f"method has to be one of {METHODS}, not {method!r}")
    w = F.when(value.isNotNull(), weight)
    total, first = F.sum(w), F.sum(w * value)
    mean = F.try_divide(first, total)
    squares = F.greatest(F.lit(0.0), central_squares(value, w))
    return {
        "mean": mean,
        "sum": F.coalesce(first, F.lit(0.0)),
        "var": F.try_divide(squares, total),
        "std": F.sqrt(F.try_divide(squares, total)),
        "sum_of_weights": total,
        "sum_of_squares": squares,
    }[method]
