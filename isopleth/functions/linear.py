"""Linear models of a few predictors as expressions: moments are aggregates, solutions are folds over small arrays.

A matrix is an array of doubles, row by row, of all predictors and the response in order. Moments come from one pass over
the rows of a group; solving takes the same steps for each group, whatever its size, and stays inside the plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Share of a predictor's variance that others leave unexplained, below which it counts as a combination of them.
SINGULAR = 1e-11


def comoments(columns: Sequence[Column]) -> Column:
    """Aggregate: matrix of the population covariances of the columns."""
    k = len(columns)
    upper = {(i, j): F.covar_pop(columns[i], columns[j]) for i in range(k) for j in range(i, k)}
    return F.array(*[upper[min(i, j), max(i, j)] for i in range(k) for j in range(k)])


def sweep(matrix: Column, k: int, pivots: Sequence[int]) -> Column:
    """The matrix of k columns after sweeping some of them out, one after the other; NULL if one is a combination.

    After the predictors were swept, the rest holds the Schur complement (what they leave unexplained), and their rows hold
    the coefficients of the others on them. Each pivot is compared with the variance that it had at first.
    """
    place = F.sequence(F.lit(0), F.lit(k * k - 1))

    def step(m: Column, at: Column) -> Column:
        pivot = F.get(m, at * k + at)
        first = F.get(matrix, at * k + at)

        def cell(i: Column) -> Column:
            row, column = F.floor(i / k).cast("int"), F.pmod(i, F.lit(k))
            own = F.get(m, row * k + at) / pivot
            plain = F.get(m, i) - own * F.get(m, at * k + column)
            in_row = F.when(column == at, 1 / pivot).otherwise(F.get(m, i) / pivot)
            return F.when(row == at, in_row).when(column == at, -own).otherwise(plain)

        return F.when((pivot > first * SINGULAR) & (pivot > 0), F.transform(place, cell))

    return F.aggregate(F.array(*[F.lit(p) for p in pivots]), matrix, step)


def at(matrix: Column, k: int, row: int, column: int) -> Column:
    return F.get(matrix, F.lit(row * k + column))


def least_squares(matrix: Column, k: int, penalty: Column | None = None) -> Column:
    """Coefficients of the first k - 1 columns for the last one; penalty: added to the variances (ridge)."""
    if penalty is not None:
        matrix = F.transform(matrix, lambda x, i: F.when((i % (k + 1) == 0) & (i < k * k - 1), x + penalty).otherwise(x))
    swept = sweep(matrix, k, range(k - 1))
    return F.slice(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.get(swept, i * k + k - 1)), 1, k - 1)


def lasso(matrix: Column, k: int, penalty: Column, rounds: int, tolerance: float) -> Column:
    """Coefficients by coordinate descent on the moments: half the mean square of residuals + penalty * sum of sizes.

    Rounds that follow one in which no coefficient moved by more than the tolerance, in units of the response's deviation
    over the predictor's, change nothing. A constant predictor has the coefficient 0.
    """
    n = k - 1
    places = F.sequence(F.lit(0), F.lit(n - 1))
    deviation = F.sqrt(at(matrix, k, n, n))

    def renewed(w: Column, j: Column) -> Column:
        explained = F.aggregate(places, F.lit(0.0), lambda total, i: total + F.when(i == j, 0.0).otherwise(F.get(matrix, j * k + i) * F.get(w, i)))
        rest = F.get(matrix, j * k + n) - explained
        own = F.get(matrix, j * k + j)
        return F.when(own > 0, F.signum(rest) * F.greatest(F.abs(rest) - penalty, F.lit(0.0)) / own).otherwise(0.0)

    def one_round(state: Column, _: Column) -> Column:
        w = F.aggregate(places, state["w"], lambda w, j: F.transform(w, lambda x, i: F.when(i == j, renewed(w, j)).otherwise(x)))
        moved = lambda new: F.exists(places, lambda i: F.abs(F.get(new, i) - F.get(state["w"], i)) * F.sqrt(F.get(matrix, i * k + i)) > tolerance * deviation)
        after = F.get(F.transform(F.array(w), lambda new: F.struct(new.alias("w"), (~moved(new)).alias("done"))), F.lit(0))
        return F.when(state["done"], state).otherwise(after)

    start = F.struct(F.array(*[F.lit(0.0)] * n).alias("w"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, one_round, lambda s: s["w"])
