"""Regression, partial correlation and p-values against brute force."""

import math
from decimal import Decimal, getcontext

import numpy as np
import pytest
from pyspark.sql import functions as F

from isopleth.functions import linear
from isopleth.functions.stats import pearson_pvalue, weighted
from isopleth.operators import rgdr


def exact_p(r, n):
    """P-value for even n, by the series of positive terms in decimals."""
    getcontext().prec = 40
    a, x = (n - 2) // 2, 1 - Decimal(r) ** 2
    log_ratio = math.fsum(math.log1p(1 / (2 * j)) for j in range(1, a))  # of gamma(a + 1/2) / gamma(a), up to a factor
    front = Decimal(math.sqrt(math.pi) / 2 * math.exp(log_ratio) / math.sqrt(math.pi) / a) * (Decimal(a) * x.ln()).exp() * abs(Decimal(r))
    total = term = Decimal(1)
    k = 0
    while term > Decimal("1e-20"):
        term *= x * (Decimal(a) + Decimal("0.5") + k) / (a + 1 + k)
        total += term
        k += 1
    return float(front * total)


def test_small_and_large_pvalues(spark):
    cases = [(n, t / math.sqrt(n - 2 + t * t)) for n in (4, 6, 30, 200, 5000) for t in (0.2, 1.0, 1.8, 4.0, 14.0, 40.0)]
    cases.append((1_000_000, 13.3 / math.sqrt(999_998 + 13.3**2)))
    rows = spark.createDataFrame(cases, "n int, r double").withColumn("p", pearson_pvalue(F.col("r"), F.col("n"))).collect()
    for row in rows:
        want = exact_p(row.r, row.n)
        assert row.p == pytest.approx(want, rel=1e-10, abs=0), (row, want)
    assert min(row.p for row in rows if row.n == 1_000_000) < 1e-39


def test_pvalues_of_odd_numbers_and_edges(spark):
    # three degrees of freedom have a closed form
    r = 0.6
    t = r * math.sqrt(3 / (1 - r * r))
    want = 1 - 2 / math.pi * (math.atan(t / math.sqrt(3)) + t * math.sqrt(3) / (3 + t * t))
    cases = [(5, r, want), (5, -r, want), (3, 0.5, 2 / 3), (10, 0.0, 1.0), (2, 1.0, 1.0), (7, 1.0, 0.0), (7, None, None), (1, 0.5, None), (0, None, None)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, n int, r double, want double").withColumn("p", pearson_pvalue(F.col("r"), F.col("n"))).collect()
    for row in rows:
        assert row.p == (row.want if row.want is None else pytest.approx(row.want, rel=1e-12)), row


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(5)
    n = 40
    z = rng.normal(size=(n, 2))
    target = 2 + 0.5 * z[:, 0] + rng.normal(size=n)
    cells, rows = {}, []
    for cell in range(5):
        cells[cell] = np.stack([rng.normal(size=n) + cell * z[:, 1] + (100 * cell), 3 * rng.normal(size=n) + 0.3 * target], 1)
        rows += [(i, float(cell), float(x), float(w)) for i, (x, w) in enumerate(cells[cell])]
    field = spark.createDataFrame(rows, "time int, latitude double, x double, w double")
    series = spark.createDataFrame([(i, float(v)) for i, v in enumerate(target)], "time int, value double")
    more = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(z)], "time int, z1 double, z2 double")
    return field, series, more, cells, target, z


def brute_force(x, y, method, alpha):
    xc, yc = x - x.mean(0), y - y.mean()
    n = len(y)
    if method == "linear":
        w = np.linalg.lstsq(xc, yc, rcond=None)[0]
    elif method == "ridge":
        w = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ yc)
    else:
        w = np.zeros(x.shape[1])
        step = n / np.linalg.norm(xc, 2) ** 2
        for _ in range(200_000):  # proximal gradients
            g = w + step * xc.T @ (yc - xc @ w) / n
            w, old = np.sign(g) * np.maximum(abs(g) - step * alpha, 0), w
            if abs(w - old).max() < 1e-15:
                break
    return w, y.mean() - x.mean(0) @ w, 1 - ((yc - xc @ w) ** 2).sum() / (yc**2).sum()


@pytest.mark.parametrize("method,alpha", [("linear", 0.0), ("ridge", 3.0), ("lasso", 0.15), ("lasso", 0.0)])
def test_regression(sample, method, alpha):
    field, series, more, cells, target, z = sample
    out = rgdr.regression(field, series, "time", method, alpha, more=more)
    assert out.columns == ["latitude", "intercept", "x_coef", "w_coef", "z1_coef", "z2_coef", "r2", "n"]
    for row in out.collect():
        w, intercept, r2 = brute_force(np.hstack([cells[int(row.latitude)], z]), target, method, alpha)
        assert [row.x_coef, row.w_coef, row.z1_coef, row.z2_coef] == pytest.approx(w.tolist(), rel=1e-6, abs=1e-9)
        assert (row.intercept, row.r2, row.n) == (pytest.approx(intercept, rel=1e-6, abs=1e-8), pytest.approx(r2, rel=1e-6), 40)


def test_a_strong_penalty_leaves_the_mean(sample):
    field, series, more, _, target, _ = sample
    row = rgdr.regression(field, series, "time", "lasso", 1e6, more=more).first()
    assert (row.x_coef, row.z1_coef, row.r2) == (0.0, 0.0, 0.0) and row.intercept == pytest.approx(target.mean())


def test_partial_correlation(sample):
    field, series, more, cells, target, z = sample
    out = rgdr.partial_correlation(field.drop("w"), series, more, "time")
    a = np.hstack([np.ones((len(z), 1)), z])
    rest = lambda v: v - a @ np.linalg.lstsq(a, v, rcond=None)[0]
    rows = out.collect()
    assert len(rows) == 5
    for row in rows:
        r = np.corrcoef(rest(cells[int(row.latitude)][:, 0]), rest(target))[0, 1]
        assert row.corr == pytest.approx(r, abs=1e-9)
        assert row.p_val == pytest.approx(exact_p(r, 38), rel=1e-7)
    assert rgdr.partial_correlation(field.drop("w"), series, more.drop("z1", "z2"), "time").count() == 5  # no controls


def test_series_that_cannot_be_fitted(spark, sample):
    field, series, more, *_ = sample
    gap = field.where("not (latitude = 1 and time = 7)").withColumn("x", F.when(~((F.col("latitude") == 2) & (F.col("time") == 3)), F.col("x")))
    gap = gap.withColumn("x", F.when(F.col("latitude") == 3, F.lit(4.0)).otherwise(F.col("x")))
    rows = {int(r.latitude): r for r in rgdr.regression(gap, series, "time", more=more).collect()}
    assert all(rows[i].x_coef is None and rows[i].intercept is None and rows[i].n in (39, 40) for i in (1, 2, 3)) and rows[4].x_coef is not None
    assert rgdr.regression(gap, series, "time", "lasso", 0.1, more=more).where("latitude = 3").first().x_coef == 0.0  # constant
    parts = {int(r.latitude): r for r in rgdr.partial_correlation(gap.drop("w"), series, more, "time").collect()}
    assert all(parts[i].corr is None and parts[i].p_val is None for i in (1, 2, 3)) and parts[0].corr is not None
    twice = more.withColumn("z3", F.col("z1") * 2 + F.col("z2"))
    assert all(r.corr is None for r in rgdr.partial_correlation(field.drop("w"), series, twice, "time").collect())
    assert rgdr.regression(field, series, "time", more=twice).where("x_coef is not null").isEmpty()
    none = rgdr.regression(gap.withColumn("x", F.when(F.col("latitude") != 4, F.col("x"))), series, "time", more=more).where("latitude = 4").first()
    assert none.n == 0 and none.x_coef is None and none.r2 is None
    assert rgdr.regression(field.limit(0), series, "time").isEmpty()
    with pytest.raises(ValueError):
        rgdr.regression(field, series, "time", "other")
    with pytest.raises(ValueError):
        rgdr.regression(field, series, "time", "ridge", -1.0)
    with pytest.raises(ValueError, match="names of their own"):
        rgdr.regression(field, series, "time", more=more.withColumnRenamed("z1", "x"))
    with pytest.raises(AssertionError):
        rgdr.partial_correlation(field.drop("w"), series.withColumnRenamed("time", "day"), more, "time")


def test_sweep(spark):
    m = np.array([[4.0, 1, 2], [1, 3, 0.5], [2, 0.5, 5]])
    got = spark.range(1).select(linear.sweep(F.array(*[F.lit(x) for x in m.reshape(-1).tolist()]), 3, [0, 1]).alias("m")).first().m
    got = np.array(got).reshape(3, 3)
    inverse = np.linalg.inv(m[:2, :2])
    assert np.allclose(got[:2, :2], inverse) and np.allclose(got[:2, 2], inverse @ m[:2, 2]) and np.isclose(got[2, 2], m[2, 2] - m[2, :2] @ inverse @ m[:2, 2])


def test_variance_of_values_far_from_zero(spark):
    rng = np.random.default_rng(2)
    v, w = 1e8 + rng.normal(size=1000), rng.uniform(1, 2, 1000)
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(v, w, strict=True)], "v double, w double")
    got = rows.agg(weighted(F.col("v"), F.col("w"), "var").alias("x")).first().x
    mean = (v * w).sum() / w.sum()
    assert got == pytest.approx((w * (v - mean) ** 2).sum() / w.sum(), rel=1e-5)
