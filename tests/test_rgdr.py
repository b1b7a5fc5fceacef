import math
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from isopleth.functions import geo, stats
from isopleth.operators import cluster, graph, rgdr
from isopleth.operators.rgdr import RGDR


@pytest.mark.parametrize("lat, dlat, dlon, want", [(-1, 2, 2, 49500), (45, 5, 5, 218500), (45, 5, 2.5, 109250)])
def test_spherical_area(spark, lat, dlat, dlon, want):
    assert spark.range(1).select(geo.spherical_area(lat, dlat, dlon)).first()[0] == pytest.approx(want, rel=0.05)


@pytest.mark.parametrize("intervals, lag, want", [([2], 1, [1]), ([1], 1, [-1]), ([-1], 1, [-2]), ([1, 2, 3, 4], 4, [-4, -3, -2, -1])])
def test_intervals_skip_zero(spark, intervals, lag, want):
    assert rgdr.intervals_subtract(intervals, lag) == want
    rows = spark.createDataFrame([(i,) for i in intervals], "i int").select(rgdr.interval_lag("i", lag)).collect()
    assert [r[0] for r in rows] == want
    with pytest.raises(ValueError):
        rgdr.intervals_subtract([1], -1)


def test_pvalue_against_integration(spark):
    def tail(r, n):  # density of r under independence: (1 - r^2)^((n - 4) / 2)
        x = np.linspace(-1, 1, 2_000_001)
        d = np.clip(1 - x * x, 0, None) ** ((n - 4) / 2)
        return np.trapezoid(np.where(np.abs(x) >= abs(r), d, 0), x) / np.trapezoid(d, x)

    cases = [(r, n) for n in (4, 5, 7, 12, 30, 31) for r in (0.0, 0.3, -0.6, 0.9)] + [(0.5, 3), (0.2, 2), (1.0, 9)]
    rows = spark.createDataFrame(cases, "r double, n int").select("r", "n", stats.pearson_pvalue(F.col("r"), F.col("n")).alias("p")).collect()
    for r, n, p in rows:
        want = {3: 2 / 3, 2: 1.0, 9: 0.0}.get(n)
        assert p == pytest.approx(want if want is not None else tail(r, n), abs=2e-5)


def series(spark, x, y):
    field = spark.createDataFrame([(t, 1.0, 2.0, v) for t, v in enumerate(x)], "time int, latitude double, longitude double, f double")
    return field, spark.createDataFrame(list(enumerate(y)), "time int, v double")


def test_correlation(spark):
    row = rgdr.correlation(*series(spark, [0.0, 0.0, 1.0], [0.0, 1.0, 1.0])).first()
    assert row["corr"] == pytest.approx(0.5) and row["p_val"] == pytest.approx(0.66666667)
    row = rgdr.correlation(*series(spark, [math.nan, 0.0, 1.0], [0.0, 1.0, 1.0])).first()
    assert row["corr"] is None and row["p_val"] is None
    row = rgdr.correlation(*series(spark, [1.0, 1.0, 1.0], [0.0, 1.0, 1.0])).first()
    assert row["corr"] is None
    field, target = series(spark, [0.0, 1.0, 2.0, 3.0], [1.0, 3.0, 5.0, 7.0])
    assert rgdr.correlation(field.where("time <> 2"), target).first()["corr"] is None
    row = rgdr.correlation(field, target).first()
    assert row["corr"] == pytest.approx(1) and row["p_val"] == pytest.approx(0, abs=1e-6)
    with pytest.raises(AssertionError):
        rgdr.correlation(field, target, "day")
    with pytest.raises(AssertionError):
        rgdr.correlation(field.drop("time").withColumnRenamed("latitude", "time"), target.withColumn("cluster_label", F.lit(1)))
    for stub in (lambda: rgdr.partial_correlation(1, 2, 3), lambda: rgdr.regression(1, 2)):
        with pytest.raises(NotImplementedError):
            stub()


def grid(spark, values, p=0.001):
    """Cell map from rows of correlations; None is not significant."""
    rows = [(50.0 - 5 * i, 100.0 + 5 * j, 0.9 if v is None else v, 0.5 if v is None else p) for i, row in enumerate(values) for j, v in enumerate(row)]
    return spark.createDataFrame(rows, "latitude double, longitude double, corr double, p_val double")


def labels(df):
    rows = sorted(df.collect(), key=lambda r: (-r["latitude"], r["longitude"]))
    width = len({r["longitude"] for r in rows})
    flat = [r["cluster_label"] for r in rows]
    return [flat[i : i + width] for i in range(0, len(flat), width)]


def test_clusters_by_sign_and_first_cell(spark):
    cells = grid(spark, [[0.5, None, 0.4, 0.4], [0.5, None, None, -0.3], [None, None, -0.5, -0.5]])
    out = cluster.spherical_clusters(cells, 600, 0.05)
    assert labels(out) == [[1, 0, 2, 2], [1, 0, 0, -1], [0, 0, -1, -1]]
    assert out.schema["cluster_label"].dataType.simpleString() == "smallint"
    shuffled = cells.orderBy(F.rand(3))
    assert labels(cluster.spherical_clusters(shuffled, 600, 0.05)) == labels(out)
    assert labels(cluster.spherical_clusters(cells, 1, 0.05))[0] == [1, 0, 2, 3]
    area = {r["cluster_label"]: r["area"] for r in cluster.cluster_area(out).collect()}
    kept = cluster.remove_small_area_clusters(out, area[1])
    assert labels(kept) == [[x if area[x] > area[1] else 0 for x in row] for row in labels(out)] and 1 not in sum(labels(kept), [])
    with pytest.warns(UserWarning, match="No significant clusters"):
        cluster.assert_clusters_present(cluster.spherical_clusters(cells, 600, 1e-9))
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert cluster.assert_clusters_present(out)


def test_neighbourhoods_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    points = [(i, 1 if i % 3 else -1, float(rng.uniform(-90, 90)), float(rng.uniform(-180, 360))) for i in range(250)]
    points += [(250, 1, 89.9, 0.0), (251, 1, 89.9, 180.0), (252, 1, 0.0, 359.9), (253, 1, 0.0, -0.1), (254, 1, 0.0, 0.1)]

    def km(a, b):
        p, q = math.radians(a[2]), math.radians(b[2])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[3] - a[3]) / 2) ** 2
        return 2 * 6371 * math.asin(min(1, math.sqrt(h)))

    df = spark.createDataFrame(points, "id long, sign int, latitude double, longitude double")
    for eps in (300, 1500, 6000):
        want = {(a[0], b[0]) for a in points for b in points if a[0] <= b[0] and a[1] == b[1] and km(a, b) <= eps}
        got = [(r["a"], r["b"]) for r in cluster.eps_edges(df, eps).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_components_against_union_find(spark):
    rng = np.random.default_rng(2)
    edges = [(int(p), int(a), int(b)) for p, a, b in zip(rng.integers(0, 2, 120), rng.integers(0, 90, 120), rng.integers(0, 90, 120))]
    edges += [(5, i, i + 1) for i in range(30)] + [(6, 4, 4)]
    parent = {(p, x): (p, x) for p, a, b in edges for x in (a, b)}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for p, a, b in edges:
        low, high = sorted((root((p, a)), root((p, b))))
        parent[high] = low
    got = sorted(tuple(r) for r in graph.connected_components(spark.createDataFrame(edges, "part int, a long, b long")).select("part", "id", "component").collect())
    assert got == sorted((p, x, root((p, x))[1]) for p, x in parent)


def test_links_give_the_components_of_all_edges(spark):
    rng = np.random.default_rng(5)
    lat, lon = np.concatenate([rng.uniform(-90, 90, 150), rng.uniform(40, 45, 250), rng.uniform(88, 90, 40)]), rng.uniform(-180, 360, 440)
    lon[150:400] = rng.uniform(-3, 3, 250)
    points = spark.createDataFrame([(i, int(rng.choice([-1, 1])), float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon))], "id long, sign int, latitude double, longitude double")
    for eps in (40, 300, 2500):
        both = [f(points, eps).withColumnRenamed("sign", "part") for f in (cluster.links, cluster.eps_edges)]
        few, many = ({tuple(r) for r in graph.connected_components(e).select("part", "id", "component").collect()} for e in both)
        assert few == many and len(few) == 440
        if eps == 300:
            assert both[0].count() < both[1].count() / 5


def test_weighted_quantile_of_counts(spark):
    """Equal weights give the usual interpolated quantile, and a value without weight does not count."""
    values = [3.0, 1.0, 10.0, 4.0, 7.0]
    df = spark.createDataFrame([("a", v, 2.0) for v in values] + [("a", 99.0, 0.0), ("b", None, 1.0)], "g string, v double, w double")
    for q in (0.0, 0.3, 0.5, 1.0):
        got = {r["g"]: r["v"] for r in rgdr.weighted_groupby(df, "g", "w", "quantile", q).collect()}
        assert got["a"] == pytest.approx(np.quantile(values, q)) and got["b"] is None


def test_weighted_reductions(spark):
    v, w = [1.0, 4.0, None, 2.0], [1.0, 2.0, 5.0, 3.0]
    df = spark.createDataFrame([(1, a, b) for a, b in zip(v, w)], "g int, v double, w double")
    ok = [(a, b) for a, b in zip(v, w) if a is not None]
    total = sum(b for _, b in ok)
    mean = sum(a * b for a, b in ok) / total
    squares = sum(b * (a - mean) ** 2 for a, b in ok)
    want = {"mean": mean, "sum": mean * total, "sum_of_weights": total, "sum_of_squares": squares, "var": squares / total, "std": math.sqrt(squares / total)}
    for method, x in want.items():
        assert rgdr.weighted_groupby(df, "g", "w", method).first()["v"] == pytest.approx(x)
    with pytest.raises(ValueError):
        rgdr.weighted_groupby(df, "g", "w", "mode")


def years(spark):
    rng = np.random.default_rng(1)
    signal = {(y, k): rng.normal() for y in range(2000, 2020) for k in (1, 2)}
    target = [(y, k, v) for (y, k), v in signal.items()]
    field = [
        (y, k - 3, 50.0 - 5 * i, 100.0 + 5 * j, (v if j < 2 else -v if j > 3 else 0.0) + rng.normal() * (0.1 if j != 2 and j != 3 else 1))
        for (y, k), v in signal.items() for i in range(3) for j in range(6)
    ]
    return spark.createDataFrame(field, "anchor_year int, i_interval int, latitude double, longitude double, sst double"), spark.createDataFrame(target, "anchor_year int, i_interval int, ts double")


def test_rgdr(spark):
    field, target = years(spark)
    model = RGDR([1, 2], lag=2, eps_km=600, alpha=0.001)
    assert model.precursor_intervals == [-2, -1] and model.target_intervals == [1, 2]
    assert repr(eval(repr(model))) == repr(model)
    for name in ("cluster_map", "pval_map", "corr_map"):
        with pytest.raises(ValueError, match="has to be called first"):
            getattr(model, name)
    with pytest.raises(ValueError):
        model.transform(field)
    out = model.fit_transform(field, target)
    assert labels(model.cluster_map) == [[1, 1, 0, 0, -1, -1]] * 3
    frame = out.toPandas()
    assert sorted(frame["cluster_label"].unique()) == [-1, 1] and len(frame) == 2 * 40
    assert np.allclose(frame[frame["cluster_label"] == 1]["longitude"], 102.5)
    cells = model.cell_map.toPandas()
    inside = field.toPandas().merge(cells[cells["cluster_label"] == 1][["latitude", "longitude", "area"]])
    want = inside.groupby(["anchor_year", "i_interval"]).apply(lambda g: np.average(g["sst"], weights=g["area"]), include_groups=False)
    got = frame[frame["cluster_label"] == 1].set_index(["anchor_year", "i_interval"])["sst"]
    assert np.allclose(got.sort_index(), want.sort_index())
    preview = model.preview_correlation(field, target)
    assert preview.where("significant").count() == 12
    assert labels(model.preview_clusters(field, target)) == labels(model.cluster_map)
    gone = model.transform(field.where("not (anchor_year = 2003 and i_interval = -1 and longitude < 110)"))
    assert [r[0] for r in gone.select("cluster_label").distinct().collect()] == [-1]
    with pytest.raises(ValueError):
        model.get_correlation(field, target.where("anchor_year > 2001"))
    with pytest.raises(KeyError):
        RGDR(7, 2, 600, 0.05).get_correlation(field, target)
    with pytest.raises(ValueError):
        model.get_correlation(field.withColumn("other", F.lit(1.0)), target)
