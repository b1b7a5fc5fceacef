"""What keeps single tasks and squares of group sizes away: blocks, ranges, tiles."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from isopleth.operators import alignment, calendar, cluster, ordered, rgdr, timeseries


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_running_sums_and_neighbours(spark):
    rng = np.random.default_rng(1)
    rows = [(None if g == 3 else int(g), None if i % 50 == 0 else int(x), float(w)) for i, (g, x, w) in enumerate(zip(rng.integers(0, 4, 500), rng.permutation(500), rng.uniform(0, 1, 500), strict=True))]
    df = spark.createDataFrame(rows, "g int, x int, w double").where("x is not null")
    got = {(r.g, r.x): r.c for r in ordered.running_sum(df, ["g"], ["x"], "w", "c").collect()}
    want = df.withColumn("c", F.sum("w").over(Window.partitionBy("g").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))).collect()
    assert len(got) == len(want) and all(got[r.g, r.x] == pytest.approx(r.c) for r in want)
    numbered = ordered.positions(df.select("x"), ["x"], "at").orderBy("x").collect()
    assert [r["at"] for r in numbered] == list(range(len(numbered)))
    before = ordered.previous(df.select("x"), "x", "b").orderBy("x").collect()
    assert [r.b for r in before] == [None, *[r.x for r in before[:-1]]]
    for empty in (ordered.positions(df.select("x").limit(0), ["x"], "at"), ordered.previous(df.select("x").limit(0), "x", "b")):
        assert empty.isEmpty()


@pytest.mark.parametrize("window,least", [(5, 1), (4, 3), (1, 1), (12, 2)])
def test_rolling_mean_in_blocks(spark, window, least):
    series = spark.range(700).select(F.expr("timestamp_ntz'2000-01-01' + make_dt_interval(cast(id as int))").alias("time"), F.when(F.col("id") % 9 > 0, F.sin("id")).alias("v"))
    field = series.crossJoin(spark.createDataFrame([(1.0,), (2.0,)], "latitude double")).withColumn("v", F.col("v") * F.col("latitude")).where("not (latitude = 2 and v > 1.9)")
    for df, dims in ((series, []), (field, ["latitude"])):
        cut = timeseries.rolling_mean(df, window, least, block=50)
        dense = timeseries.densify(df)
        frame = Window.partitionBy(*dims).orderBy("time").rowsBetween(-(window // 2), (window - 1) // 2)
        want = {(r.time, *(r[d] for d in dims)): r.m for r in dense.withColumn("m", F.when(F.count("v").over(frame) >= least, F.avg("v").over(frame))).collect()}
        got = {(r.time, *(r[d] for d in dims)): r.v for r in cut.collect()}
        assert got.keys() == want.keys()
        assert all((a is None) == (want[k] is None) and (a is None or a == pytest.approx(want[k])) for k, a in got.items())
    assert sorted(map(str, timeseries.rolling_mean(timeseries.densify(field), window, least, dense=True, block=50).collect())) == sorted(map(str, timeseries.rolling_mean(field, window, least).collect()))


def test_one_long_series_is_many_tasks(spark):
    series = spark.range(1_000_000).select(F.expr("timestamp_ntz'1900-01-01' + make_dt_interval(0, cast(id as int))").alias("time"), F.rand(3).alias("v"))
    out = timeseries.rolling_mean(series, 25)
    tasks = out.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in tasks) == 1_000_000
    assert "partitionSpec=[]" not in plan_of(out)
    blocks = -(-1_000_000 // timeseries.BLOCK)
    assert blocks > 8 and len(tasks) > 1  # small partitions are read together


def test_quantile_of_one_large_group(spark):
    rng = np.random.default_rng(8)
    n = 200_000
    v = np.concatenate([np.full(n // 3, 7.0), rng.normal(size=n - n // 3) * 10])
    rows = spark.createDataFrame([(float(x), float(w)) for x, w in zip(v, rng.integers(1, 4, n), strict=True)], "v double, w double").withColumn("g", F.lit(None).cast("int"))
    pdf = rows.toPandas().sort_values("v")
    w = pdf["w"].to_numpy()
    c, size = np.cumsum(w) / w.sum(), w.sum() ** 2 / (w**2).sum()
    for q in (0.0, 0.3, 1.0):
        low, high = (size - 1) * q / size, ((size - 1) * q + 1) / size
        share = np.clip(c, low, high) - np.clip(np.concatenate([[0], c[:-1]]), low, high)
        want = (pdf["v"].to_numpy() * share * size).sum()
        got = rgdr.weighted_groupby(rows, "g", "w", "quantile", q=q).collect()
        assert len(got) == 1 and got[0].g is None and got[0].v == pytest.approx(want, abs=1e-6)


def test_quantiles_of_several_variables_and_a_null_group(spark):
    rows = spark.createDataFrame([(None, 1.0, 5.0, 1.0), (None, 3.0, None, 1.0), ("a", 2.0, 7.0, 2.0), ("b", None, None, 1.0)], "g string, v double, u double, w double")
    got = {r.g: (r.v, r.u) for r in rgdr.weighted_groupby(rows, "g", "w", "quantile").collect()}
    assert got == {None: (2.0, 5.0), "a": (2.0, 7.0), "b": (None, None)}


def grid(spark, n, step, keep="true"):
    cells = spark.range(n * n).select((30 + F.floor(F.col("id") / n) * step).alias("latitude"), (200 + F.pmod("id", F.lit(n)) * step).alias("longitude")).where(keep)
    return cluster.numbered(cells).withColumn("sign", F.lit(1)).select("id", "sign", "latitude", "longitude")


def test_links_grow_with_cells(spark):
    """A grid ten times finer has a hundred times the cells, and all pairs ten thousand times."""
    sizes = []
    for n, step in ((12, 2.0), (120, 0.2)):
        points = grid(spark, n, step).cache()
        sizes.append((points.count(), cluster.links(points, 500).count()))
    assert sizes[1][0] == 100 * sizes[0][0]
    assert sizes[1][1] <= 100 * max(sizes[0])


def classes(n_of, edges):
    """Smallest id of each component, by union-find."""
    parent = {i: i for i in n_of}

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in parent}


def pairs_within(rows, eps):
    ids, sign, lat, lon = (np.array(x) for x in zip(*rows, strict=True))
    lat, lon = np.radians(lat), np.radians(lon)
    h = np.sin((lat[:, None] - lat) / 2) ** 2 + np.cos(lat[:, None]) * np.cos(lat) * np.sin((lon[:, None] - lon) / 2) ** 2
    near = (2 * 6371 * np.arcsin(np.minimum(1, np.sqrt(h))) <= eps) & (sign[:, None] == sign)
    return [(int(ids[i]), int(ids[j])) for i, j in zip(*np.nonzero(near), strict=True) if i < j]


@pytest.mark.parametrize("seed,n,eps", [(0, 300, 300), (1, 800, 120), (2, 60, 1500), (3, 2000, 60)])
def test_links_give_the_components_of_all_pairs(spark, seed, n, eps):
    rng = np.random.default_rng(seed)
    middle = rng.uniform((-88, 0), (89, 360), (6, 2))
    place = middle[rng.integers(0, 6, n)] + rng.normal(size=(n, 2)) * (2, 4)
    rows = [(i, 1 if i % 5 else -1, float(np.clip(a, -90, 90)), float(b % 360 - (360 if i % 2 else 0))) for i, (a, b) in enumerate(place)]
    points = spark.createDataFrame(rows, "id long, sign int, latitude double, longitude double")
    ids = [r[0] for r in rows]
    assert classes(ids, [(r.a, r.b) for r in cluster.links(points, eps).collect()]) == classes(ids, pairs_within(rows, eps))


def test_tiles_that_need_division(spark):
    # two thin curves in neighbouring tiles, close at one inner point only, and a pair exactly beyond reach
    t = np.linspace(-1, 1, 201)
    left = [(i, 1, float(40 + 0.3 * x), float(10 - 0.2 * x * x)) for i, x in enumerate(t)]
    km = 2 * np.pi * 6371 / 360
    for gap, joined in ((49.0, 1), (51.0, 2)):
        shift = gap / (km * np.cos(np.radians(40)))
        right = [(1000 + i, 1, float(40 + 0.3 * x), float(10 + shift + 0.2 * x * x)) for i, x in enumerate(t)]
        points = spark.createDataFrame(left + right, "id long, sign int, latitude double, longitude double")
        found = classes([r[0] for r in left + right], [(r.a, r.b) for r in cluster.links(points, 50.0).collect()])
        assert len(set(found.values())) == joined


def test_labels_of_many_clusters(spark):
    cells = grid(spark, 200, 0.2).drop("id", "sign").withColumn("corr", F.lit(0.5)).withColumn("p_val", F.lit(0.0))
    out = cluster.spherical_clusters(cells, 5, 0.05, label_type="int")
    assert out.schema["cluster_label"].dataType.simpleString() == "int" and out.agg(F.max("cluster_label")).first()[0] == 40_000


def test_sets_without_a_square_of_clusters(spark):
    labels = spark.createDataFrame([(s, float(y), 0.0, 1 + (y + s) // 3 % 3) for s in range(3) for y in range(12)], "split int, latitude double, longitude double, cluster_label int")
    sets = alignment.overlapping_clusters(labels)
    assert "Cartesian" not in plan_of(sets) and "NestedLoop" not in plan_of(sets)
    square = alignment.overlap_table(labels)
    others = F.collect_set(F.when(F.col("overlap") > 0.1, F.concat_ws("_", "split_b", "label_b")))
    want = square.groupBy("split_a", "label_a").agg(others.alias("o")).select(F.array_sort(F.array_distinct(F.concat("o", F.array(F.concat_ws("_", "split_a", "label_a"))))).alias("members")).distinct()
    assert sorted(map(str, sets.collect())) == sorted(map(str, want.collect()))
    assert alignment.overlapping_clusters(labels, -1.0).count() >= 1
    assert "partitionSpec=[]" not in plan_of(alignment.remove_overlapping(sets))


def test_calendar_within_a_day(spark):
    hours = calendar.Calendar("02-28 18:00").add_intervals("target", "6h", 2).add_intervals("target", "1d").add_intervals("precursor", "30min", 2).add_intervals("precursor", "1M").map_years(2023, 2024)
    rows = {(r.anchor_year, r.i_interval): (str(r.left), str(r.right)) for r in hours.intervals(spark).collect()}
    assert rows[2024, 1] == ("2024-02-28 18:00:00", "2024-02-29 00:00:00") and rows[2023, 3] == ("2023-03-01 06:00:00", "2023-03-02 06:00:00")
    assert rows[2024, -2] == ("2024-02-28 17:00:00", "2024-02-28 17:30:00") and rows[2024, -3] == ("2024-01-28 17:00:00", "2024-02-28 17:00:00")
    minutes = spark.range(60 * 24 * 60).select(F.expr("timestamp_ntz'2024-01-20' + make_dt_interval(0, 0, cast(id as int))").alias("time"), F.col("id").cast("double").alias("v"))
    got = {r.i_interval: r.v for r in calendar.resample(hours, minutes).collect()}
    bounds = {k[1]: v for k, v in rows.items() if k[0] == 2024}
    for i, (left, right) in bounds.items():
        assert got[i] == pytest.approx(minutes.where(f"time >= timestamp_ntz'{left}' and time < timestamp_ntz'{right}'").agg(F.avg("v")).first()[0])
    assert not hours.by_day and calendar.Calendar("02-28").add_intervals("target", "1M").by_day
    for bad in ("18:00", "02-28 18"):
        with pytest.raises(ValueError):
            calendar.Calendar(bad)
