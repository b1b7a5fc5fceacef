import datetime as dt
import math
import warnings

import numpy as np
import pandas as pd
import pytest

from isopleth.operators import timeseries
from isopleth.operators.preprocess import Preprocessor


def daily(spark, days=800, cells=2, value=lambda d, c: float(d + c)):
    first = dt.datetime(2011, 1, 1)
    rows = [(first + dt.timedelta(days=d), float(c), 180.0, value(d, c)) for d in range(days) for c in range(cells)]
    return spark.createDataFrame(rows, "time timestamp_ntz, latitude double, longitude double, sst double")


def test_trend_of_a_line_is_exact_and_removed(spark):
    data = daily(spark, 50, value=lambda d, c: 3.0 + 2.0 * d * (c + 1))
    trend = {r["latitude"]: r for r in timeseries.linear_trend(data).collect()}
    assert trend[0.0]["sst_slope"] * 86400 == pytest.approx(2.0)
    assert trend[1.0]["sst_slope"] * 86400 == pytest.approx(4.0)
    left = timeseries.subtract_trend(data, "linear", timeseries.get_trend(data)).toPandas()["sst"]
    assert np.abs(left).max() < 1e-6


def test_trend_matches_least_squares(spark):
    rng = np.random.default_rng(0)
    noise = rng.normal(size=60)
    data = daily(spark, 60, 1, lambda d, c: float(noise[d]))
    got = timeseries.subtract_trend(data, "linear", timeseries.get_trend(data)).orderBy("time").toPandas()["sst"].to_numpy()
    x = np.arange(60)
    assert np.allclose(got, noise - np.polyval(np.polyfit(x, noise, 1), x), atol=1e-9)


def test_trend_of_an_incomplete_cell_is_missing(spark):
    data = daily(spark, 20).where("not (latitude = 0 and day(time) = 5)")
    trend = {r["latitude"]: r["sst_slope"] for r in timeseries.linear_trend(data).collect()}
    assert trend[0.0] is None and trend[1.0] is not None
    nan = daily(spark, 20, value=lambda d, c: math.nan if (d, c) == (3, 0) else float(d))
    assert {r["latitude"]: r["sst_slope"] is None for r in timeseries.linear_trend(nan).collect()} == {0.0: True, 1.0: False}


@pytest.mark.parametrize("scale, key", [("monthly", lambda t: t.month), ("weekly", lambda t: t.isocalendar()[1]), ("daily", lambda t: t.timetuple().tm_yday)])
def test_climatology_is_the_mean_by_period(spark, scale, key):
    data = daily(spark, 800)
    frame = data.toPandas()
    frame["period"] = [key(t) for t in frame["time"]]
    want = frame.groupby(["period", "latitude"])["sst"].mean()
    got = timeseries.climatology(data, scale).toPandas().set_index(["period", "latitude"])["sst"]
    assert len(got) == len(want) and np.allclose(got.sort_index(), want.sort_index())
    anomaly = timeseries.subtract_climatology(data, scale, timeseries.climatology(data, scale)).toPandas()
    assert abs(anomaly["sst"].mean()) < 1e-9


def test_unseen_period_is_missing(spark):
    data = daily(spark, 60)
    normal = timeseries.climatology(data.where("month(time) = 1"), "monthly")
    got = timeseries.subtract_climatology(data, "monthly", normal).where("month(time) = 2")
    assert got.where("sst is not null").count() == 0


@pytest.mark.parametrize("window, least", [(5, 1), (4, 3), (1, 1), (7, 7)])
def test_rolling_mean_keeps_the_place_of_gaps(spark, window, least):
    gaps = {3, 4, 10}
    data = daily(spark, 16, 2).where("not (latitude = 0 and day(time) in (4, 5, 11))")
    got = timeseries.rolling_mean(data, window, least).where("latitude = 0").orderBy("time").toPandas()["sst"].to_numpy()
    values = [None if d in gaps else float(d) for d in range(16)]
    for d in range(16):
        part = [v for v in values[max(0, d - window // 2) : d + (window - 1) // 2 + 1] if v is not None]
        want = np.mean(part) if len(part) >= least else None
        assert (want is None and np.isnan(got[d])) or got[d] == pytest.approx(want)


def test_timescale_errors_and_warnings(spark):
    data = daily(spark, 30)
    with pytest.raises(ValueError):
        timeseries.check_temporal_resolution("hourly")
    with pytest.raises(ValueError):
        timeseries.climatology(data, "hourly")
    with pytest.raises(ValueError):
        timeseries.get_trend(data, "cubic")
    with pytest.raises(NotImplementedError):
        timeseries.subtract_trend(data, "cubic", data)
    with pytest.warns(UserWarning, match="temporal resolution"):
        assert not timeseries.check_data_resolution_match(data, "monthly")
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert timeseries.check_data_resolution_match(data, "daily")


def test_preprocessor_properties_and_errors(spark):
    data = daily(spark, 400)
    with pytest.raises(ValueError):
        Preprocessor(25, "hourly")
    model = Preprocessor(25, "daily")
    for name in ("trend", "climatology"):
        with pytest.raises(ValueError, match="The preprocessor has to be fit"):
            getattr(model, name)
    with pytest.raises(ValueError):
        model.transform(data)
    with pytest.raises(ValueError):
        model.fit(pd.DataFrame())
    with pytest.raises(ValueError):
        model.fit(data.withColumnRenamed("time", "date"))
    with pytest.raises(ValueError, match="Detrending is set to `None`"):
        _ = Preprocessor(25, "daily", detrend=None).fit(data).trend
    with pytest.raises(ValueError, match="subtract_climatology is set to `False`"):
        _ = Preprocessor(25, "daily", subtract_climatology=False).climatology


def test_preprocessor_chain(spark):
    data = daily(spark, 800, value=lambda d, c: 5.0 * c + 0.01 * d + math.sin(d / 58.0))
    full = Preprocessor(5, "daily").fit(data)
    smooth = timeseries.rolling_mean(data, 5)
    normal = timeseries.climatology(smooth, "daily")
    trend = timeseries.linear_trend(timeseries.subtract_climatology(smooth, "daily", normal))
    want = timeseries.subtract_trend(timeseries.subtract_climatology(data, "daily", normal), "linear", trend)
    keys = ["time", "latitude"]
    a, b = full.transform(data).toPandas().sort_values(keys), want.toPandas().sort_values(keys)
    assert np.allclose(a["sst"], b["sst"])
    same = Preprocessor(None, "daily", subtract_climatology=False, detrend=None).fit_transform(data)
    assert sorted(same.collect()) == sorted(data.collect())
    constant = daily(spark, 800, value=lambda d, c: 7.0)
    assert Preprocessor(None, "monthly", subtract_climatology=False, detrend=None).fit_transform(constant).where("sst <> 7").count() == 0


def test_empty_table(spark):
    empty = daily(spark, 2).where("false")
    assert timeseries.rolling_mean(empty, 3).count() == 0
    assert timeseries.climatology(empty, "daily").count() == 0
    assert timeseries.linear_trend(empty).count() == 0
