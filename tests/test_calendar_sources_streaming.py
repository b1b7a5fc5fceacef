import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from isopleth.operators import calendar as cal
from isopleth.operators.preprocess import Preprocessor
from isopleth.sources import fields
from isopleth.streaming import anomalies


def test_intervals_are_half_open_around_the_anchor(spark):
    rows = {(r["anchor_year"], r["i_interval"]): (str(r["left"]), str(r["right"])) for r in cal.daily_calendar("10-15", "180d").map_years(2020, 2021).intervals(spark).collect()}
    assert rows == {
        (2020, 1): ("2020-10-15", "2021-04-13"), (2020, -1): ("2020-04-18", "2020-10-15"),
        (2021, 1): ("2021-10-15", "2022-04-13"), (2021, -1): ("2021-04-18", "2021-10-15"),
    }
    assert min(r["i_interval"] for r in cal.daily_calendar("08-01", "30d").map_years(2000, 2000).intervals(spark).collect()) == -11
    assert cal.monthly_calendar("08-01").map_years(2000, 2000).intervals(spark).count() == 12
    assert cal.weekly_calendar("08-01", "2W").map_years(2000, 2000).show(spark).first()["i_interval"] == 1


def test_calendar_errors(spark):
    for bad in (lambda: cal.Calendar("8/1"), lambda: cal.Calendar("08-01").add_intervals("other", "1M"), lambda: cal.Calendar("08-01").add_intervals("target", "1 fortnight"), lambda: cal.Calendar("08-01").add_intervals("target", "1M").intervals(spark), lambda: cal.Calendar("08-01").map_years(2000, 2001).intervals(spark)):
        with pytest.raises(ValueError):
            bad()


def test_resample_against_a_loop(spark):
    first = dt.datetime(2009, 12, 1)
    data = [(first + dt.timedelta(days=d), float(c), float(d * (c + 1))) for d in range(900) for c in range(2)]
    df = spark.createDataFrame(data, "time timestamp_ntz, latitude double, v double")
    calendar = cal.Calendar("08-01").add_intervals("target", "1M", 2).add_intervals("precursor", "30d", 3).map_to_data(df)
    got = {(r["anchor_year"], r["i_interval"], r["latitude"]): r["v"] for r in cal.resample(calendar, df).collect()}
    spans = calendar.intervals(spark).collect()
    assert {r["anchor_year"] for r in spans} == {2010, 2011}
    for r in spans:
        for c in range(2):
            part = [v for t, lat, v in data if lat == c and r["left"] <= t.date() < r["right"]]
            assert got[r["anchor_year"], r["i_interval"], float(c)] == pytest.approx(np.mean(part))
    assert len(got) == 2 * len(spans)


def test_splits(spark):
    df = spark.createDataFrame([(y, 1, float(y)) for y in range(2000, 2010)], "anchor_year int, i_interval int, v double")
    folds = cal.kfold_splits(df, 3)
    assert folds.groupBy("anchor_year").agg(F.sum((~F.col("is_train")).cast("int")).alias("n")).where("n <> 1").count() == 0
    train, test = cal.train_test(df, folds, 0)
    assert train.count() + test.count() == 10 and {r["anchor_year"] for r in test.collect()} == {2000, 2001, 2002}
    some = cal.shuffle_splits(df, 4, 0.25, 1)
    assert {r["n"] for r in some.where("not is_train").groupBy("split").agg(F.count("*").alias("n")).collect()} == {3}
    assert sorted(some.collect()) == sorted(cal.shuffle_splits(df, 4, 0.25, 1).collect())
    own = cal.explicit_splits(spark, [[2000, 2001]], [[2002]])
    assert cal.split_rows(df, own).count() == 3
    with pytest.raises(ValueError):
        cal.kfold_splits(df, 11)


def test_arrays_and_files(spark, tmp_path):
    values = np.arange(12, dtype=float).reshape(3, 2, 2)
    values[1, 1, 1] = math.nan
    df = fields.from_arrays(spark, {"time": [dt.datetime(2000, 1, d) for d in (1, 2, 3)], "latitude": [10.0, 5.0], "longitude": [0.0, 5.0]}, {"sst": values})
    assert df.count() == 12 and df.where("sst is null").count() == 1
    assert df.where("day(time) = 2 and latitude = 10 and longitude = 5").first()["sst"] == 5.0
    fields.write_field(df, str(tmp_path / "f"), by_year=True)
    back = fields.read_field(spark, str(tmp_path / "f"), {"time": "time", "latitude": "latitude", "longitude": "longitude", "sst": "value"})
    assert back.agg(F.sum("value")).first()[0] == df.agg(F.sum("sst")).first()[0]
    with pytest.raises(ValueError):
        fields.read_field(spark, str(tmp_path / "f"), {"lat": "latitude"})


def test_stream_equals_batch(spark, tmp_path):
    first = dt.datetime(2011, 1, 1)
    rows = [(first + dt.timedelta(days=d), float(c), 0.0, math.sin(d) + c) for d in range(90) for c in range(2)]
    schema = "time timestamp_ntz, latitude double, longitude double, sst double"
    data = spark.createDataFrame(rows, schema)
    data.repartition(3).write.parquet(str(tmp_path / "in"))
    model = Preprocessor(None, "monthly").fit(data)
    out = anomalies.transform_stream(model, anomalies.read_stream(spark, str(tmp_path / "in"), schema))
    running = out.writeStream.format("memory").queryName("anomalies").outputMode("append").trigger(availableNow=True).start()
    assert running.awaitTermination(120)
    got, want = spark.table("anomalies").toPandas(), model.transform(data).toPandas()
    keys = ["time", "latitude"]
    assert np.allclose(got.sort_values(keys)["sst"], want.sort_values(keys)["sst"])
    means = anomalies.windowed_means(anomalies.read_stream(spark, str(tmp_path / "in"), schema), "30 days", "1 day")
    running = means.writeStream.format("memory").queryName("means").outputMode("complete").trigger(availableNow=True).start()
    assert running.awaitTermination(120)
    assert spark.table("means").count() >= 6
