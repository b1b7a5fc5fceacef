"""NetCDF files: the format against a file made by hand, parts and pruning, writing and reading."""

import struct
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from isopleth.sources import fields, netcdf


def text(x):
    return struct.pack(">i", len(x)) + x.encode() + b"\0" * (-len(x) % 4)


def hand_made(path, version=1, records=3, record_axis=True, lat=4, lon=5, filler=None):
    """A file of shorts with scale, offset and fill value; records of two padded variables."""
    wide = ">q" if version == 5 else ">i"
    number = lambda n: struct.pack(wide, n)
    long_text = lambda x: number(len(x)) + x.encode() + b"\0" * (-len(x) % 4)
    offset = lambda n: struct.pack(">i" if version == 1 else ">q", n)
    attribute = lambda name, kind, n, raw: long_text(name) + struct.pack(">i", kind) + number(n) + raw + b"\0" * (-len(raw) % 4)
    days = attribute("units", 2, 30, b"hours since 2000-01-01 12:00:0")
    packed = attribute("scale_factor", 6, 1, struct.pack(">d", 0.5)) + attribute("add_offset", 5, 1, struct.pack(">f", 10)) + attribute("_FillValue", 3, 1, struct.pack(">h", -999))
    listed = lambda tag, n, raw: struct.pack(">i", tag if n else 0) + number(n) + raw
    sizes = {"lat": lat * 4, "lon": lon * 8, "time": 4, "sst": lat * lon * 2, "flag": lat * lon}

    def header(begin):
        def var(name, dims, own, n_own, kind):
            return long_text(name) + number(len(dims)) + b"".join(map(number, dims)) + listed(12, n_own, own) + struct.pack(">i", kind) + number(sizes[name]) + offset(begin[name])

        dims = long_text("time") + number(0 if record_axis else records) + long_text("lat") + number(lat) + long_text("lon") + number(lon)
        every = var("lat", [1], b"", 0, 5) + var("lon", [2], b"", 0, 6) + var("time", [0], days, 1, 4) + var("sst", [0, 1, 2], packed, 3, 3) + var("flag", [0, 1, 2], b"", 0, 1)
        return b"CDF" + bytes([version]) + number(records if record_axis else 0) + listed(10, 3, dims) + listed(12, 1, attribute("title", 2, 5, b"small")) + listed(11, 5, every)

    at = len(header(dict.fromkeys(sizes, 0)))
    begin, padded = {}, lambda n: n + -n % 4
    for name in sizes:
        begin[name] = at
        at += padded(sizes[name]) * (1 if record_axis or name in ("lat", "lon") else records)
    values = np.arange(records * lat * lon).reshape(records, lat, lon).astype(">i2") if filler is None else None
    with open(path, "wb") as out:
        out.write(header(begin))
        for raw in (np.linspace(50, 50 - 5 * (lat - 1), lat).astype(">f4"), np.arange(lon).astype(">f8")):
            out.write(raw.tobytes() + b"\0" * (-raw.nbytes % 4))
        if filler is not None:  # only the times, and holes elsewhere
            record = padded(4) + padded(sizes["sst"]) + padded(sizes["flag"])
            for i in range(records):
                out.seek(begin["time"] + i * record)
                out.write(struct.pack(">i", 24 * i))
            out.truncate(begin["time"] + records * record)
            return None
        values[1, 2, 3] = -999
        flags = (np.arange(records * lat * lon) % 100).astype(">i1").reshape(records, lat, lon)
        times = (24 * np.arange(records)).astype(">i4")
        pad = lambda raw: raw + b"\0" * (-len(raw) % 4)
        if record_axis:
            for i in range(records):
                out.write(pad(times[i : i + 1].tobytes()) + pad(values[i].tobytes()) + pad(flags[i].tobytes()))
        else:
            out.write(pad(times.tobytes()) + pad(values.tobytes()) + pad(flags.tobytes()))
    return values


@pytest.mark.parametrize("version,record_axis", [(1, True), (2, True), (5, True), (1, False), (5, False)])
def test_values_of_all_versions(spark, tmp_path, version, record_axis):
    values = hand_made(tmp_path / "a.nc", version, record_axis=record_axis)
    df = netcdf.read_netcdf(spark, str(tmp_path / "a.nc"), partition_bytes=50)
    assert [(f.name, f.dataType.simpleString()) for f in df.schema] == [("time", "timestamp_ntz"), ("lat", "double"), ("lon", "double"), ("sst", "double"), ("flag", "double")]
    assert df.rdd.getNumPartitions() > 1
    rows = {(r.time, r.lat, r.lon): (r.sst, r.flag) for r in df.collect()}
    assert len(rows) == values.size
    for i in range(3):
        for j in range(4):
            for k in range(5):
                got = rows[datetime(2000, 1, 1 + i, 12), 50.0 - 5 * j, float(k)]
                want = None if (i, j, k) == (1, 2, 3) else int(values[i, j, k]) * 0.5 + 10
                assert got == (want, float((i * 20 + j * 5 + k) % 100))


def test_ranges_and_missing(spark, tmp_path):
    hand_made(tmp_path / "a.nc", records=9)
    path = str(tmp_path / "*.nc")
    some = netcdf.read_netcdf(spark, path, ["sst"], {"time": (datetime(2000, 1, 2), datetime(2000, 1, 4)), "lat": (None, 45), "lon": (1, 2)}, partition_bytes=50)
    every = netcdf.read_netcdf(spark, path, ["sst"])
    want = every.where((F.col("time") >= F.lit(datetime(2000, 1, 2))) & (F.col("time") <= F.lit(datetime(2000, 1, 4))) & (F.col("lat") <= 45) & F.col("lon").between(1, 2))
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, want.collect())) and some.count() == 2 * 3 * 2
    assert some.rdd.getNumPartitions() < every.rdd.getNumPartitions() + 9
    assert netcdf.read_netcdf(spark, path, ["sst"], missing=False).count() == every.count() - 1
    assert netcdf.read_netcdf(spark, path, ["sst"], {"lat": (80, 90)}).count() == 0
    with pytest.raises(Exception, match="no variables"):
        netcdf.read_netcdf(spark, path, ["other"]).count()


def test_a_file_beyond_memory_is_read_in_parts(spark, tmp_path):
    # 24 GB of holes on disk: 4 000 days of 1 000 x 2 000 cells
    hand_made(tmp_path / "large.nc", version=2, records=4000, lat=1000, lon=2000, filler=True)
    assert (tmp_path / "large.nc").stat().st_size > 23e9
    reader = netcdf.NetcdfReader({"path": str(tmp_path / "large.nc"), "variables": "sst"})
    parts = reader.partitions()
    assert len(parts) == 500  # eight days each
    some = netcdf.read_netcdf(spark, str(tmp_path / "large.nc"), ["sst"], {"time": (datetime(2005, 1, 1), datetime(2005, 1, 3)), "lat": (40, 50)})
    assert some.rdd.getNumPartitions() <= 2
    days, n = some.agg(F.countDistinct("time"), F.count("*")).first()
    assert days == 2 and n == 2 * 3 * 2000


def test_written_files_are_read_again(spark, tmp_path):
    rows = spark.range(4000).select(F.expr("timestamp_ntz'2001-01-01 06:00:00' + make_dt_interval(cast(id div 40 as int))").alias("time"), (F.col("id") % 8).cast("double").alias("latitude"), (F.floor(F.col("id") / 8) % 5).cast("double").alias("longitude"), F.when(F.col("id") % 7 > 0, F.sqrt("id")).alias("a"), (-F.col("id")).cast("double").alias("b"))
    rows = rows.where("id % 11 > 0" if "id" in rows.columns else "b % 11 <> 0")
    fields.write_field(rows, str(tmp_path / "out"), "netcdf", mode="append")
    names = sorted(x.name for x in (tmp_path / "out").iterdir())
    assert len(names) == 8 and all(x.endswith(".nc") for x in names)
    back = fields.read_field(spark, str(tmp_path / "out"), fmt="netcdf", missing="false")
    assert sorted(map(str, back.select(rows.columns).collect())) == sorted(map(str, rows.collect()))
    fields.write_field(rows.limit(10), str(tmp_path / "out"), "netcdf", mode="overwrite")
    assert fields.read_field(spark, str(tmp_path / "out"), fmt="netcdf", missing="false").count() == 10


def test_rows_that_cannot_be_written(spark, tmp_path):
    row = "SELECT timestamp_ntz'2001-01-01' AS time, 1D AS latitude, 2D AS longitude, 3D AS v"
    for bad, message in ((f"{row} UNION ALL {row}", "same coordinates"), (row.replace("1D", "CAST(NULL AS DOUBLE)"), "missing values")):
        with pytest.raises(Exception, match=message):
            netcdf.write_netcdf(spark.sql(bad), str(tmp_path / "bad"))
    netcdf.write_netcdf(spark.sql(row).limit(0), str(tmp_path / "none"))
    with pytest.raises(Exception, match="no files"):
        netcdf.read_netcdf(spark, str(tmp_path / "none")).count()


def test_times_and_headers():
    units = lambda u, c="standard": netcdf.Variable("t", ("t",), ">f8", 0, False, {"units": u, "calendar": c})
    for u, raw, want in (("days since 1970-01-01", [1.5], 129_600_000_000), ("seconds since 1970-01-02T01:00:00Z", [2.0], 90_002_000_000), ("hours since 1969-12-31", [24.0], 0)):
        assert netcdf._coordinates(units(u), np.array(raw)).tolist() == [want]
    for bad in (units("months since 1970-01-01"), units("days since 1970-01-01", "noleap")):
        with pytest.raises(ValueError):
            netcdf._coordinates(bad, np.array([1.0]))
    with pytest.raises(ValueError, match="not a NetCDF"):
        netcdf.parse_header(b"\x89HDF\r\n\x1a\n", 8)
