"""Fields from and to storage, and from arrays in memory."""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schema import TIME, missing_as_null, require
from . import netcdf


def read_field(spark: SparkSession, path: str, names: Mapping[str, str] | None = None, fmt: str = "parquet", **options) -> DataFrame:
    """A long table from storage; names: columns of the file to columns of the field, others go. fmt: also `netcdf`."""
    if fmt == netcdf.NAME:
        netcdf.register(spark)
    raw = spark.read.format(fmt).options(**options).load(path)
    if names:
        require(raw, *names)
        raw = raw.select(*[F.col(a).alias(b) for a, b in names.items()])
    return missing_as_null(raw)


def write_field(field: DataFrame, path: str, fmt: str = "parquet", by_year: bool = False, time: str = TIME, mode: str = "errorifexists") -> None:
    """A long table to storage; by_year: in folders of years, which filters on `year` prune."""
    if fmt == netcdf.NAME:
        return netcdf.write_netcdf(field, path, time, mode)
    out = field.withColumn("year", F.year(time)).write.partitionBy("year") if by_year else field.write
    out.format(fmt).mode(mode).save(path)


def from_arrays(spark: SparkSession, coordinates: Mapping[str, list], variables: Mapping[str, object]) -> DataFrame:
    """A long table from dense arrays, whose axes are the coordinates in order."""
    index = pd.MultiIndex.from_product(list(coordinates.values()), names=list(coordinates))
    frame = pd.DataFrame({name: pd.Series(getattr(x, "reshape", lambda _, x=x: x)(-1), dtype="float64") for name, x in variables.items()})
    frame.index = index
    return missing_as_null(spark.createDataFrame(frame.reset_index()), list(variables))


def from_xarray(spark: SparkSession, data) -> DataFrame:
    """A long table from an xarray object in memory, where xarray is installed; for files there is `netcdf.read_netcdf`."""
    data = data.to_dataset(name=data.name or "value") if hasattr(data, "to_dataset") and not hasattr(data, "data_vars") else data
    return from_arrays(spark, {d: list(data[d].values) for d in data.dims}, {v: data[v].transpose(*data.dims).values for v in data.data_vars})
