"""Long tables in place of labelled arrays: roles of columns, validation, and missing values.

A field is a table with a column for each dimension and a double column for each variable. A missing value is NULL, or
no row at all; NaN becomes NULL on the way in. Statistics that need complete series compare counts with the number of
samples, because an absent row is invisible to an aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIME, LATITUDE, LONGITUDE = "time", "latitude", "longitude"
ANCHOR_YEAR, INTERVAL = "anchor_year", "i_interval"
#: Columns that are dimensions wherever they occur.
DIMENSIONS = (TIME, LATITUDE, LONGITUDE, ANCHOR_YEAR, INTERVAL, "cluster_label", "split")

_NUMERIC = (T.DoubleType, T.FloatType, T.DecimalType, T.IntegralType)


def require(df: DataFrame, *columns: str) -> None:
    """ValueError unless all columns are there."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are not in the data, which has {df.columns}")


def check_input(data: DataFrame, time: str = TIME) -> None:
    """ValueError unless the data are a table with a time column."""
    if not isinstance(data, DataFrame) and not hasattr(data, "sparkSession"):
        raise ValueError(f"Input data has to be a Spark DataFrame, not {type(data)}")
    if time not in data.columns:
        raise ValueError(f"Analysis is done of the '{time}' dimension, but the input data only has columns: {data.columns}")


def dims_of(df: DataFrame, *without: str) -> list[str]:
    """Dimension columns, and others that are not numbers, without some."""
    return [f.name for f in df.schema if f.name not in without and (f.name in DIMENSIONS or not isinstance(f.dataType, _NUMERIC))]


def variables_of(df: DataFrame) -> list[str]:
    """Numeric columns that are no dimensions."""
    return [f.name for f in df.schema if f.name not in DIMENSIONS and isinstance(f.dataType, _NUMERIC)]


def missing_as_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Variables as doubles, with NULL for NaN."""
    return df.withColumns({c: number(F.col(c)) for c in (variables_of(df) if columns is None else columns)})


def number(column: Column) -> Column:
    value = column.cast("double")
    return F.when(~F.isnan(value), value)


def same(left: str, right: str, keys: Sequence[str]) -> Column:
    """Equality of aliased tables on keys, where NULL equals NULL."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return out
