"""Anomalies of a stream: what was fitted on a table is joined to the stream as a static side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schema import TIME, dims_of, missing_as_null, require, variables_of
from ..operators.preprocess import Preprocessor


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 8) -> DataFrame:
    """A field that arrives as Parquet files in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def transform_stream(preprocessor: Preprocessor, stream: DataFrame) -> DataFrame:
    """Anomalies of a stream, row by row; no state is kept."""
    return preprocessor.transform(stream)


def windowed_means(stream: DataFrame, width: str, late: str, time: str = TIME) -> DataFrame:
    """Means of each cell over windows of event time; rows later than `late` are dropped, windows close behind it."""
    require(stream, time)
    data = missing_as_null(stream).withColumn(time, F.col(time).cast("timestamp"))
    values = variables_of(data)
    grouped = data.withWatermark(time, late).groupBy(F.window(time, width).alias("window"), *dims_of(data, time))
    return grouped.agg(*[F.avg(v).alias(v) for v in values]).withColumn(time, F.col("window.start")).drop("window")
