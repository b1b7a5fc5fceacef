"""Fields and series derived from the order tables, in the form of gridded climate data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schema import ANCHOR_YEAR, INTERVAL, LATITUDE, LONGITUDE, TIME

CELLS, ROW = 65, 13
#: Years of a monthly field: those of which the table has all months, so that its series are complete.
WHOLE = "whole years"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cells(rows: DataFrame, cells: int) -> DataFrame:
    cell = F.pmod(F.col("l_partkey"), F.lit(cells))
    return rows.select(F.col("l_shipdate").alias(TIME), (47.5 - 5 * F.floor(cell / ROW)).cast("double").alias(LATITUDE), (177.5 + 5 * F.pmod(cell, F.lit(ROW))).cast("double").alias(LONGITUDE), F.log("l_extendedprice").alias("value"))


def field_daily(spark: SparkSession, sf_dir: str, cells: int = CELLS) -> DataFrame:
    """time, latitude, longitude, value: mean logarithm of the prices of a cell's parts on a day."""
    return _cells(table(spark, sf_dir, "lineitem"), cells).groupBy(TIME, LATITUDE, LONGITUDE).agg(F.avg("value").alias("value"))


def _years(column: str, years: tuple[int, int]):
    return F.year(column).between(*years)


def whole_years(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """First and last year that begins and ends within the table, to the month."""
    low, high = table(spark, sf_dir, "lineitem").agg(F.min("l_shipdate"), F.max("l_shipdate")).first()
    return (1, 0) if low is None else (low.year + (low.month > 1), high.year - (high.month < 12))


def field_monthly(spark: SparkSession, sf_dir: str, cells: int = CELLS, years: tuple[int, int] | str | None = WHOLE) -> DataFrame:
    """years: None for all rows."""
    years = whole_years(spark, sf_dir) if years == WHOLE else years
    month = F.date_trunc("month", F.col(TIME)).cast("timestamp_ntz")
    rows = _cells(table(spark, sf_dir, "lineitem"), cells)
    rows = rows.where(_years(TIME, years)) if years else rows
    return rows.groupBy(month.alias(TIME), LATITUDE, LONGITUDE).agg(F.avg("value").alias("value"))


def anchor_years(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """First and last year of which both tables span April 1st to November 30th."""
    spans = [table(spark, sf_dir, t).agg(F.min(c).cast("date"), F.max(c).cast("date")).first() for t, c in (("lineitem", "l_shipdate"), ("orders", "o_orderdate"))]
    if any(None in span for span in spans):
        return 1, 0
    low, high = max(a for a, _ in spans), min(b for _, b in spans)
    return low.year + ((low.month, low.day) > (4, 1)), high.year - ((high.month, high.day) < (11, 30))


def target_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").alias(TIME)).agg(F.avg(F.log("o_totalprice")).alias("value"))


def _interval(column: str):
    month = F.month(column)
    return F.when(month >= 8, month - 7).otherwise(month - 8).cast("int")


def precursor(spark: SparkSession, sf_dir: str, cells: int = CELLS, years: tuple[int, int] | None = None) -> DataFrame:
    """anchor_year, i_interval (-4 to 4 around August 1st), latitude, longitude, value; years: those of both tables, if not given."""
    rows = _cells(table(spark, sf_dir, "lineitem"), cells).where(_years(TIME, years or anchor_years(spark, sf_dir)) & F.month(TIME).between(4, 11))
    return rows.groupBy(F.year(TIME).alias(ANCHOR_YEAR), _interval(TIME).alias(INTERVAL), LATITUDE, LONGITUDE).agg(F.avg("value").alias("value"))


def target(spark: SparkSession, sf_dir: str, years: tuple[int, int] | None = None) -> DataFrame:
    rows = table(spark, sf_dir, "orders").where(_years("o_orderdate", years or anchor_years(spark, sf_dir)) & F.month("o_orderdate").between(4, 11))
    return rows.groupBy(F.year("o_orderdate").alias(ANCHOR_YEAR), _interval("o_orderdate").alias(INTERVAL)).agg(F.avg(F.log("o_totalprice")).alias("value"))


def event_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """time, event_type, value: mean of a day's events of a type."""
    day = F.date_trunc("day", F.col("ts")).cast("timestamp_ntz")
    return table(spark, sf_dir, "events").groupBy(day.alias(TIME), "event_type").agg(F.avg("value").alias("value"))


def label_cube(spark: SparkSession, sf_dir: str, cells: int = CELLS) -> DataFrame:
    """split, latitude, longitude, cluster_label: regions of high (1, 2, ...) and low (-1, -2, ...) mean quantity.

    Orders are dealt into four splits by their key; a cell's label in a split is 0 if its mean is within 0.3 of 25.5,
    else its sign times the number of its five columns.
    """
    cell = F.pmod(F.col("l_partkey"), F.lit(cells))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.pmod("l_orderkey", F.lit(4)).cast("int").alias("split"), cell.alias("cell")).agg(F.avg("l_quantity").alias("mean"))
    sign = F.when(F.col("mean") > 25.8, 1).when(F.col("mean") < 25.2, -1).otherwise(0)
    column = F.pmod("cell", F.lit(ROW))
    label = (sign * (F.floor(column / 5) + 1)).cast("int")
    return rows.select("split", (47.5 - 5 * F.floor(F.col("cell") / ROW)).cast("double").alias(LATITUDE), (177.5 + 5 * column).cast("double").alias(LONGITUDE), label.alias("cluster_label"))
