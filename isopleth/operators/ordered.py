"""Running sums and neighbours in an order that no single task sees whole.

Rows are dealt by ranges of their order and kept in the shared folder; each range is one part. Parts are summed up to one
row each, and what lies before a part is added to the rows of the part. Ranges are cut at values, so that equal rows
are in one part: where a value may hold a large share of all rows, aggregate it before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.schema import same
from ..plans.session import cut

PART = "_part"


def _ranges(df: DataFrame, order: Sequence[str]) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, *order).withColumn(PART, F.spark_partition_id()))


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Adds the sum of a column over the rows of a group up to this one, in ascending order; a group may be of any size."""
    rows = _ranges(df, [*keys, *order])
    own = Window.partitionBy(*keys, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn(name, F.sum(value).over(own))
    sums = rows.groupBy(*keys, PART).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    before = sums.select(*keys, PART, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    joined = rows.alias("r").join(before.alias("b"), same("r", "b", [*keys, PART]))
    return joined.select(*[F.col(f"r.{c}") for c in df.columns], (F.col(f"r.{name}") + F.col("b._before")).alias(name))


def positions(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Adds the number of each row, from 0."""
    one = df.withColumn("_one", F.lit(1).cast("long"))
    return running_sum(one, [], order, "_one", name).drop("_one").withColumn(name, F.col(name) - 1)


def previous(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the next smaller value of a column without repeated values; NULL for the smallest."""
    rows = _ranges(df, [column])
    last = rows.groupBy(PART).agg(F.max(column).alias("_last"))
    border = last.select(PART, F.lag("_last").over(Window.orderBy(PART)).alias("_last"))  # a row for each part
    lag = F.lag(column).over(Window.partitionBy(PART).orderBy(column))
    joined = rows.withColumn(name, lag).join(border, PART)
    return joined.select(*df.columns, F.coalesce(name, "_last").alias(name))
