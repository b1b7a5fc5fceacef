"""Rolling means, climatologies, anomalies and linear trends of long tables."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.schema import TIME, dims_of, missing_as_null, require, same, variables_of
from .ordered import positions, previous

TIMESCALES = ("monthly", "weekly", "daily")


def check_temporal_resolution(timescale: str) -> str:
    """The timescale itself; ValueError if it is none of the three."""
    if timescale not in TIMESCALES:
        # fixed values, here and below: messages that callers know
        raise ValueError("Given temporal resolution is not supported. Please choose from 'monthly', 'weekly', 'daily'.")
    return timescale


def period(time: Column, timescale: str) -> Column:
    """Month, ISO week or day of the year."""
    if timescale not in TIMESCALES:
        raise ValueError("Given timescale is not supported.")
    return {"monthly": F.month, "weekly": F.weekofyear, "daily": F.dayofyear}[timescale](time)


def seconds(time: Column) -> Column:
    """Seconds since 1970 of the wall-clock time, as a double, whatever the session's time zone."""
    at = time.cast("timestamp_ntz")
    return F.datediff(at.cast("date"), F.lit("1970-01-01").cast("date")) * 86400.0 + F.hour(at) * 3600.0 + F.minute(at) * 60.0 + F.date_part(F.lit("SECOND"), at).cast("double")


def resolution_days(df: DataFrame, time: str = TIME) -> DataFrame:
    """One row: the median step between successive distinct times, in whole days (`days`)."""
    require(df, time)
    axis = previous(df.select(F.col(time).alias("t")).where("t is not null").distinct(), "t", "before")
    step = seconds(F.col("t")) - seconds(F.col("before"))
    return axis.select(step.alias("step")).agg(F.floor(F.median("step") / 86400).cast("int").alias("days"))


#: Days of a step that fits a timescale: lowest and highest.
STEPS = {"monthly": (28, 31), "weekly": (7, 7), "daily": (1, 1)}


def fits(days: Column, timescale: str) -> Column:
    return days.between(*STEPS[check_temporal_resolution(timescale)])


def check_data_resolution_match(df: DataFrame, timescale: str, time: str = TIME) -> bool:
    """Whether the data's step fits the timescale; warns if not."""
    within = resolution_days(df, time).select(F.coalesce(fits(F.col("days"), timescale), F.lit(True)).alias("fits")).first()["fits"]
    if not within:
        warnings.warn("The temporal resolution of data does not completely match the target timescale. Please check your input data.", stacklevel=2)
    return within


def densify(df: DataFrame, time: str = TIME) -> DataFrame:
    """A row for every time of every cell; values that were absent are NULL."""
    dims = dims_of(df, time)
    if not dims:
        return df
    return _dense(df, dims, time, df.select(time).distinct()).drop("_at")


def _dense(df: DataFrame, dims: list[str], time: str, axis: DataFrame) -> DataFrame:
    """The cells of a table at all times of the axis, with the axis' other columns."""
    # as many rows as the result has; the optimizer knows the sizes of both sides when it joins them
    grid = df.select(*dims).distinct().crossJoin(axis)
    keys = [*dims, time]
    more = [c for c in axis.columns if c != time]
    return grid.alias("g").join(df.alias("d"), same("g", "d", keys), "left").select(*[F.col(f"g.{k}") for k in [*keys, *more]], *[F.col(f"d.{v}") for v in df.columns if v not in keys])


#: Samples of a series that are smoothed by one task, at least.
BLOCK = 1 << 16


def rolling_mean(df: DataFrame, window: int, min_periods: int = 1, time: str = TIME, dense: bool = False, block: int = BLOCK) -> DataFrame:
    """Centred mean over `window` samples of each cell; even windows take one more sample before than after.

    Missing samples keep their place in the window and are skipped; with fewer than min_periods valid samples the mean
    is NULL. dense: the table has a row for every time of every cell already. A series is cut into blocks of at least
    `block` samples, which also get the samples around them that their windows need, so that one series is no single task.
    """
    require(df, time)
    df = missing_as_null(df)
    dims, values = dims_of(df, time), variables_of(df)
    before, after = window // 2, (window - 1) // 2
    length = max(block, 2 * window)
    if not dims:
        table = positions(df, [time], "_at")
    else:
        axis = positions(df.select(time).distinct(), [time], "_at")
        table = df.alias("d").join(axis.alias("a"), same("d", "a", [time])).select("d.*", "_at") if dense else _dense(df, dims, time, axis)
    own = F.floor(F.col("_at") / length)
    # the last `before` samples of a block are also needed by the next one, the first `after` by the one before
    copies = F.array_compact(F.array(own, F.when(F.col("_at") - own * length >= length - before, own + 1), F.when((F.col("_at") - own * length < after) & (own > 0), own - 1)))
    cut_up = table.withColumn("_block", F.explode(copies))
    frame = Window.partitionBy(*dims, "_block").orderBy("_at").rowsBetween(-before, after)
    mean = lambda v: F.when(F.count(v).over(frame) >= min_periods, F.avg(v).over(frame)).alias(v)
    return cut_up.select(*dims, time, "_at", "_block", *[mean(v) for v in values]).where(own == F.col("_block")).select(*dims, time, *values)


def climatology(df: DataFrame, timescale: str, time: str = TIME) -> DataFrame:
    """Mean of each cell over the rows of a period of the year: columns `period`, the cell's, and the variables."""
    require(df, time)
    own = period(F.col(time), timescale)
    df = missing_as_null(df)
    return df.groupBy(own.alias("period"), *dims_of(df, time)).agg(*[F.avg(v).alias(v) for v in variables_of(df)])


def subtract_climatology(df: DataFrame, timescale: str, normal: DataFrame, time: str = TIME) -> DataFrame:
    """Anomalies; NULL where the climatology has no such period or cell."""
    require(df, time)
    own = period(F.col(time), timescale)
    df = missing_as_null(df)
    dims, values = dims_of(df, time), variables_of(df)
    data = df.withColumn("period", own)
    joined = data.alias("d").join(normal.alias("n"), same("d", "n", ["period", *dims]), "left")
    return joined.select(*[F.col(f"d.{c}") if c not in values else (F.col(f"d.{c}") - F.col(f"n.{c}")).alias(c) for c in df.columns])


def linear_trend(df: DataFrame, time: str = TIME) -> DataFrame:
    """Least-squares slope (per second) and intercept (at 1970) of each cell's variables: `<v>_slope`, `<v>_intercept`.

    NULL for a cell whose series is not complete over the times of the table.
    """
    require(df, time)
    df = missing_as_null(df)
    dims, values = dims_of(df, time), variables_of(df)
    x = seconds(F.col(time))
    samples = F.broadcast(df.agg(F.countDistinct(time).alias("_n")))  # one row
    stats = [e for v in values for e in (F.regr_slope(v, x).alias(f"{v}_slope"), F.regr_intercept(v, x).alias(f"{v}_intercept"), F.count(v).alias(f"_{v}"))]
    fitted = (df.groupBy(*dims) if dims else df.groupBy()).agg(*stats).crossJoin(samples)
    return fitted.select(*dims, *[F.when(F.col(f"_{v}") == F.col("_n"), F.col(f"{v}_{part}")).alias(f"{v}_{part}") for v in values for part in ("slope", "intercept")])


def get_trend(df: DataFrame, method: str = "linear", time: str = TIME) -> DataFrame:
    if method != "linear":
        raise ValueError(f"Unknown detrending method '{method}'")
    return linear_trend(df, time)


def subtract_trend(df: DataFrame, method: str, trend: DataFrame, time: str = TIME) -> DataFrame:
    """Residuals of a fitted trend."""
    if method != "linear":
        raise NotImplementedError(f"detrending method '{method}'")
    require(df, time)
    df = missing_as_null(df)
    dims, values = dims_of(df, time), variables_of(df)
    joined = df.alias("d").join(trend.alias("t"), same("d", "t", dims), "left") if dims else df.alias("d").crossJoin(F.broadcast(trend.alias("t")))
    line = lambda v: F.col(f"t.{v}_intercept") + F.col(f"t.{v}_slope") * seconds(F.col(f"d.{time}"))
    return joined.select(*[F.col(f"d.{c}") if c not in values else (F.col(f"d.{c}") - line(c)).alias(c) for c in df.columns])


def resample(df: DataFrame, unit: str, time: str = TIME, of: Sequence[str] | None = None) -> DataFrame:
    """Means over calendar units (as `date_trunc` names them) of each cell."""
    require(df, time)
    df = missing_as_null(df)
    at = F.date_trunc(unit, F.col(time).cast("timestamp_ntz")).cast("timestamp_ntz")
    return df.groupBy(at.alias(time), *dims_of(df, time)).agg(*[F.avg(v).alias(v) for v in (of or variables_of(df))])
