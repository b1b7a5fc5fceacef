"""Intervals around an anchor date, resampling to them, and splits by anchor year.

Targets are 1, 2, ... from the anchor on; precursors -1, -2, ... end at it. Intervals are half-open, [left, right).
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.schema import ANCHOR_YEAR, INTERVAL, TIME, dims_of, missing_as_null, require, variables_of
from .timeseries import seconds


def _length(length: str) -> tuple[int, str]:
    found = re.fullmatch(r"(\d+)\s*(min|[dDwWmMyYhH])", length)
    if not found:
        raise ValueError(f"a length is a number and one of min, h, d, W, M, Y, not {length!r}")
    return int(found[1]), found[2] if found[2] == "min" else found[2].upper()


#: Seconds of a unit, about: they only set how wide the bins of a join are.
_SECONDS = {"min": 60, "H": 3600, "D": 86400, "W": 7 * 86400, "M": 365.25 / 12 * 86400, "Y": 365.25 * 86400}


def _moved(at: Column, length: str, times: int, by_day: bool) -> Column:
    """A date, or a time (not by_day), so many lengths later."""
    n, unit = _length(length)
    n *= times
    if unit in "MY":
        months = n * (12 if unit == "Y" else 1)
        return F.add_months(at, months) if by_day else at + F.make_ym_interval(F.lit(0), F.lit(months))
    if by_day:
        return F.date_add(at, n * (7 if unit == "W" else 1))
    return at + F.make_dt_interval(*[F.lit(n * (7 if unit == "W" else 1) if unit in names else 0) for names in ("DW", "H", ("min",))])


class Calendar:
    """Intervals of each anchor year, whose bounds are dates; with an hour in the anchor, or lengths in hours or minutes, times."""

    def __init__(self, anchor: str = "01-01"):
        if not re.fullmatch(r"\d\d-\d\d( \d\d:\d\d)?", anchor):
            raise ValueError(f"an anchor is MM-DD or MM-DD HH:MM, not {anchor!r}")
        self.anchor = anchor
        self._lengths: dict[str, list[str]] = {"target": [], "precursor": []}
        self._years: tuple[int, int] | None = None

    def add_intervals(self, role: str, length: str, n: int = 1) -> Calendar:
        if role not in self._lengths:
            raise ValueError("a role is 'target' or 'precursor'")
        _length(length)
        self._lengths[role] += [length] * n
        return self

    @property
    def by_day(self) -> bool:
        """Whether all bounds are dates."""
        return len(self.anchor) == 5 and all(_length(x)[1] in "DWMY" for some in self._lengths.values() for x in some)

    @property
    def mean_seconds(self) -> float:
        """Length of an interval on average, about."""
        each = [_length(x) for some in self._lengths.values() for x in some]
        return max(1.0, sum(n * _SECONDS[unit] for n, unit in each) / max(1, len(each)))

    def map_years(self, first: int, last: int) -> Calendar:
        self._years = (min(first, last), max(first, last))
        return self

    def map_to_data(self, data: DataFrame, time: str = TIME) -> Calendar:
        """Anchor years whose intervals all lie within the data's time range."""
        require(data, time)
        low, high = data.agg(F.min(F.col(time).cast("date")), F.max(F.col(time).cast("date"))).first()
        if low is None:
            raise ValueError("the data have no times")
        self._years = (low.year - 1, high.year + 1)
        spans = self.intervals(data.sparkSession).groupBy(ANCHOR_YEAR).agg(F.min("left").alias("left"), F.max("right").alias("right"))
        years = [r[0] for r in spans.where((F.col("left") >= F.lit(low)) & (F.col("right") <= F.date_add(F.lit(high), 1))).select(ANCHOR_YEAR).collect()]
        if not years:
            raise ValueError("no anchor year lies within the data")
        self._years = (min(years), max(years))
        return self

    def intervals(self, spark: SparkSession) -> DataFrame:
        """anchor_year, i_interval, left, right, is_target."""
        if self._years is None:
            raise ValueError("call map_years or map_to_data first")
        years = spark.range(self._years[0], self._years[1] + 1).select(F.col("id").cast("int").alias(ANCHOR_YEAR))
        anchor = F.concat_ws("-", F.lpad(F.col(ANCHOR_YEAR).cast("string"), 4, "0"), F.lit(self.anchor)).cast("date" if self.by_day else "timestamp_ntz")
        rows, left = [], anchor
        for i, length in enumerate(self._lengths["target"], 1):
            right = _moved(left, length, 1, self.by_day)
            rows.append(F.struct(F.lit(i).alias(INTERVAL), left.alias("left"), right.alias("right"), F.lit(True).alias("is_target")))
            left = right
        right = anchor
        for i, length in enumerate(self._lengths["precursor"], 1):
            left = _moved(right, length, -1, self.by_day)
            rows.append(F.struct(F.lit(-i).alias(INTERVAL), left.alias("left"), right.alias("right"), F.lit(False).alias("is_target")))
            right = left
        if not rows:
            raise ValueError("the calendar has no intervals")
        return years.select(ANCHOR_YEAR, F.explode(F.array(*rows)).alias("x")).select(ANCHOR_YEAR, "x.*")

    def show(self, spark: SparkSession) -> DataFrame:
        """The intervals as a table for people, newest year first."""
        return self.intervals(spark).orderBy(F.desc(ANCHOR_YEAR), F.desc(INTERVAL))

    def __repr__(self) -> str:
        return f"Calendar(anchor={self.anchor!r}, target={self._lengths['target']}, precursor={self._lengths['precursor']}, years={self._years})"


def daily_calendar(anchor: str, length: str = "1d", n_targets: int = 1, n_precursors: int | None = None) -> Calendar:
    """Targets and precursors of equal length; as many precursors as fit in a year beside the targets, if not given."""
    found = re.fullmatch(r"(\d+)\s*([dDwW])", length)
    if not found:
        raise ValueError(f"a length is a number and d or W, not {length!r}")
    days = int(found[1]) * (7 if found[2] in "wW" else 1)
    return Calendar(anchor).add_intervals("target", length, n_targets).add_intervals("precursor", length, 365 // days - n_targets if n_precursors is None else n_precursors)


def weekly_calendar(anchor: str, length: str = "1W", n_targets: int = 1) -> Calendar:
    return daily_calendar(anchor, length, n_targets)


def monthly_calendar(anchor: str, length: str = "1M", n_targets: int = 1) -> Calendar:
    months = int(length.rstrip("Mm"))
    return Calendar(anchor).add_intervals("target", length, n_targets).add_intervals("precursor", length, 12 // months - n_targets)


def resample(calendar: Calendar, data: DataFrame, time: str = TIME) -> DataFrame:
    """Mean of each cell over each interval: anchor_year, i_interval, the cell's columns and the variables.

    A range join: intervals and rows are dealt into bins of time as long as an interval on average, so that an interval
    costs a row for each bin that it touches, two or so, and a row of data is compared with the intervals of its bin.
    """
    require(data, time)
    width = calendar.mean_seconds
    bounds = calendar.intervals(data.sparkSession).where(F.col("right") > F.col("left")).select(ANCHOR_YEAR, INTERVAL, seconds(F.col("left")).alias("_left"), seconds(F.col("right")).alias("_right"))
    bins = F.sequence(F.floor(F.col("_left") / width), F.ceil(F.col("_right") / width) - 1)
    bounds = bounds.withColumn("_bin", F.explode(bins))
    data = missing_as_null(data)
    timed = data.withColumn("_at", seconds(F.col(time))).withColumn("_bin", F.floor(F.col("_at") / width))
    joined = timed.join(bounds, "_bin").where((F.col("_left") <= F.col("_at")) & (F.col("_at") < F.col("_right")))
    return joined.groupBy(ANCHOR_YEAR, INTERVAL, *dims_of(data, time)).agg(*[F.avg(v).alias(v) for v in variables_of(data)])


def kfold_splits(data: DataFrame, k: int) -> DataFrame:
    """split, anchor_year, is_train: consecutive anchor years are tested in k folds."""
    years = data.select(ANCHOR_YEAR).distinct().orderBy(ANCHOR_YEAR)
    found = [r[0] for r in years.collect()]  # one row for each year
    if not 2 <= k <= len(found):
        raise ValueError(f"{k} folds of {len(found)} years")
    rows = [(fold, y, not fold * len(found) // k <= i < (fold + 1) * len(found) // k) for fold in range(k) for i, y in enumerate(found)]
    return data.sparkSession.createDataFrame(rows, f"split int, {ANCHOR_YEAR} int, is_train boolean")


def shuffle_splits(data: DataFrame, n: int, test_share: float = 0.25, seed: int = 1) -> DataFrame:
    """n random splits by a hash of year and seed; the test share is rounded up to whole years."""
    found = sorted(r[0] for r in data.select(ANCHOR_YEAR).distinct().collect())  # one row for each year
    spark = data.sparkSession
    keyed = spark.createDataFrame([(s, y) for s in range(n) for y in found], f"split int, {ANCHOR_YEAR} int").withColumn("h", F.xxhash64(F.lit(seed), "split", ANCHOR_YEAR))
    place = F.row_number().over(Window.partitionBy("split").orderBy("h"))
    return keyed.withColumn("is_train", place > -(-len(found) * test_share // 1)).select("split", ANCHOR_YEAR, "is_train")


def explicit_splits(spark: SparkSession, train: Sequence[Sequence[int]], test: Sequence[Sequence[int]]) -> DataFrame:
    """Splits from lists of training and testing years."""
    rows = [(i, int(y), flag) for flag, lists in ((True, train), (False, test)) for i, years in enumerate(lists) for y in years]
    return spark.createDataFrame(rows, f"split int, {ANCHOR_YEAR} int, is_train boolean")


def split_rows(data: DataFrame, splits: DataFrame) -> DataFrame:
    """The data once for each split, with `split` and `is_train`."""
    require(data, ANCHOR_YEAR)
    return data.join(splits, ANCHOR_YEAR)


def train_test(data: DataFrame, splits: DataFrame, split: int) -> tuple[DataFrame, DataFrame]:
    """Training and testing rows of one split."""
    rows = split_rows(data, splits.where(F.col("split") == split))
    return tuple(rows.where("is_train" if part else "not is_train").drop("split", "is_train") for part in (True, False))


class Splitter:
    """Training and testing tables for each split of the anchor years."""

    def __init__(self, splits):
        """splits: a table (split, anchor_year, is_train), or a function of the data that gives one."""
        self._splits = splits

    @classmethod
    def kfold(cls, k: int) -> Splitter:
        return cls(lambda data: kfold_splits(data, k))

    @classmethod
    def shuffle(cls, n: int, test_share: float = 0.25, seed: int = 1) -> Splitter:
        return cls(lambda data: shuffle_splits(data, n, test_share, seed))

    def split(self, x: DataFrame, y: DataFrame | None = None) -> Iterator[tuple[DataFrame, ...]]:
        """(x_train, x_test) of each split, or (x_train, x_test, y_train, y_test)."""
        require(x, ANCHOR_YEAR)
        splits = self._splits(x) if callable(self._splits) else self._splits
        years = sorted(map(tuple, splits.select("split", ANCHOR_YEAR, "is_train").collect()))  # splits x years
        for split in sorted({r[0] for r in years}):
            out = []
            for df in (x,) if y is None else (x, y):
                for part in (True, False):
                    some = [int(r[1]) for r in years if r[0] == split and bool(r[2]) == part]
                    out.append(df.where(F.col(ANCHOR_YEAR).isin(some)))
            yield tuple(out)
