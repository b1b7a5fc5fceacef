"""Queries over the driver's tables, each with its equivalent in DuckDB's SQL.

Doubles are rounded on both sides, as sums come in different orders. The oracles are built from named blocks (CTEs).
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.schema import ANCHOR_YEAR, INTERVAL, LATITUDE, LONGITUDE, check_input
from ..functions.stats import METHODS
from ..operators import alignment, cluster, rgdr, timeseries
from ..operators import calendar as cal
from ..operators.preprocess import Preprocessor
from ..sources import netcdf, tables
from .session import cut, scratch, ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "preprocess_full_whole"

#: Settings of the clustering queries.
EPS, ALPHA, AREA = 1200, 0.3, 600_000
ONE, MANY = ([1], [-4]), ([1, 2, 3, 4], [-4, -3, -2, -1])


def _rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])


def query(sql: str | None = None, **digits: int):
    """Registers a query; digits: columns to round."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str, **more) -> DataFrame:
            ship(spark)
            return _rounded(f(spark, sf_dir, **more), digits)

        run.__doc__ = f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# blocks of the oracles

_CELL = "(47.5 - 5 * ((l_partkey % 65) // 13))::double AS latitude, (177.5 + 5 * ((l_partkey % 65) % 13))::double AS longitude"
_MONTHS = "BETWEEN (SELECT year(min(l_shipdate)) + (month(min(l_shipdate)) > 1)::int FROM lineitem) AND (SELECT year(max(l_shipdate)) - (month(max(l_shipdate)) < 12)::int FROM lineitem)"
_FIRST = "(SELECT year(d) + (d > make_date(year(d), 4, 1))::int FROM (SELECT greatest((SELECT min(l_shipdate) FROM lineitem), (SELECT min(o_orderdate) FROM orders))::date AS d))"
_LAST = "(SELECT year(d) - (d < make_date(year(d), 11, 30))::int FROM (SELECT least((SELECT max(l_shipdate) FROM lineitem), (SELECT max(o_orderdate) FROM orders))::date AS d))"
_ANCHORS = f"BETWEEN {_FIRST} AND {_LAST}"
_TO_INTERVAL = "(CASE WHEN month({0}) >= 8 THEN month({0}) - 7 ELSE month({0}) - 8 END)::int"
B = {
    "daily": f"SELECT l_shipdate AS time, {_CELL}, avg(ln(l_extendedprice)) AS value FROM lineitem GROUP BY ALL",
    "monthly": f"SELECT date_trunc('month', l_shipdate)::timestamp AS time, {_CELL}, avg(ln(l_extendedprice)) AS value FROM lineitem WHERE year(l_shipdate) {_MONTHS} GROUP BY ALL",
    "event": "SELECT date_trunc('day', ts)::timestamp AS time, event_type, avg(value) AS value FROM events GROUP BY ALL",
    "tmonthly": f"SELECT date_trunc('month', o_orderdate)::timestamp AS time, avg(ln(o_totalprice)) AS value FROM orders WHERE year(o_orderdate) {_MONTHS} GROUP BY ALL",
    "precursor": f"SELECT year(l_shipdate)::int AS anchor_year, {_TO_INTERVAL.format('l_shipdate')} AS i_interval, {_CELL}, avg(ln(l_extendedprice)) AS value FROM lineitem WHERE year(l_shipdate) {_ANCHORS} AND month(l_shipdate) BETWEEN 4 AND 11 GROUP BY ALL",
    "target": f"SELECT year(o_orderdate)::int AS anchor_year, {_TO_INTERVAL.format('o_orderdate')} AS i_interval, avg(ln(o_totalprice)) AS value FROM orders WHERE year(o_orderdate) {_ANCHORS} AND month(o_orderdate) BETWEEN 4 AND 11 GROUP BY ALL",
}


def _with(*names: str, **more: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({x})" for n, x in [*((n, B[n]) for n in names), *more.items()]) + " "


_PERIODS = {"monthly": "month(time)::int", "weekly": "weekofyear(time)::int", "daily": "dayofyear(time)::int"}


def _clim(table: str, scale: str) -> str:
    return f"SELECT {_PERIODS[scale]} AS period, latitude, longitude, avg(value) AS value FROM {table} GROUP BY ALL"


def _anomaly(table: str, clim: str, scale: str) -> str:
    return f"SELECT d.time, d.latitude, d.longitude, d.value - c.value AS value FROM {table} d LEFT JOIN {clim} c ON {_PERIODS[scale].replace('time', 'd.time')} = c.period AND d.latitude = c.latitude AND d.longitude = c.longitude"


_X = "(epoch(time)::double)"


def _trend(table: str) -> str:
    return f"SELECT latitude, longitude, CASE WHEN count(value) = (SELECT count(DISTINCT time) FROM {table}) THEN regr_slope(value, {_X}) END AS value_slope, CASE WHEN count(value) = (SELECT count(DISTINCT time) FROM {table}) THEN regr_intercept(value, {_X}) END AS value_intercept FROM {table} GROUP BY ALL"


def _detrended(table: str, trend: str) -> str:
    return f"SELECT d.time, d.latitude, d.longitude, d.value - (t.value_intercept + t.value_slope * {_X.replace('time', 'd.time')}) AS value FROM {table} d LEFT JOIN {trend} t USING (latitude, longitude)"


def _rolled(table: str, dims: str, window: int, least: int) -> str:
    frame = f"OVER (PARTITION BY {dims} ORDER BY time ROWS BETWEEN {window // 2} PRECEDING AND {(window - 1) // 2} FOLLOWING)"
    dense = f"SELECT g.*, t.value FROM (SELECT * FROM (SELECT DISTINCT {dims} FROM {table}), (SELECT DISTINCT time FROM {table})) g LEFT JOIN {table} t USING ({dims}, time)"
    return f"SELECT {dims}, time, CASE WHEN count(value) {frame} >= {least} THEN avg(value) {frame} END AS value FROM ({dense})"


def _out(columns: str, digits: dict[str, int], table: str) -> str:
    return "SELECT " + ", ".join(f"round({c}, {digits[c]}) AS {c}" if c in digits else c for c in columns.split()) + f" FROM {table}"


_V = {"value": 6}
_FIELD = "time latitude longitude value"

# time series


def _clim_query(scale: str, source: str):
    def f(spark, sf_dir, **years):
        return timeseries.climatology(getattr(tables, f"field_{source}")(spark, sf_dir, **years), scale)

    f.__name__ = f"clim_{scale}"
    query(_with(source, c=_clim(source, scale)) + _out("period latitude longitude value", _V, "c"), **_V)(f)


for _scale, _source in (("monthly", "monthly"), ("weekly", "daily"), ("daily", "daily")):
    _clim_query(_scale, _source)


def _anomaly_query(scale: str):
    def f(spark, sf_dir, **years):
        data = getattr(tables, f"field_{scale}")(spark, sf_dir, **years)
        return timeseries.subtract_climatology(data, scale, timeseries.climatology(data, scale))

    f.__name__ = f"anomaly_{scale}"
    query(_with(scale, c=_clim(scale, scale), a=_anomaly(scale, "c", scale)) + _out(_FIELD, _V, "a"), **_V)(f)


for _scale in ("monthly", "daily"):
    _anomaly_query(_scale)


def _rolling_query(name: str, window: int, least: int):
    def f(spark, sf_dir):
        return timeseries.rolling_mean(tables.event_daily(spark, sf_dir), window, least)

    f.__name__ = name
    query(_with("event", r=_rolled("event", "event_type", window, least)) + _out("event_type time value", {"value": 6}, "r"), value=6)(f)


for _args in (("rolling_mean_odd", 5, 1), ("rolling_mean_even", 4, 1), ("rolling_min_periods", 7, 5)):
    _rolling_query(*_args)


@query(_with("daily", r=_rolled("daily", "latitude, longitude", 25, 3)) + _out("latitude longitude time value", _V, "r"), **_V)
def rolling_mean_gaps(spark, sf_dir):
    """Daily field with gaps: absent days keep their place in the window."""
    return timeseries.rolling_mean(tables.field_daily(spark, sf_dir), 25, 3)


_SLOPE = {"value_slope": 15, "value_intercept": 6}


@query(_with("monthly", t=_trend("monthly")) + _out("latitude longitude value_slope value_intercept", _SLOPE, "t"), **_SLOPE)
def trend_linear(spark, sf_dir, years=tables.WHOLE):
    return timeseries.linear_trend(tables.field_monthly(spark, sf_dir, years=years))


@query(_with("monthly", t=_trend("monthly"), d=_detrended("monthly", "t")) + _out(_FIELD, _V, "d"), **_V)
def detrend_linear(spark, sf_dir, years=tables.WHOLE):
    data = tables.field_monthly(spark, sf_dir, years=years)
    return timeseries.subtract_trend(data, "linear", timeseries.get_trend(data))


@query(_with("monthly", t="SELECT DISTINCT time FROM monthly", s="SELECT epoch(time) - lag(epoch(time)) OVER (ORDER BY time) AS step FROM t") + "SELECT floor(median(step) / 86400)::int AS days FROM s")
def resolution_median_days(spark, sf_dir):
    return timeseries.resolution_days(tables.field_monthly(spark, sf_dir))


@query("SELECT date_trunc('month', time)::timestamp AS time, event_type, round(avg(value), 6) AS value FROM (" + B["event"] + ") GROUP BY ALL", value=6)
def resample_period(spark, sf_dir):
    return timeseries.resample(tables.event_daily(spark, sf_dir), "month")


_SMOOTH = _rolled("monthly", "latitude, longitude", 3, 1)


@query(_with("monthly", r=_SMOOTH, c=_clim("r", "monthly"), a=_anomaly("r", "c", "monthly"), t=_trend("a"), f=_anomaly("monthly", "c", "monthly"), o=_detrended("f", "t")) + _out(_FIELD, _V, "o"), **_V)
def preprocess_full(spark, sf_dir, years=tables.WHOLE):
    """Rolling mean, climatology and trend fitted, and removed from the raw field."""
    return Preprocessor(3, "monthly").fit_transform(tables.field_monthly(spark, sf_dir, years=years))


@query(_with("monthly", r=_SMOOTH, t=_trend("r"), o=_detrended("monthly", "t")) + _out(_FIELD, _V, "o"), **_V)
def preprocess_no_clim(spark, sf_dir, years=tables.WHOLE):
    return Preprocessor(3, "monthly", subtract_climatology=False).fit_transform(tables.field_monthly(spark, sf_dir, years=years))


@query(_with("monthly", r=_SMOOTH, c=_clim("r", "monthly"), o=_anomaly("monthly", "c", "monthly")) + _out(_FIELD, _V, "o"), **_V)
def preprocess_no_detrend(spark, sf_dir, years=tables.WHOLE):
    return Preprocessor(3, "monthly", detrend=None).fit_transform(tables.field_monthly(spark, sf_dir, years=years))


@query(_with("monthly", r="SELECT latitude, longitude, time, value FROM monthly", c=_clim("r", "monthly"), a=_anomaly("r", "c", "monthly"), t=_trend("a")) + _out("latitude longitude value_slope value_intercept", _SLOPE, "t"), **_SLOPE)
def preprocess_trend(spark, sf_dir, years=tables.WHOLE):
    """The trend property of a fit without smoothing."""
    return Preprocessor(None, "monthly").fit(tables.field_monthly(spark, sf_dir, years=years)).trend


# geometry and correlation

_AREA = "(sin(radians({lat} + {dlat} / 2)) - sin(radians({lat} - {dlat} / 2))) * radians({dlon}) / (4 * pi()) * 5.10072e8"


@query(f"SELECT latitude, round({_AREA.format(lat='latitude', dlat='5.0', dlon='2.5')}, 3) AS area FROM (SELECT DISTINCT {_CELL} FROM lineitem) GROUP BY ALL", area=3)
def spherical_area(spark, sf_dir):
    return tables.field_daily(spark, sf_dir).select(LATITUDE).distinct().withColumn("area", geo.spherical_area(F.col(LATITUDE), 5, 2.5))


@query(f"SELECT latitude, longitude, round({_AREA.format(lat='latitude', dlat='5.0', dlon='5.0')}, 3) AS area FROM (SELECT DISTINCT {_CELL} FROM lineitem)", area=3)
def gridcell_area(spark, sf_dir):
    return geo.add_gridcell_area(tables.field_daily(spark, sf_dir).select(LATITUDE, LONGITUDE).distinct())


@query(_with("precursor") + "SELECT i_interval, n::int AS lag, (CASE WHEN i_interval > 0 AND i_interval - n <= 0 THEN i_interval - n - 1 ELSE i_interval - n END)::int AS lagged, count(*)::bigint AS n FROM precursor, range(0, 6) b(n) GROUP BY ALL")
def interval_lag(spark, sf_dir):
    """The intervals of a field, shifted back."""
    field = tables.precursor(spark, sf_dir).groupBy(INTERVAL).agg(F.count("*").alias("n"))
    lags = [field.select(INTERVAL, F.lit(n).alias("lag"), rgdr.interval_lag(INTERVAL, n).alias("lagged"), "n") for n in range(6)]
    return reduce(DataFrame.unionByName, lags)


def _pairs(which: tuple[list[int], list[int]]) -> str:
    t, p = which
    return f"SELECT p.anchor_year, list_position({p}, p.i_interval)::int AS pair, p.latitude, p.longitude, p.value AS x, t.value AS y FROM precursor p JOIN target t ON p.anchor_year = t.anchor_year AND list_position({p}, p.i_interval) = list_position({t}, t.i_interval) WHERE list_contains({p}, p.i_interval) AND list_contains({t}, t.i_interval)"


_EVEN = "1 - abs(r) * list_sum(list_transform(range(0, (n - 4) // 2 + 1), lambda k: exp(lgamma(2 * k + 1) - 2 * lgamma(k + 1) - k * ln(4)) * pow(1 - r * r, k)))"
_ODD = "1 - 2 / pi() * (asin(abs(r)) + CASE WHEN n >= 5 THEN abs(r) * sqrt(1 - r * r) * list_sum(list_transform(range(0, (n - 5) // 2 + 1), lambda k: exp(k * ln(4) + 2 * lgamma(k + 1) - lgamma(2 * k + 2)) * pow(1 - r * r, k))) ELSE 0 END)"


def _corr(pairs: str, size: str) -> str:
    return f"SELECT latitude, longitude, r AS corr, CASE WHEN r IS NULL THEN NULL WHEN n = 2 THEN 1 WHEN n % 2 = 0 THEN {_EVEN} ELSE {_ODD} END AS p_val FROM (SELECT latitude, longitude, CASE WHEN count(*) = ({size}) AND stddev_pop(x) > 0 THEN corr(x, y) END AS r, count(*)::bigint AS n FROM {pairs} GROUP BY ALL)"


def _size(which) -> str:
    return f"SELECT count(*) FROM target WHERE list_contains({which[0]}, i_interval)"


_R = {"corr": 6, "p_val": 6}
_MAP = "latitude longitude corr p_val"


def _model(which) -> rgdr.RGDR:
    return rgdr.RGDR(which[0], lag=4, eps_km=EPS, alpha=ALPHA)


def _inputs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    years = tables.anchor_years(spark, sf_dir)
    return tables.precursor(spark, sf_dir, years=years), tables.target(spark, sf_dir, years)


@query(_with("precursor", "target", s=_pairs(MANY)) + _out("anchor_year pair latitude longitude x y", {"x": 6, "y": 6}, "s"), x=6, y=6)
def stack_pairs(spark, sf_dir):
    return rgdr.stack_pairs(*_inputs(spark, sf_dir), MANY[1], MANY[0])


def _corr_query(name: str, which):
    def f(spark, sf_dir):
        return _model(which).get_correlation(*_inputs(spark, sf_dir))

    f.__name__ = name
    query(_with("precursor", "target", s=_pairs(which), m=_corr("s", _size(which))) + _out(_MAP, _R, "m"), **_R)(f)


_corr_query("corr_map", ONE)
_corr_query("corr_multi_interval", MANY)


@query(_with("monthly", "tmonthly", s="SELECT m.latitude, m.longitude, m.value AS x, t.value AS y FROM monthly m JOIN tmonthly t USING (time)", m=_corr("s", "SELECT count(*) FROM tmonthly")) + _out(_MAP, _R, "m"), **_R)
def corr_pvalue(spark, sf_dir):
    """Correlation over time of every cell with a series."""
    month = F.date_trunc("month", F.col("time")).cast("timestamp_ntz")
    orders = tables.table(spark, sf_dir, "orders").where(F.year("o_orderdate").between(*tables.whole_years(spark, sf_dir))).select(F.col("o_orderdate").alias("time"), "o_totalprice")
    return rgdr.correlation(tables.field_monthly(spark, sf_dir), orders.groupBy(month.alias("time")).agg(F.avg(F.log("o_totalprice")).alias("value")), "time")


_CELLS = {"s": _pairs(MANY), "m": _corr("s", _size(MANY))}


@query(_with("precursor", "target", **_CELLS, o=f"SELECT *, coalesce(p_val < {ALPHA}, false) AS significant FROM m") + _out(_MAP + " significant", _R, "o"), **_R)
def significance_mask(spark, sf_dir):
    return _model(MANY).preview_correlation(*_inputs(spark, sf_dir))


# linear models: every cell of the field, with the orders' series as response and the mean quantity of all lineitems as control

_SERIES = {
    "quantity": "SELECT date_trunc('month', l_shipdate)::timestamp AS time, avg(l_quantity) AS q FROM lineitem GROUP BY ALL",
    "j": "SELECT m.latitude, m.longitude, m.value AS x, t.value AS y, z.q AS z FROM monthly m JOIN tmonthly t USING (time) JOIN quantity z USING (time) WHERE m.value IS NOT NULL",
    "mom": "SELECT latitude, longitude, count(*)::bigint AS n, count(*) = (SELECT count(*) FROM tmonthly) AS whole, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, var_pop(x) AS xx, var_pop(y) AS yy, var_pop(z) AS zz, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(z, y) AS zy FROM j GROUP BY ALL",
}
_COEF = "latitude, longitude, n, round(CASE WHEN whole THEN my - a * mx - b * mz END, 6) AS intercept, round(CASE WHEN whole THEN a END, 6) AS value_coef, round(CASE WHEN whole THEN b END, 6) AS q_coef, round(CASE WHEN whole THEN (2 * a * xy + 2 * b * zy - a * a * xx - 2 * a * b * xz - b * b * zz) / yy END, 6) AS r2"
_COEF_DIGITS = {"intercept": 6, "value_coef": 6, "q_coef": 6, "r2": 6}
RIDGE, LASSO = 0.5, 0.002


def _series(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A field, a series to explain, and a series that is held constant, by month."""
    month = F.date_trunc("month", F.col("time")).cast("timestamp_ntz").alias("time")
    orders = tables.table(spark, sf_dir, "orders").where(F.year("o_orderdate").between(*tables.whole_years(spark, sf_dir))).select(F.col("o_orderdate").alias("time"), "o_totalprice")
    items = tables.table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias("time"), "l_quantity")
    return tables.field_monthly(spark, sf_dir), orders.groupBy(month).agg(F.avg(F.log("o_totalprice")).alias("value")), items.groupBy(month).agg(F.avg("l_quantity").alias("q"))


def _solved(xx: str, zz: str) -> str:
    return f"SELECT *, (xy * ({zz}) - zy * xz) / (({xx}) * ({zz}) - xz * xz) AS a, (zy * ({xx}) - xy * xz) / (({xx}) * ({zz}) - xz * xz) AS b FROM mom"


def _regression_query(method: str, alpha: float, sql: str):
    def f(spark, sf_dir):
        field, target, control = _series(spark, sf_dir)
        return rgdr.regression(field, target, "time", method, alpha, more=control)

    f.__name__ = f"regression_{method}"
    query(_with("monthly", "tmonthly", **_SERIES, s=sql) + f"SELECT {_COEF} FROM s", **_COEF_DIGITS)(f)


_regression_query("linear", 0.0, _solved("xx", "zz"))
_regression_query("ridge", RIDGE, _solved(f"xx + {RIDGE} / n", f"zz + {RIDGE} / n"))
# the lasso's minimum has one of nine patterns of signs: of the solutions of all, the one with the smallest objective
_PATTERNS = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY latitude, longitude ORDER BY (yy - 2 * a * xy - 2 * b * zy + a * a * xx + 2 * a * b * xz + b * b * zz) / 2 + {LASSO} * (abs(a) + abs(b))) AS place FROM (
  SELECT *, CASE WHEN s = 0 THEN 0 WHEN t = 0 THEN (xy - {LASSO} * s) / xx ELSE ((xy - {LASSO} * s) * zz - (zy - {LASSO} * t) * xz) / (xx * zz - xz * xz) END AS a,
    CASE WHEN t = 0 THEN 0 WHEN s = 0 THEN (zy - {LASSO} * t) / zz ELSE ((zy - {LASSO} * t) * xx - (xy - {LASSO} * s) * xz) / (xx * zz - xz * xz) END AS b
  FROM mom, range(-1, 2) p(s), range(-1, 2) r(t))) WHERE place = 1"""
_regression_query("lasso", LASSO, _PATTERNS)


@query(
    _with(
        "monthly", "tmonthly", **_SERIES,
        line="SELECT latitude, longitude, regr_slope(x, z) AS bx, regr_intercept(x, z) AS ax, regr_slope(y, z) AS by_, regr_intercept(y, z) AS ay FROM j GROUP BY ALL",
        rest="SELECT j.latitude, j.longitude, x - ax - bx * z AS x, y - ay - by_ * z AS y FROM j JOIN line USING (latitude, longitude)",
        m=_corr("rest", "SELECT count(*) FROM tmonthly").replace("count(*)::bigint AS n", "count(*)::bigint - 1 AS n"),
    )
    + _out(_MAP, _R, "m"),
    **_R,
)
def partial_corr(spark, sf_dir):
    """Correlation of every cell with a series, with another series held constant: that of the residuals."""
    return rgdr.partial_correlation(*_series(spark, sf_dir), "time")


# clusters

_NUMBERED = "SELECT *, round((90 - latitude) * 1000000)::bigint * 2147483648 + round((longitude + 360) * 1000000)::bigint AS id FROM m"
_POINTS = f"SELECT id, CASE WHEN corr >= 0 THEN 1 ELSE -1 END AS sign, latitude, longitude FROM g WHERE p_val < {ALPHA}"
_HAVERSINE = "2 * 6371 * asin(least(1, sqrt(pow(sin(radians(b.latitude - a.latitude) / 2), 2) + cos(radians(a.latitude)) * cos(radians(b.latitude)) * pow(sin(radians(b.longitude - a.longitude) / 2), 2))))"
_EDGES = f"SELECT a.sign, a.id AS a, b.id AS b FROM pt a JOIN pt b ON a.sign = b.sign AND a.id <= b.id AND {_HAVERSINE} <= {EPS}"
_REACH = "SELECT sign, a AS id, a AS other FROM e UNION SELECT r.sign, r.id, CASE WHEN e.a = r.other THEN e.b ELSE e.a END FROM r JOIN e ON e.sign = r.sign AND (e.a = r.other OR e.b = r.other)"
_LABELS = "SELECT id, (sign * dense_rank() OVER (PARTITION BY sign ORDER BY first))::smallint AS cluster_label FROM (SELECT sign, id, min(other) AS first FROM (SELECT sign, id, other FROM r UNION ALL SELECT sign, b, b FROM e) GROUP BY ALL)"
_LABELLED = f"SELECT g.latitude, g.longitude, g.corr, g.p_val, coalesce(l.cluster_label, 0)::smallint AS cluster_label, {_AREA.format(lat='g.latitude', dlat='5.0', dlon='5.0')} AS area FROM g LEFT JOIN l ON g.id = l.id"
_BOTH = "SELECT sign, a, b FROM e0 UNION ALL SELECT sign, b, a FROM e0"
_CLUSTERS = _with("precursor", "target", **_CELLS, g=_NUMBERED, pt=_POINTS, e0=_EDGES, e=_BOTH, r=_REACH, l=_LABELS, c=_LABELLED).replace("WITH ", "WITH RECURSIVE ", 1)


def _clusters(spark, sf_dir, area=None) -> DataFrame:
    cells = _model(MANY).get_correlation(*_inputs(spark, sf_dir))
    return cluster.spherical_clusters(cells, EPS, ALPHA, area)


@query(_CLUSTERS + "SELECT sign::int AS sign, a::bigint AS a, b::bigint AS b FROM e0")
def eps_edges(spark, sf_dir):
    cells = cut(_model(MANY).get_correlation(*_inputs(spark, sf_dir)))
    return cluster.eps_edges(cluster.significant(cluster.numbered(cells), ALPHA).select("id", "sign", LATITUDE, LONGITUDE), EPS).select("sign", "a", "b")


@query(_CLUSTERS + "SELECT latitude, longitude, cluster_label FROM c")
def dbscan_labels(spark, sf_dir):
    return _model(MANY).get_clusters(*_inputs(spark, sf_dir)).select(LATITUDE, LONGITUDE, "cluster_label")


@query(_CLUSTERS + "SELECT cluster_label, round(sum(area), 2) AS area FROM c GROUP BY ALL", area=2)
def cluster_area(spark, sf_dir):
    return cluster.cluster_area(_clusters(spark, sf_dir))


_BIG = f"CASE WHEN sum(area) OVER (PARTITION BY cluster_label) > {AREA} THEN cluster_label ELSE 0 END::smallint"


@query(_CLUSTERS + f"SELECT latitude, longitude, ({_BIG.replace('END::smallint', 'END')})::smallint AS cluster_label FROM c")
def clusters_min_area(spark, sf_dir):
    return _clusters(spark, sf_dir, AREA).select(LATITUDE, LONGITUDE, "cluster_label")


_CENTERS = "SELECT cluster_label, sum(area * latitude) / sum(area) AS latitude, sum(area * longitude) / sum(area) AS longitude FROM c GROUP BY ALL"
_REDUCED = f"SELECT p.anchor_year, p.i_interval, c.cluster_label, sum(area * value) / sum(area) AS value FROM precursor p JOIN c USING (latitude, longitude) WHERE cluster_label <> 0 AND list_contains({MANY[1]}, p.i_interval) GROUP BY ALL"
_D = {"latitude": 6, "longitude": 6, "value": 6}


@query(_CLUSTERS + f", red AS ({_REDUCED}), cen AS ({_CENTERS}), n AS (SELECT count(*) AS n FROM (SELECT DISTINCT anchor_year, i_interval FROM precursor WHERE list_contains({MANY[1]}, i_interval))), ok AS (SELECT cluster_label FROM red GROUP BY ALL HAVING count(value) = (SELECT n FROM n)) SELECT anchor_year, i_interval, cluster_label, round(cen.latitude, 6) AS latitude, round(cen.longitude, 6) AS longitude, round(red.value, 6) AS value FROM red JOIN ok USING (cluster_label) JOIN cen USING (cluster_label)", **_D)
def rgdr_transform(spark, sf_dir):
    return _model(MANY).fit_transform(*_inputs(spark, sf_dir))


@query(_CLUSTERS + f", cen AS ({_CENTERS}) " + _out("cluster_label latitude longitude", {"latitude": 6, "longitude": 6}, "cen"), latitude=6, longitude=6)
def cluster_centers(spark, sf_dir):
    return rgdr.cluster_centers(_clusters(spark, sf_dir))


_SUMS = {"mean": "sum(l_quantity * l_extendedprice) / sum(l_quantity)", "sum": "sum(l_quantity * l_extendedprice)", "sum_of_weights": "sum(l_quantity)"}
_SQUARES = "sum(l_quantity * (l_extendedprice - m) * (l_extendedprice - m))"
_SUMS |= {"sum_of_squares": _SQUARES, "var": f"{_SQUARES} / sum(l_quantity)", "std": f"sqrt({_SQUARES} / sum(l_quantity))"}
# sums of squares keep about ten digits over another order, so they are compared in relative terms
_SCALE = {"sum_of_squares": 1e9, "var": 1e6, "sum": 1e3}


def _weighted_query(method: str):
    def f(spark, sf_dir):
        rows = tables.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice", "l_quantity")
        out = rgdr.weighted_groupby(rows, "l_returnflag", "l_quantity", method)
        return out.select("l_returnflag", (F.col("l_extendedprice") / _SCALE.get(method, 1.0)).alias("value"))

    f.__name__ = f"weighted_{method}"
    sql = f"SELECT l_returnflag, round({_SUMS[method]} / {_SCALE.get(method, 1.0)}, 3) AS value FROM (SELECT *, sum(l_quantity * l_extendedprice) OVER (PARTITION BY l_returnflag) / sum(l_quantity) OVER (PARTITION BY l_returnflag) AS m FROM lineitem) GROUP BY ALL"
    query(sql, value=3)(f)


for _method in METHODS:
    _weighted_query(_method)


@query("SELECT l_suppkey, round(sum(v * n * (greatest((n - 1) * 0.3 / n, least(((n - 1) * 0.3 + 1) / n, c / a)) - greatest((n - 1) * 0.3 / n, least(((n - 1) * 0.3 + 1) / n, (c - w) / a)))), 3) AS value FROM (SELECT l_suppkey, l_extendedprice AS v, l_quantity AS w, sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_quantity ROWS UNBOUNDED PRECEDING) AS c, sum(l_quantity) OVER (PARTITION BY l_suppkey) AS a, pow(sum(l_quantity) OVER (PARTITION BY l_suppkey), 2) / sum(l_quantity * l_quantity) OVER (PARTITION BY l_suppkey) AS n FROM lineitem) GROUP BY ALL", value=3)
def weighted_quantile(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_extendedprice").alias("value"), F.col("l_quantity").alias("w"))
    return rgdr.weighted_groupby(rows, "l_suppkey", "w", "quantile", q=0.3)


@query("SELECT l_linestatus, round(sum(v * n * (greatest((n - 1) * 0.5 / n, least(((n - 1) * 0.5 + 1) / n, c / a)) - greatest((n - 1) * 0.5 / n, least(((n - 1) * 0.5 + 1) / n, (c - w) / a)))), 3) AS value FROM (SELECT l_linestatus, l_extendedprice AS v, l_quantity AS w, sum(l_quantity) OVER (PARTITION BY l_linestatus ORDER BY l_extendedprice, l_quantity ROWS UNBOUNDED PRECEDING) AS c, sum(l_quantity) OVER (PARTITION BY l_linestatus) AS a, pow(sum(l_quantity) OVER (PARTITION BY l_linestatus), 2) / sum(l_quantity * l_quantity) OVER (PARTITION BY l_linestatus) AS n FROM lineitem) GROUP BY ALL", value=3)
def weighted_median_large(spark, sf_dir):
    """Medians of groups that hold half of all rows each."""
    rows = tables.table(spark, sf_dir, "lineitem").select("l_linestatus", F.col("l_extendedprice").alias("value"), F.col("l_quantity").alias("w"))
    return rgdr.weighted_groupby(rows, "l_linestatus", "w", "quantile")


# alignment

_MEANS = "SELECT (l_orderkey % 4)::int AS split, l_partkey % 65 AS cell, avg(l_quantity) AS mean FROM lineitem GROUP BY ALL"
_CUBE = f"SELECT * FROM (SELECT split, (47.5 - 5 * (cell // 13))::double AS latitude, (177.5 + 5 * (cell % 13))::double AS longitude, ((CASE WHEN mean > 25.8 THEN 1 WHEN mean < 25.2 THEN -1 ELSE 0 END) * ((cell % 13) // 5 + 1))::int AS label FROM ({_MEANS})) WHERE label <> 0"
A = {
    "lab": _CUBE,
    "size": "SELECT split, label, count(*) AS n FROM lab GROUP BY ALL",
    "shared": "SELECT a.split AS split_a, a.label AS label_a, b.split AS split_b, b.label AS label_b, count(*) AS n FROM lab a JOIN lab b USING (latitude, longitude) GROUP BY ALL",
    "tab": "SELECT a.split AS split_a, a.label AS label_a, b.split AS split_b, b.label AS label_b, CASE WHEN a.split <> b.split AND sign(a.label) = sign(b.label) THEN coalesce(h.n, 0) / a.n END AS overlap FROM size a CROSS JOIN size b LEFT JOIN shared h ON h.split_a = a.split AND h.label_a = a.label AND h.split_b = b.split AND h.label_b = b.label",
    "sets": "SELECT DISTINCT list_sort(list_distinct(list(m))) AS members FROM (SELECT split_a, label_a, split_b || '_' || label_b AS m FROM tab WHERE overlap > 0.1 UNION ALL SELECT split, label, split || '_' || label FROM size) GROUP BY split_a, label_a",
    "maxi": "SELECT members FROM sets a WHERE NOT EXISTS (SELECT 1 FROM sets b WHERE a.members <> b.members AND list_has_all(b.members, a.members))",
    "ranked": "SELECT members, row_number() OVER (ORDER BY len(members), array_to_string(members, '|')) AS rk FROM maxi",
    "disj": "SELECT list_sort(list(m)) AS members FROM (SELECT m, max(rk) AS rk FROM (SELECT rk, unnest(members) AS m FROM ranked) GROUP BY m) GROUP BY rk",
    "keyed": "SELECT members, row_number() OVER (ORDER BY list_sum(list_transform(string_split(array_to_string(members, ''), ''), lambda c: ascii(c))) + 78 * len(members) + 76 * (len(members) - 1) DESC, array_to_string(members, '|')) - 1 AS p FROM disj",
    "named": "SELECT CASE WHEN p < 26 THEN chr((65 + p)::int) ELSE chr((65 + (p - 26) // 26)::int) || chr((65 + (p - 26) % 26)::int) END AS name, members FROM keyed",
    "ren": "SELECT string_split(m, '_')[1]::int AS split, string_split(m, '_')[2]::int AS label, name, (row_number() OVER (PARTITION BY string_split(m, '_')[1]::int ORDER BY length(name), name, abs(string_split(m, '_')[2]::int), string_split(m, '_')[2]::int))::int AS pos FROM (SELECT name, unnest(members) AS m FROM named)",
    "uni": "SELECT split, label, CASE WHEN max(c) OVER (PARTITION BY name) > 1 THEN name || i ELSE name END AS name, pos FROM (SELECT *, count(*) OVER (PARTITION BY split, name) AS c, row_number() OVER (PARTITION BY split, name ORDER BY pos) AS i FROM ren)",
}


def _aligned(last: str, columns: str) -> str:
    names = list(A)[: list(A).index(last) + 1]
    return "WITH " + ", ".join(f"{n} AS ({A[n]})" for n in names) + f" SELECT {columns} FROM {last}"


@query(_aligned("tab", "split_a, label_a, split_b, label_b, round(overlap, 9) AS overlap"), overlap=9)
def overlap_table(spark, sf_dir):
    return alignment.overlap_table(tables.label_cube(spark, sf_dir))


def _sets(spark, sf_dir) -> DataFrame:
    return alignment.overlapping_clusters(tables.label_cube(spark, sf_dir))


def _text():
    return F.array_join("members", " ").alias("members")


_JOINED = "array_to_string(members, ' ') AS members"


@query(_aligned("sets", _JOINED))
def overlap_sets(spark, sf_dir):
    return _sets(spark, sf_dir).select(_text())


@query(_aligned("maxi", _JOINED))
def maximal_sets(spark, sf_dir):
    return alignment.remove_subsets(_sets(spark, sf_dir)).select(_text())


def _disjoint(spark, sf_dir) -> DataFrame:
    return alignment.remove_overlapping(alignment.remove_subsets(_sets(spark, sf_dir)))


@query(_aligned("disj", _JOINED))
def disjoint_sets(spark, sf_dir):
    return _disjoint(spark, sf_dir).select(_text())


@query(_aligned("named", "name, " + _JOINED))
def named_sets(spark, sf_dir):
    return alignment.name_clusters(_disjoint(spark, sf_dir)).select("name", _text())


@query(_aligned("ren", "split, label, name, pos"))
def renaming(spark, sf_dir):
    return alignment.renaming(alignment.name_clusters(_disjoint(spark, sf_dir))).select("split", "label", "name", "pos")


@query(_aligned("uni", "split, label, name, pos"))
def unique_names(spark, sf_dir):
    return alignment.aligned_names(tables.label_cube(spark, sf_dir)).select("split", "label", "name", "pos")


@query(_aligned("uni", "u.name AS cluster_label, u.split, count(*)::bigint AS cells, round(avg(l.latitude), 6) AS latitude, round(avg(l.longitude), 6) AS longitude").replace("FROM uni", "FROM uni u JOIN lab l ON u.split = l.split AND u.label = l.label GROUP BY ALL"), latitude=6, longitude=6)
def aligned_reduced(spark, sf_dir):
    """Cluster centres of all splits under their common names."""
    cube = tables.label_cube(spark, sf_dir).where("cluster_label <> 0")
    names = alignment.aligned_names(cube).select("split", F.col("label").alias("cluster_label"), "name")
    rows = cube.join(names, ["split", "cluster_label"])
    return rows.groupBy(F.col("name").alias("cluster_label"), "split").agg(F.count("*").alias("cells"), F.avg(LATITUDE).alias(LATITUDE), F.avg(LONGITUDE).alias(LONGITUDE))


class _Split:
    """A model whose cluster map is one split of the cube."""

    def __init__(self, cube: DataFrame, split: int):
        self.cluster_map = cube.where(F.col("split") == split).drop("split")


@query(_aligned("uni", "u.split, u.name AS cluster_label, count(*)::bigint AS cells FROM uni u JOIN lab l ON u.split = l.split AND u.label = l.label GROUP BY ALL").removesuffix(" FROM uni"))
def renamed_labels(spark, sf_dir):
    """Reduced tables of all splits (cells of a cluster), renamed by `rename_labels`."""
    cube = cut(tables.label_cube(spark, sf_dir))
    models = [_Split(cube, i) for i in range(4)]
    reduced = [m.cluster_map.where("cluster_label <> 0").groupBy(F.col("cluster_label").cast("smallint").alias("cluster_label")).agg(F.count("*").alias("cells")) for m in models]
    named = [df.select(F.lit(i).alias("split"), "cluster_label", "cells") for i, df in enumerate(alignment.rename_labels(models, reduced))]
    return reduce(DataFrame.unionByName, named)


def _fold(f: int) -> str:
    """Labelled cells of a model fitted on the training years of one of three folds."""
    years = f"anchor_year IN (SELECT anchor_year FROM ({_FOLDS_OF_FIELD}) WHERE split = {f} AND is_train)"
    inner = {n: f"SELECT * FROM ({B[n]}) WHERE {years}" for n in ("precursor", "target")}
    body = _with(**inner, **_CELLS, g=_NUMBERED, pt=_POINTS, e0=_EDGES, e=_BOTH, r=_REACH, l=_LABELS, c=_LABELLED).replace("WITH ", "WITH RECURSIVE ", 1)
    return body + f"SELECT {f} AS split, latitude, longitude, cluster_label::int AS label, area FROM c WHERE cluster_label <> 0"


_FOLDS_OF_FIELD = f"SELECT f::int AS split, anchor_year, NOT (i >= f * n // 3 AND i < (f + 1) * n // 3) AS is_train FROM range(3) a(f), (SELECT anchor_year, row_number() OVER (ORDER BY anchor_year) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT anchor_year FROM ({B['precursor']})))"
_CELLS_OF_FOLDS = " UNION ALL ".join(f"(SELECT * FROM fold{f})" for f in range(3))
_REDUCED_SPLITS = f"SELECT split, label, anchor_year, i_interval, sum(area * value) / sum(area) AS value FROM lab JOIN precursor USING (latitude, longitude) WHERE list_contains({MANY[1]}, i_interval) GROUP BY ALL"


@query(
    "WITH " + ", ".join(f"{n} AS ({x})" for n, x in [("precursor", B["precursor"]), *((f"fold{f}", _fold(f)) for f in range(3)), ("lab", _CELLS_OF_FOLDS), *((n, A[n]) for n in list(A)[1:]), ("red", _REDUCED_SPLITS)])
    + f", cen AS (SELECT split, label, sum(area * latitude) / sum(area) AS latitude, sum(area * longitude) / sum(area) AS longitude FROM lab GROUP BY ALL), ok AS (SELECT split, label FROM red GROUP BY ALL HAVING count(value) = (SELECT count(*) FROM (SELECT DISTINCT anchor_year, i_interval FROM precursor WHERE list_contains({MANY[1]}, i_interval)))) "
    "SELECT split::int AS split, anchor_year, i_interval, name AS cluster_label, round(cen.latitude, 6) AS latitude, round(cen.longitude, 6) AS longitude, round(value, 6) AS value FROM red JOIN ok USING (split, label) JOIN cen USING (split, label) JOIN uni USING (split, label)",
    **_D,
)
def aligned_splits(spark, sf_dir):
    """Clusters of a model fitted on the training years of each of three splits, under common names."""
    precursor, target = (cut(df) for df in _inputs(spark, sf_dir))
    models, reduced = [], []
    for x_train, _, y_train, _ in cal.Splitter.kfold(3).split(precursor, target):
        models.append(_model(MANY).fit(x_train, y_train))
        reduced.append(models[-1].transform(precursor))
    return reduce(DataFrame.unionByName, [df.select(F.lit(i).alias("split"), *df.columns) for i, df in enumerate(alignment.rename_labels(models, reduced))])


# files


def _written(spark, sf_dir) -> str:
    path = scratch(spark, "netcdf")
    netcdf.write_netcdf(tables.field_daily(spark, sf_dir), path)
    return path


@query(_with("daily") + _out(_FIELD, _V, "daily"), **_V)
def netcdf_field(spark, sf_dir):
    """The daily field, written to NetCDF files by all tasks and read from them."""
    return netcdf.read_netcdf(spark, _written(spark, sf_dir), missing=False)


_RANGES = {"time": (datetime(1996, 3, 1), datetime(1998, 2, 28)), LATITUDE: (30.0, 44.0), LONGITUDE: (180.0, None)}


@query(_with("daily") + "SELECT year(time)::int AS year, latitude, count(*)::bigint AS n, round(avg(value), 6) AS value FROM daily WHERE time BETWEEN '1996-03-01' AND '1998-02-28' AND latitude BETWEEN 30 AND 44 AND longitude >= 180 GROUP BY ALL", **_V)
def netcdf_ranges(spark, sf_dir):
    """Means over ranges of all axes, of which only the parts that may hold them are read."""
    rows = netcdf.read_netcdf(spark, _written(spark, sf_dir), ["value"], _RANGES, missing=False)
    return rows.groupBy(F.year("time").alias("year"), LATITUDE).agg(F.count("*").alias("n"), F.avg("value").alias("value"))


# what a model and a preprocessor show


@query(_with("monthly", t=_trend("monthly")) + _out("latitude longitude value_slope value_intercept", _SLOPE, "t"), **_SLOPE)
def trend_by_name(spark, sf_dir):
    return timeseries.get_trend(tables.field_monthly(spark, sf_dir), "linear")


@query(_with("monthly", t=_trend("monthly"), d=_detrended("monthly", "t")) + _out(_FIELD, _V, "d"), **_V)
def trend_subtracted(spark, sf_dir):
    data = tables.field_monthly(spark, sf_dir)
    return timeseries.subtract_trend(data, "linear", timeseries.get_trend(data, "linear"))


@query(_with("monthly", r=_SMOOTH, c=_clim("r", "monthly")) + _out("period latitude longitude value", _V, "c"), **_V)
def preprocess_climatology(spark, sf_dir):
    """The climatology property of a fit with smoothing."""
    return Preprocessor(3, "monthly").fit(tables.field_monthly(spark, sf_dir)).climatology


@query(_CLUSTERS + "SELECT latitude, longitude, cluster_label FROM c")
def cluster_preview(spark, sf_dir):
    return _model(MANY).preview_clusters(*_inputs(spark, sf_dir))


@query(_CLUSTERS + _out(_MAP + " cluster_label", _R, "c"), **_R)
def fitted_maps(spark, sf_dir):
    """The three maps of a fitted model, side by side."""
    model = _model(MANY).fit(*_inputs(spark, sf_dir))
    cells = [LATITUDE, LONGITUDE]
    return model.corr_map.join(model.pval_map, cells).join(model.cluster_map, cells)


@query(_CLUSTERS + "SELECT coalesce(bool_or(cluster_label <> 0), false) AS found FROM c")
def clusters_present(spark, sf_dir):
    return spark.createDataFrame([(cluster.assert_clusters_present(_clusters(spark, sf_dir)),)], "found boolean")


_SHOWN = f"'RGDR(' || chr(10) || '    target_intervals=[1, 2, 3, 4],' || chr(10) || '    lag=4,' || chr(10) || '    eps_km={EPS},' || chr(10) || '    alpha={ALPHA},' || chr(10) || '    min_area_km2=None' || chr(10) || ')'"


@query(_with("precursor", "target") + f"SELECT anchor_year, 'target' AS side, count(*)::bigint AS n, {_SHOWN} AS shown FROM target WHERE list_contains({MANY[0]}, i_interval) GROUP BY ALL UNION ALL SELECT anchor_year, 'precursor', count(*)::bigint, {_SHOWN} FROM precursor WHERE list_contains({MANY[1]}, i_interval) GROUP BY ALL")
def model_settings(spark, sf_dir):
    """Rows of each anchor year at the intervals that a model takes from the tables, and its printed form."""
    model = _model(MANY)
    sides = zip(("precursor", "target"), _inputs(spark, sf_dir), (model.precursor_intervals, model.target_intervals), strict=True)
    each = [df.where(F.col(INTERVAL).isin(some)).groupBy(ANCHOR_YEAR).agg(F.count("*").alias("n")).select(ANCHOR_YEAR, F.lit(side).alias("side"), "n") for side, df, some in sides]
    return reduce(DataFrame.unionByName, each).withColumn("shown", F.lit(repr(model)))


# calendar


def _calendar() -> cal.Calendar:
    return cal.Calendar("08-01").add_intervals("target", "1M", 4).add_intervals("precursor", "1M", 4)


def _spelled(n: int) -> str:
    """Intervals of four targets and n precursors, of all years that lie within the lineitems."""
    years = f"SELECT y FROM (SELECT min(l_shipdate)::date AS low, max(l_shipdate)::date + 1 AS high FROM lineitem) s, range(1900, 2100) a(y) WHERE make_date(y, 8, 1) - {n} * INTERVAL 1 MONTH >= low AND make_date(y, 12, 1) <= high"
    return (
        f"SELECT y::int AS anchor_year, i::int AS i_interval, (make_date(y, 8, 1) + (i - 1) * INTERVAL 1 MONTH)::date AS \"left\", (make_date(y, 8, 1) + i * INTERVAL 1 MONTH)::date AS \"right\", true AS is_target FROM ({years}), range(1, 5) b(i) "
        f"UNION ALL SELECT y::int, -i::int, (make_date(y, 8, 1) - i * INTERVAL 1 MONTH)::date, (make_date(y, 8, 1) - (i - 1) * INTERVAL 1 MONTH)::date, false FROM ({years}), range(1, {n + 1}) b(i)"
    )


_SPELLED = _spelled(4)


def _text_bounds(df: DataFrame) -> DataFrame:
    text = lambda c: F.col(c).cast("string").alias(c)
    return df.select(ANCHOR_YEAR, INTERVAL, text("left"), text("right"), "is_target")


@query(f'SELECT anchor_year, i_interval, "left"::varchar AS "left", "right"::varchar AS "right", is_target FROM ({_SPELLED})')
def calendar_intervals(spark, sf_dir):
    """The intervals of all anchor years that the daily field spans."""
    return _text_bounds(_calendar().map_to_data(tables.field_daily(spark, sf_dir)).intervals(spark))


@query(_with("daily", k=_SPELLED) + 'SELECT anchor_year, i_interval, latitude, longitude, round(avg(value), 6) AS value FROM daily JOIN k ON time >= "left" AND time < "right" GROUP BY ALL', **_V)
def resample_mean(spark, sf_dir):
    data = tables.field_daily(spark, sf_dir)
    return cal.resample(_calendar().map_to_data(data), data)


_FOLDS = "SELECT f::int AS split, anchor_year, NOT (i >= f * n // 3 AND i < (f + 1) * n // 3) AS is_train FROM range(3) a(f), (SELECT anchor_year, row_number() OVER (ORDER BY anchor_year) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT anchor_year FROM target))"


@query(_with("target", s=_FOLDS) + "SELECT split, anchor_year, i_interval, is_train, round(value, 6) AS value FROM target JOIN s USING (anchor_year)", **_V)
def train_test_rows(spark, sf_dir):
    data = tables.target(spark, sf_dir)
    return cal.split_rows(data, cal.kfold_splits(data, 3)).select("split", ANCHOR_YEAR, INTERVAL, "is_train", "value")


@query(f'SELECT anchor_year, i_interval, "left"::varchar AS "left", "right"::varchar AS "right", is_target FROM ({_spelled(8)})')
def calendar_monthly(spark, sf_dir):
    """A calendar of whole years of months over the daily field."""
    return _text_bounds(cal.monthly_calendar("08-01", "1M", 4).map_to_data(tables.field_daily(spark, sf_dir)).intervals(spark))


@query("SELECT y::int AS anchor_year, i::int AS i_interval FROM (SELECT min(l_shipdate)::date AS low, max(l_shipdate)::date + 1 AS high FROM lineitem) s, range(1980, 2040) a(y), range(-4, 5) b(i) WHERE i <> 0 AND make_date(y, 4, 1) >= low AND make_date(y, 12, 1) <= high")
def calendar_of_data(spark, sf_dir):
    """The intervals of the years that the data span, as shown."""
    days = tables.field_daily(spark, sf_dir)
    return _calendar().map_to_data(days).show(spark).select(ANCHOR_YEAR, INTERVAL)


@query(_with("target", s=_FOLDS) + "SELECT split, is_train, count(*)::bigint AS n, round(avg(value), 6) AS value FROM target JOIN s USING (anchor_year) GROUP BY ALL", **_V)
def splitter_means(spark, sf_dir):
    """Rows and means of both parts of each split."""
    data = tables.target(spark, sf_dir)
    each = [part.select(F.lit(i).alias("split"), F.lit(j == 0).alias("is_train"), "value") for i, pair in enumerate(cal.Splitter.kfold(3).split(data)) for j, part in enumerate(pair)]
    return reduce(DataFrame.unionByName, each).groupBy("split", "is_train").agg(F.count("*").alias("n"), F.avg("value").alias("value"))


_HOURS = (
    "SELECT i::int AS i_interval, h + (i - 1) * INTERVAL 6 HOUR AS l, h + i * INTERVAL 6 HOUR AS r FROM anchor, range(1, 9) b(i) "
    "UNION ALL SELECT -i::int, h - i * INTERVAL 90 MINUTE, h - (i - 1) * INTERVAL 90 MINUTE FROM anchor, range(1, 13) b(i)"
)


@query(f"WITH anchor AS (SELECT make_timestamp(year(min(ts)), 1, 15, 12, 0, 0) AS h FROM events), k AS ({_HOURS}) SELECT year(h)::int AS anchor_year, i_interval, event_type, round(avg(value), 6) AS value FROM events, anchor, k WHERE ts >= l AND ts < r GROUP BY ALL", **_V)
def resample_hours(spark, sf_dir):
    """Means of events over intervals within a day: eight of six hours after noon of an anchor day, twelve of 90 minutes before."""
    events = tables.table(spark, sf_dir, "events").select(F.col("ts").alias("time"), "event_type", "value")
    year = events.agg(F.year(F.min("time"))).first()[0]
    hours = cal.Calendar("01-15 12:00").add_intervals("target", "6h", 8).add_intervals("precursor", "90min", 12)
    return cal.resample(hours.map_years(year, year), events)


_WEEKS = (
    "SELECT y::int AS anchor_year, i::int AS i_interval, make_date(y::int, 8, 1) + (i::int - 1) * 14 AS l, make_date(y::int, 8, 1) + i::int * 14 AS r FROM years, range(1, 4) b(i) "
    "UNION ALL SELECT y::int, -i::int, make_date(y::int, 8, 1) - i::int * 14, make_date(y::int, 8, 1) - (i::int - 1) * 14 FROM years, range(1, 24) b(i)"
)


@query(f"WITH years AS (SELECT y FROM (SELECT min(l_shipdate)::date AS low, max(l_shipdate)::date + 1 AS high FROM lineitem) s, range(1900, 2100) a(y) WHERE make_date(y::int, 8, 1) - 23 * 14 >= low AND make_date(y::int, 8, 1) + 42 <= high), k AS ({_WEEKS}), daily AS ({B['daily']}) SELECT anchor_year, i_interval, latitude, longitude, round(avg(value), 6) AS value FROM daily JOIN k ON time >= l AND time < r GROUP BY ALL", **_V)
def resample_weekly(spark, sf_dir):
    """Means over three intervals of two weeks from the anchor on and 23 before it, of all years that the daily field spans."""
    data = tables.field_daily(spark, sf_dir)
    return cal.resample(cal.weekly_calendar("08-01", "2W", 3).map_to_data(data), data)


_STEPS = "SELECT '{0}' AS field, floor(median(step) / 86400)::int AS days FROM (SELECT epoch(time) - lag(epoch(time)) OVER (ORDER BY time) AS step FROM (SELECT DISTINCT time FROM {0}))"


@query(_with("daily", "monthly", "event", d=" UNION ALL ".join(_STEPS.format(t) for t in ("daily", "monthly", "event"))) + "SELECT field, timescale, days BETWEEN low AND high AS fits FROM d, (VALUES ('monthly', 28, 31), ('weekly', 7, 7), ('daily', 1, 1)) s(timescale, low, high)")
def resolution_match(spark, sf_dir):
    """Whether the steps of three fields fit the timescales of a preprocessor."""
    fields = {"daily": tables.field_daily(spark, sf_dir), "monthly": tables.field_monthly(spark, sf_dir), "event": tables.event_daily(spark, sf_dir)}
    out = []
    for name, data in fields.items():
        check_input(data)
        days = timeseries.resolution_days(data)
        out += [days.select(F.lit(name).alias("field"), F.lit(scale).alias("timescale"), timeseries.fits(F.col("days"), scale).alias("fits")) for scale in timeseries.TIMESCALES]
    return reduce(DataFrame.unionByName, out)


# the monthly queries over all rows, without a choice of years

for _name in "clim_monthly anomaly_monthly trend_linear detrend_linear preprocess_full preprocess_no_clim preprocess_no_detrend preprocess_trend".split():
    QUERIES[f"{_name}_whole"] = partial(QUERIES[_name], years=None)
    ORACLE_SQL[f"{_name}_whole"] = ORACLE_SQL[_name].replace(f" WHERE year(l_shipdate) {_MONTHS}", "")
