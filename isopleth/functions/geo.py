"""Geometry on the sphere as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .schema import LATITUDE, LONGITUDE, require

# fixed values: earth's radius for distances, and its surface for areas
RADIUS_EARTH_KM = 6371
SURFACE_AREA_EARTH_KM2 = 5.10072e8


def _column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def spherical_area(latitude, dlat, dlon=None) -> Column:
    """Area in km2 of a cell of dlat x dlon degrees centred on a latitude: its share of the whole sphere."""
    latitude, dlat = _column(latitude), _column(dlat)
    dlon = dlat if dlon is None else _column(dlon)
    height = F.sin(F.radians(latitude + dlat / 2)) - F.sin(F.radians(latitude - dlat / 2))
    return height * F.radians(dlon) / (4 * 3.141592653589793) * SURFACE_AREA_EARTH_KM2


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km."""
    half = lambda a, b: F.sin(F.radians(b - a) / 2)
    h = half(lat1, lat2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2) ** 2
    return 2 * RADIUS_EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def grid_spacing(df: DataFrame, lat_order: str = "desc") -> DataFrame:
    """One row: absolute differences of the first two latitudes and longitudes of an even grid."""
    require(df, LATITUDE, LONGITUDE)
    # the two ends of an axis that count are extremes, which partitions combine
    first = F.max if lat_order == "desc" else F.min
    ends = df.agg(first(LATITUDE).alias("lat"), F.min(LONGITUDE).alias("lon"))
    rest = df.crossJoin(F.broadcast(ends))  # one row
    second = lambda c, end, extreme: extreme(F.when(F.col(c) != F.col(end), F.col(c)))
    return rest.agg(F.abs(second(LATITUDE, "lat", first) - F.first("lat")).alias("dlat"), F.abs(second(LONGITUDE, "lon", F.min) - F.first("lon")).alias("dlon"))


def add_gridcell_area(df: DataFrame, lat_order: str = "desc") -> DataFrame:
    """Adds the area of each cell of an even grid."""
    spacing = F.broadcast(grid_spacing(df, lat_order))  # one row
    return df.crossJoin(spacing).withColumn("area", spherical_area(F.col(LATITUDE), F.col("dlat"), F.col("dlon"))).drop("dlat", "dlon")
