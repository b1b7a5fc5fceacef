"""Clusters of significant cells of a correlation map: spherical neighbourhoods, sign by sign."""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import RADIUS_EARTH_KM, add_gridcell_area, haversine_km
from ..functions.schema import LATITUDE, LONGITUDE, require
from ..plans.session import cut
from .graph import connected_components

LABEL = "cluster_label"


def significant(cells: DataFrame, alpha: float) -> DataFrame:
    """Cells with p < alpha and their sign (a correlation of 0 is positive)."""
    require(cells, LATITUDE, LONGITUDE, "corr", "p_val")
    return cells.where(F.col("p_val") < alpha).withColumn("sign", F.when(F.col("corr") >= 0, 1).otherwise(-1))


def _columns_of(band: Column, degrees: float) -> Column:
    """Number of longitude buckets of a latitude band, each at least as wide as a neighbourhood there."""
    top = F.greatest(F.abs(band - 1), F.abs(band + 2)) * degrees
    reach = F.asin(F.least(F.lit(1.0), F.sin(F.radians(F.lit(degrees))) / F.greatest(F.cos(F.radians(top)), F.lit(1e-9))))
    return F.when(top + degrees >= 89.9, 1).otherwise(F.greatest(F.lit(1), F.floor(360 / (F.degrees(reach) * 1.000001)))).cast("int")


def _touching(points: DataFrame, reach_km: float, condition: Column) -> DataFrame:
    """Pairs (l, r) of rows of one sign in the same or touching buckets as wide as the reach, that meet a condition."""
    degrees = max(1e-6, math.degrees(reach_km / RADIUS_EARTH_KM) * 1.000001)
    turn = F.pmod(F.col(LONGITUDE), F.lit(360.0))
    bucket = lambda band: F.floor(turn / (360 / _columns_of(band, degrees))).cast("int")
    band = F.floor(F.col(LATITUDE) / degrees).cast("int")
    left = points.withColumn("band", band).withColumn("col", F.least(bucket(F.col("band")), _columns_of(F.col("band"), degrees) - 1))
    right = points.withColumn("band", F.explode(F.array(band - 1, band, band + 1)))
    around = F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(F.least(bucket(F.col("band")), _columns_of(F.col("band"), degrees) - 1) + d, _columns_of(F.col("band"), degrees)))
    right = right.withColumn("col", F.explode(F.array_distinct(around)))
    keys = (F.col("l.sign") == F.col("r.sign")) & (F.col("l.band") == F.col("r.band")) & (F.col("l.col") == F.col("r.col"))
    return left.alias("l").join(right.alias("r"), keys & condition)


def eps_edges(points: DataFrame, eps_km: float) -> DataFrame:
    """Pairs (sign, a, b) of points (id, sign, latitude, longitude) of one sign within eps of each other, and a = b."""
    near = haversine_km(F.col(f"l.{LATITUDE}"), F.col(f"l.{LONGITUDE}"), F.col(f"r.{LATITUDE}"), F.col(f"r.{LONGITUDE}")) <= eps_km
    pairs = _touching(points, eps_km, (F.col("l.id") <= F.col("r.id")) & (near | (F.col("l.id") == F.col("r.id"))))
    return pairs.select(F.col("l.sign").alias("sign"), F.col("l.id").alias("a"), F.col("r.id").alias("b"))


#: Points of a box that are compared with those of another one before the boxes are divided: its extremes in these directions.
DIRECTIONS = ((1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (1, -1), (-1, 1), (-1, -1))


def _boxes(points: DataFrame, *keys: str) -> DataFrame:
    """For each box (keys) its bounds and the extreme points, from points with `lat` and `lon` (0 to 360)."""
    point = F.struct("lat", "lon")
    extremes = F.array(*[F.max_by(point, a * F.col("lat") + b * F.col("lon")) for a, b in DIRECTIONS])
    bounds = [F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east")]
    return points.groupBy(*keys).agg(*bounds, F.array_distinct(extremes).alias("some"))


def _apart(a: str, b: str) -> Column:
    """A distance in km that no two points of two boxes fall below: exact for boxes that are points."""
    lat = F.greatest(F.lit(0.0), F.col(f"{a}.south") - F.col(f"{b}.north"), F.col(f"{b}.south") - F.col(f"{a}.north"))
    east = F.greatest(F.lit(0.0), F.col(f"{b}.west") - F.col(f"{a}.east"), F.col(f"{a}.west") - F.col(f"{b}.east"))
    around = F.greatest(F.lit(0.0), 360 - (F.greatest(F.col(f"{a}.east"), F.col(f"{b}.east")) - F.least(F.col(f"{a}.west"), F.col(f"{b}.west"))))
    narrow = lambda s: F.cos(F.radians(F.greatest(F.abs(F.col(f"{s}.south")), F.abs(F.col(f"{s}.north")))))
    half = lambda x: F.sin(F.radians(x) / 2) ** 2
    h = half(lat) + narrow(a) * narrow(b) * half(F.least(east, around, F.lit(180.0)))
    return 2 * RADIUS_EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def _touch(a: str, b: str, eps_km: float) -> Column:
    """Whether two extreme points of two boxes are within eps."""
    near = lambda p, q: haversine_km(p["lat"], p["lon"], q["lat"], q["lon"]) <= eps_km
    return F.exists(F.col(f"{a}.some"), lambda p: F.exists(F.col(f"{b}.some"), lambda q: near(p, q)))


def _point(a: str) -> Column:
    return (F.col(f"{a}.south") == F.col(f"{a}.north")) & (F.col(f"{a}.west") == F.col(f"{a}.east"))


def close_tiles(points: DataFrame, eps_km: float, reach_km: float) -> DataFrame:
    """Pairs (sign, a, b) of tiles that have two points within eps; points: sign, tile, lat, lon (0 to 360).

    Two tiles are compared as boxes: they are close if two of their extreme points are, and apart if their bounds are. What
    neither settles is divided, each box into quarters of its bounds, and the quarters are compared in the next round, until
    a pair is found or none is left; boxes shrink to points, for which both tests are exact. A pair of tiles ends with
    the first close pair of boxes, so that the work follows the number of points and not of pairs.
    """
    held = cut(points.select("sign", "tile", "lat", "lon", F.lit(1).cast("long").alias("box")))
    boxes = _boxes(held, "sign", "tile", "box")
    center = boxes.withColumn(LATITUDE, (F.col("south") + F.col("north")) / 2).withColumn(LONGITUDE, (F.col("west") + F.col("east")) / 2)
    pairs = _touching(center, reach_km, (F.col("l.tile") < F.col("r.tile")) & (_apart("l", "r") <= eps_km))
    found = None
    while True:
        pairs = pairs.select(F.col("l.sign").alias("sign"), F.col("l.tile").alias("a"), F.col("r.tile").alias("b"), F.col("l.box").alias("box_a"), F.col("r.box").alias("box_b"), _touch("l", "r", eps_km).alias("close"), (_point("l") & _point("r")).alias("points"))
        pairs = cut(pairs)
        close = pairs.where("close").select("sign", "a", "b").distinct()
        found = close if found is None else found.unionByName(close)
        open_ = pairs.where("not points").join(close, ["sign", "a", "b"], "left_anti").select("sign", "a", "b", "box_a", "box_b")
        if open_.isEmpty():
            return found
        # the boxes that are still open, each once, in quarters; their numbers tell the way from the tile down
        some = open_.select("sign", F.col("a").alias("tile"), F.col("box_a").alias("box")).unionByName(open_.select("sign", F.col("b").alias("tile"), F.col("box_b").alias("box"))).distinct()
        held = held.join(some, ["sign", "tile", "box"])
        bounds = _boxes(held, "sign", "tile", "box").drop("some")
        # the far end of a side is always in the upper half, so that boxes shrink to points
        upper = lambda x, low, high: ((F.col(x) > (F.col(low) + F.col(high)) / 2) | ((F.col(x) == F.col(high)) & (F.col(low) < F.col(high)))).cast("int")
        quarter = upper("lat", "south", "north") * 2 + upper("lon", "west", "east")
        held = cut(held.join(bounds, ["sign", "tile", "box"]).select("sign", "tile", "lat", "lon", F.struct("box", quarter.alias("quarter")).alias("way")))
        # numbers of ways are made short again, so that any depth fits
        ways = _boxes(held, "sign", "tile", "way")
        number = F.dense_rank().over(Window.partitionBy("sign", "tile").orderBy("way")).cast("long")
        ways = cut(ways.withColumn("box", number))
        held = cut(held.join(ways.select("sign", "tile", "way", "box"), ["sign", "tile", "way"]).select("sign", "tile", "lat", "lon", "box"))
        sides = open_
        for side, tile, own in (("l", "a", "box_a"), ("r", "b", "box_b")):
            quarters = ways.select(F.struct(*[c for c in ways.columns if c != "way"]).alias(side), F.col("sign").alias("_sign"), F.col("tile").alias("_tile"), F.col("way.box").alias("_box"))
            sides = sides.join(quarters, (F.col("sign") == F.col("_sign")) & (F.col(tile) == F.col("_tile")) & (F.col(own) == F.col("_box"))).drop("_sign", "_tile", "_box")
        pairs = sides.where(_apart("l", "r") <= eps_km)


def links(points: DataFrame, eps_km: float) -> DataFrame:
    """As many edges (sign, a, b) as give the same components, in proportion to the points however dense these are.

    Points of a tile whose sides are half of eps are all within eps, by the way along a meridian and a parallel, and are
    linked with the tile's first point. Of two tiles with two points within eps, their first points are linked.
    """
    half = math.degrees(eps_km / RADIUS_EARTH_KM) / 2 * 0.999999
    if half <= 0:
        return eps_edges(points, eps_km)
    row = F.floor(F.col(LATITUDE) / half).cast("long")
    least = F.when(row >= 0, row * half).otherwise(-(row + 1) * half)  # of the latitudes without sign, where parallels are longest
    columns = F.greatest(F.ceil(360 * F.cos(F.radians(F.least(least, F.lit(90.0)))) / half), F.lit(1))
    turn = F.pmod(F.col(LONGITUDE), F.lit(360.0))
    column = F.floor(turn / (360 / columns)).cast("long")
    tiled = points.withColumn("tile_row", row).withColumn("tile_column", column)
    tiled = tiled.withColumn("tile", F.min("id").over(Window.partitionBy("sign", "tile_row", "tile_column")))
    tiled = tiled.select("sign", "tile", "id", F.col(LATITUDE).alias("lat"), turn.alias("lon"))
    within = tiled.select("sign", F.col("tile").alias("a"), F.col("id").alias("b"))
    # the middles of two tiles' bounds are farther apart than their points by a diagonal at most
    return within.unionByName(close_tiles(tiled, eps_km, 1.75 * eps_km))


def numbered(cells: DataFrame, lat_order: str = "desc") -> DataFrame:
    """Cells with an `id` that follows the stored order of a grid: latitude by latitude, then longitude ascending.

    The id is made of the coordinates in millionths of a degree, so that numbering needs no shuffle.
    """
    south = (90 - F.col(LATITUDE)) if lat_order == "desc" else (90 + F.col(LATITUDE))
    micro = lambda c: F.round(c * 1e6).cast("long")
    return cells.withColumn("id", micro(south) * (1 << 31) + micro(F.col(LONGITUDE) + 360))


def cluster_labels(cells: DataFrame, eps_km: float, alpha: float, lat_order: str = "desc", label_type: str = "smallint") -> DataFrame:
    """All cells with `cluster_label`: sign x number of the cluster by its first cell, or 0.

    label_type: int for more than 32 767 clusters of a sign.

    With one point enough for a cluster, density clustering is the components of the graph of neighbourhoods.
    """
    cells = cells if "id" in cells.columns else numbered(cells, lat_order)
    points = significant(cells, alpha).select("id", "sign", LATITUDE, LONGITUDE)
    found = cut(connected_components(links(points, eps_km).withColumnRenamed("sign", "part")))
    # numbers go to clusters, of which there are far fewer than cells
    number = F.row_number().over(Window.partitionBy("part").orderBy("component"))
    numbers = found.select("part", "component").distinct().withColumn("number", number)
    labels = found.join(numbers, ["part", "component"]).select("id", (F.col("part") * F.col("number")).cast(label_type).alias(LABEL))
    out = cells.drop(LABEL).join(labels, "id", "left").withColumn(LABEL, F.coalesce(F.col(LABEL), F.lit(0)).cast(label_type))
    return out.select(*[c for c in cells.columns if c not in (LABEL, "id")], LABEL)


def cluster_area(cells: DataFrame) -> DataFrame:
    """Area of each label."""
    require(cells, LABEL, "area")
    return cells.groupBy(LABEL).agg(F.sum("area").alias("area"))


def remove_small_area_clusters(cells: DataFrame, min_area_km2: float) -> DataFrame:
    """Labels whose area is not above the threshold become 0; the others keep their number."""
    kept = cluster_area(cells).where(F.col("area") > min_area_km2).select(LABEL, F.lit(True).alias("_kept"))
    out = cells.join(kept, LABEL, "left").withColumn(LABEL, F.when(F.col("_kept"), F.col(LABEL)).otherwise(0).cast(cells.schema[LABEL].dataType))
    return out.select(*cells.columns)


def assert_clusters_present(cells: DataFrame) -> bool:
    """Warns if there is no cluster."""
    found = not cells.where(F.col(LABEL) != 0).isEmpty()
    if not found:
        # fixed value: the text that callers know
        warnings.warn("No significant clusters found in the input DataFrame", stacklevel=2)
    return found


def spherical_clusters(cells: DataFrame, eps_km: float, alpha: float, min_area_km2: float | None = None, lat_order: str = "desc", label_type: str = "smallint") -> DataFrame:
    """Cell map (latitude, longitude, corr, p_val) with area and cluster_label."""
    cells = cut(numbered(add_gridcell_area(cells, lat_order), lat_order))  # read for the points, their links and the map
    out = cluster_labels(cells, eps_km, alpha, lat_order, label_type)
    return out if min_area_km2 is None else remove_small_area_clusters(out, min_area_km2)
