"""Alignment of cluster labels over splits: overlaps, sets of matching clusters, common names.

The only large table is the one of labelled cells (split, latitude, longitude, cluster_label); it is read by one
aggregate and one join by cell. Everything after has a row for each cluster or pair of clusters.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.schema import LATITUDE, LONGITUDE, require
from ..plans.session import cut
from .cluster import LABEL

NAMES = 26 + 26 * 26


def clusters(labels: DataFrame) -> DataFrame:
    """split, label, and size in cells, of all clusters."""
    require(labels, "split", LATITUDE, LONGITUDE, LABEL)
    return labels.where(F.col(LABEL) != 0).groupBy("split", F.col(LABEL).cast("int").alias("label")).agg(F.count("*").alias("size"))


def _side(df: DataFrame, s: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{c}_{s}") if c in ("split", "label", "size") else F.col(c) for c in df.columns])


def covered(labels: DataFrame) -> DataFrame:
    """Pairs of clusters of one sign in different splits that share cells, with the share of the first one: the nonzero overlaps."""
    each = clusters(labels)
    cells = labels.where(F.col(LABEL) != 0).select("split", LATITUDE, LONGITUDE, F.col(LABEL).cast("int").alias("label"))
    both = _side(cells, "a").join(_side(cells, "b"), [LATITUDE, LONGITUDE]).where("split_a <> split_b and sign(label_a) = sign(label_b)")
    common = both.groupBy("split_a", "label_a", "split_b", "label_b").agg(F.count("*").alias("n"))
    shares = common.join(_side(each, "a"), ["split_a", "label_a"])
    return shares.select("split_a", "label_a", "split_b", "label_b", (F.col("n") / F.col("size_a")).alias("overlap"))


def overlap_table(labels: DataFrame) -> DataFrame:
    """For all pairs of clusters the share of the first that the second covers; NULL within a split or over signs.

    The square table is for people; sets are made from its nonzero part, `covered`.
    """
    each = clusters(labels).drop("size")
    pairs = _side(each, "a").crossJoin(_side(each, "b"))  # what is asked for: all pairs
    pairs = pairs.join(covered(labels), ["split_a", "label_a", "split_b", "label_b"], "left")
    comparable = (F.col("split_a") != F.col("split_b")) & (F.signum("label_a") == F.signum("label_b"))
    return pairs.select("split_a", "label_a", "split_b", "label_b", F.when(comparable, F.coalesce("overlap", F.lit(0.0))).alias("overlap"))


def _member(split: str, label: str) -> Column:
    return F.concat_ws("_", F.col(split).cast("string"), F.col(label).cast("string"))


def overlapping_clusters(labels: DataFrame, min_overlap: float = 0.1) -> DataFrame:
    """Distinct sets: each cluster with those that cover more than the threshold of it. One sorted array, `members`."""
    table = covered(labels) if min_overlap >= 0 else overlap_table(labels)
    others = table.where(F.col("overlap") > min_overlap).select(F.col("split_a").alias("split"), F.col("label_a").alias("label"), _member("split_b", "label_b").alias("member"))
    own = clusters(labels).select("split", "label", _member("split", "label").alias("member"))
    sets = own.unionByName(others).groupBy("split", "label").agg(F.array_sort(F.collect_set("member")).alias("members"))
    return sets.select("members").distinct()


def remove_subsets(sets: DataFrame) -> DataFrame:
    """Sets that are within no other set."""
    # a larger set shares all members, so its rows meet the smaller set's first member
    a = sets.withColumn("member", F.get("members", F.lit(0))).alias("a")
    b = sets.withColumn("member", F.explode("members")).alias("b")
    within = (F.col("a.member") == F.col("b.member")) & (F.size(F.array_except("a.members", "b.members")) == 0) & (F.col("a.members") != F.col("b.members"))
    return a.join(b, within, "left_anti").drop("member")


def remove_overlapping(sets: DataFrame) -> DataFrame:
    """Disjoint sets: a member stays in the largest set that has it (ties: the later in order of members)."""
    place = F.struct(F.size("members").alias("size"), F.array_join("members", "|").alias("text"))  # orders the sets; no two are equal
    member = sets.select(place.alias("place"), F.explode("members").alias("member"))
    last = member.groupBy("member").agg(F.max("place").alias("place"))
    return last.groupBy("place").agg(F.array_sort(F.collect_list("member")).alias("members")).select("members")


def _letter(n: Column) -> Column:
    return F.char(n + 65)


def name_clusters(sets: DataFrame) -> DataFrame:
    """Names A to Z, then AA to ZZ, by the sum of the code points of a set's printed form, descending."""
    codes = F.aggregate(F.transform(F.split(F.array_join("members", ""), ""), lambda c: F.ascii(c)), F.lit(0), lambda a, b: a + b)
    n = F.size("members")
    key = codes + 78 * n + 76 * (n - 1)  # each member in quotes, and a comma and a space between two
    place = F.row_number().over(Window.orderBy(key.desc(), F.array_join("members", "|"))) - 1  # one row for each set
    name = F.when(F.col("p") < 26, _letter(F.col("p"))).when(F.col("p") < NAMES, F.concat(_letter(F.floor((F.col("p") - 26) / 26)), _letter((F.col("p") - 26) % 26)))
    return sets.withColumn("p", place).select(F.coalesce(name, F.raise_error(F.lit(f"there are more than {NAMES} sets of clusters"))).alias("name"), "members")


def renaming(named: DataFrame) -> DataFrame:
    """split, label, name, and place `pos` in the split's list."""
    part = F.split("member", "_")
    rows = named.select("name", F.explode("members").alias("member")).select(part[0].cast("int").alias("split"), part[1].cast("int").alias("label"), "name")
    order = Window.partitionBy("split").orderBy(F.length("name"), "name", F.abs("label"), "label")
    return rows.withColumn("pos", F.row_number().over(order))


def ensure_unique_names(names: DataFrame) -> DataFrame:
    """A name that repeats within some split gets a number, everywhere."""
    of = Window.partitionBy("split", "name")
    counted = names.withColumn("_n", F.count("*").over(of)).withColumn("_i", F.row_number().over(of.orderBy("pos")))
    repeated = F.max(F.col("_n")).over(Window.partitionBy("name")) > 1
    return counted.withColumn("name", F.when(repeated, F.concat("name", F.col("_i").cast("string"))).otherwise(F.col("name"))).drop("_n", "_i")


def aligned_names(labels: DataFrame, min_overlap: float = 0.1) -> DataFrame:
    """split, label and common name of all clusters."""
    sets = remove_overlapping(remove_subsets(overlapping_clusters(labels, min_overlap)))
    return ensure_unique_names(renaming(name_clusters(sets)))


def split_labels(cluster_maps: Sequence[DataFrame]) -> DataFrame:
    """One table of labelled cells from a cluster map for each split."""
    each = [m.select(F.lit(i).alias("split"), LATITUDE, LONGITUDE, LABEL) for i, m in enumerate(cluster_maps)]
    return reduce(DataFrame.unionByName, each)


def rename_labels(rgdr_list: Sequence, clustered_data: Sequence[DataFrame]) -> list[DataFrame]:
    """The reduced data of fitted splits with common names, as strings, for labels."""
    if len(rgdr_list) != len(clustered_data):
        raise ValueError("there have to be as many reduced tables as fitted models")
    names = cut(aligned_names(split_labels([r.cluster_map for r in rgdr_list])))  # a row for each cluster
    out = []
    for i, data in enumerate(clustered_data):
        own = names.where(F.col("split") == i).select(F.col("label").alias(LABEL), "name")
        joined = data.join(own, LABEL, "left")
        out.append(joined.select(*[F.coalesce("name", F.col(LABEL).cast("string")).alias(c) if c == LABEL else F.col(c) for c in data.columns]))
    return out
