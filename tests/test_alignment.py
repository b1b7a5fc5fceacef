import collections

import numpy as np
import pytest

from isopleth.operators import alignment

CELLS = [(split, row, column) for split in range(4) for row in range(5) for column in range(13)]


def cube(spark, seed=3):
    """Patches of both signs that move a little from split to split, and some that only one split has."""
    rng = np.random.default_rng(seed)
    label = {}
    for split in range(4):
        for number, (row, column) in enumerate([(0, 1), (0, 7), (3, 2), (3, 9)], 1):
            if rng.random() < 0.8:
                up, right = rng.integers(0, 2, 2)
                for cell in [(row + up + i, column + right + j) for i in range(1) for j in range(rng.integers(1, 5))]:
                    label[(split, *cell)] = number if number % 2 else -number
        row, column = rng.integers(0, 5), rng.integers(0, 13)
        label.setdefault((split, row, column), 5)
    return spark.createDataFrame([(s, 50.0 - r, 10.0 + c, label.get((s, r, c), 0)) for s, r, c in CELLS], "split int, latitude double, longitude double, cluster_label int"), label


def sets_of(label, threshold=0.1):
    """Each cluster with those of other splits and the same sign that cover more than the threshold of it."""
    where = collections.defaultdict(set)
    for (split, *cell), x in label.items():
        where[split, x].add(tuple(cell))
    return {
        " ".join(sorted({f"{s}_{x}"} | {f"{t}_{y}" for (t, y), other in where.items() if t != s and (x > 0) == (y > 0) and len(own & other) / len(own) > threshold}))
        for (s, x), own in where.items()
    }


def frame(spark, sets):
    return spark.createDataFrame([(sorted(s.split()),) for s in sets], "members array<string>")


def got(df):
    rows = [" ".join(sorted(r["members"])) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("seed", [3, 4])
def test_sets_of_overlapping_clusters(spark, seed):
    table, label = cube(spark, seed)
    sets = sets_of(label, 0.4)
    assert len(sets) > 4 and got(alignment.overlapping_clusters(table, 0.4)) == sets
    maximal = {a for a in sets if not any(set(a.split()) < set(b.split()) for b in sets)}
    assert maximal < sets and got(alignment.remove_subsets(frame(spark, sets))) == maximal


def test_larger_sets_win(spark):
    one = frame(spark, ["0_-1 1_-2", "0_-1 1_-1 2_-1"])
    assert got(alignment.remove_overlapping(one)) == {"1_-2", "0_-1 1_-1 2_-1"}
    named = {r["name"]: set(r["members"]) for r in alignment.name_clusters(one).collect()}
    assert named == {"A": {"0_-1", "1_-1", "2_-1"}, "B": {"0_-1", "1_-2"}}


def test_renaming(spark):
    named = spark.createDataFrame([("A", ["0_-1", "1_-1", "2_-1"]), ("B", ["0_-2", "1_-2"])], "name string, members array<string>")
    rows = alignment.renaming(named).orderBy("split", "pos").collect()
    assert [(r["split"], r["label"], r["name"]) for r in rows] == [(0, -1, "A"), (0, -2, "B"), (1, -1, "A"), (1, -2, "B"), (2, -1, "A")]


def test_unique_names(spark):
    names = spark.createDataFrame([(0, -1, "B", 1), (1, -2, "B", 1), (1, -1, "B", 2), (2, -1, "B", 1), (2, 1, "C", 2)], "split int, label int, name string, pos int")
    rows = {(r["split"], r["label"]): r["name"] for r in alignment.ensure_unique_names(names).collect()}
    assert rows == {(0, -1): "B1", (1, -2): "B1", (1, -1): "B2", (2, -1): "B1", (2, 1): "C"}


def test_names_after_z(spark):
    many = frame(spark, [f"0_{i}" for i in range(1, 60)])
    names = {r["name"] for r in alignment.name_clusters(many).collect()}
    assert len(names) == 59 and {"A", "Z", "AA", "BA"} <= names


def test_too_many_names(spark):
    many = frame(spark, [f"0_{i}" for i in range(1, 704)])
    with pytest.raises(Exception, match="more than 702"):
        alignment.name_clusters(many).collect()


def test_rename_labels(spark):
    table, _ = cube(spark)

    class Fitted:
        def __init__(self, split):
            self.cluster_map = table.where(f"split = {split}").drop("split")

    models = [Fitted(s) for s in range(4)]
    data = [f.cluster_map.groupBy("cluster_label").count().where("cluster_label <> 0") for f in models]
    names = {(r["split"], r["label"]): r["name"] for r in alignment.aligned_names(table).collect()}
    out = alignment.rename_labels(models, data)
    for split, (old, new) in enumerate(zip(data, out, strict=True)):
        assert sorted((r["cluster_label"], r["count"]) for r in new.collect()) == sorted((names[split, r["cluster_label"]], r["count"]) for r in old.collect())
    assert len(set(names.values())) < len(names)  # names are shared over splits
    with pytest.raises(ValueError):
        alignment.rename_labels(models, data[:2])
