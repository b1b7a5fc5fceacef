"""Operators on tables: scores, joins, mixing, neighbours, conversations, the pipeline."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from isopleth.llm import ann, bpe, chat, fm, mixing, neardup, rules, scorers
from isopleth.llm.registry import ORACLE_SQL, QUERIES


# factorisation machine


def test_machine_learns_a_pair():
    rng = np.random.default_rng(0)
    rows = [sorted(rng.choice(12, 4, replace=False)) for _ in range(2000)]
    label = np.array([float(0 in r and 1 in r) for r in rows])
    ptr = np.arange(0, 8001, 4)
    index = np.concatenate(rows)
    machine = fm.fit(index, np.ones(8000), ptr, label, 12, epochs=30, rate=0.2)
    assert ((machine.scores(index, np.ones(8000), ptr) >= 0.5) == label).mean() > 0.97
    # the identity against all pairs
    x = np.zeros(12)
    x[rows[0]] = 1
    pairs = sum(machine.factors[i] @ machine.factors[j] * x[i] * x[j] for i in range(12) for j in range(i))
    assert machine.logits(index[:4], np.ones(4), np.array([0, 4]))[0] == pytest.approx(machine.bias + machine.linear @ x + pairs)
    assert len(machine.scores(np.zeros(0, int), np.zeros(0), np.array([0, 0]))) == 1


def held_out(spark, sf_dir, name, label, modulus, rest):
    rows = {r["doc_id"]: r for r in QUERIES[name](spark, sf_dir).collect()}
    labels = duckdb.sql(f"SELECT doc_id, {label} FROM '{sf_dir}/labels.parquet'").fetchall()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % modulus == rest) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for i, r in rows.items())
    return [(y, rows[i]["predicted"]) for i, y in labels if rows[i]["held_out"]], len(rows)


def test_scores_on_held_out_labels(spark):
    sf_dir = "/root/testdata/sf0.01"
    found, n = held_out(spark, sf_dir, "op1_quality", "quality", 3, 1)
    assert n == 1000 and np.mean([y == p for y, p in found]) > 0.95
    found, n = held_out(spark, sf_dir, "op5_toxicity", "toxic", 5, 0)
    assert np.mean([y == p for y, p in found]) > 0.9 and not any(p for y, p in found if not y)


@pytest.mark.parametrize("scorer, label", [(scorers.quality, "quality"), (scorers.toxicity, "toxic")])
def test_scores_of_odd_tables(spark, scorer, label):
    docs = spark.createDataFrame([(1, None, 5), (1, "", 0), (None, "text " * 50_000, None), (4, "a b", 3)], "doc_id long, text string, n_chars long").repartition(2)
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 1), (9, 0)], f"doc_id long, {label} int")
    assert scorer(docs, labels).where("score between 0 and 1").count() == 4
    assert scorer(docs, labels.where("false")).count() == 4
    assert scorer(docs.where("false"), labels).count() == 0


# n-gram join


def brute(rows, k, percent):
    sets = {}
    for i, x in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (x or "").encode().lower())
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    shared = collections.Counter()
    by = collections.defaultdict(list)
    for i in sorted(sets):
        for s in sets[i]:
            for j in by[s]:
                shared[j, i] += 1
            by[s].append(i)
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def copies(seed=0):
    """Chains and stars of near copies, a passage in many texts, exact copies, short and empty texts."""
    rng = np.random.default_rng(seed)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    out, passage = [], word(40)
    for size in (6, 9, 30, 120, 700):
        for _ in range(2):
            text = word(size)
            for _ in range(12):
                out.append(" ".join(text))
                text = list(text)
                for _ in range(max(1, size // 60)):
                    text[rng.integers(0, size)] = f"x{rng.integers(0, 10**9)}"
    out += [" ".join([*word(rng.integers(5, 60)), *passage, *word(rng.integers(5, 60))]) for _ in range(80)]
    out += ["One Two", "one  TWO\n", "one", "", " \t", None, "a b c d", "A B C D", " ".join(word(30_000))]
    out += [out[3]] * 25
    return list(enumerate(out, 1))


@pytest.mark.parametrize("k, percent", [(4, 85), (2, 55)])
def test_join_against_all_pairs(spark, k, percent):
    rows = copies()
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n long").repartition(6)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs, k, percent).collect()}
    assert got == brute(rows, k, percent)


def test_join_of_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    rows = neardup.near_duplicates(docs).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in rows) == [(0, 0), (1, 1), (1, 1), (2, 1)]
    assert neardup.near_duplicates(docs.where("false")).count() == 0


def test_routing_loses_no_link():
    rng = np.random.default_rng(1)
    for percent in (85, 80, 55):
        for n in (3, 5, 6, 7, 8, 12, 20, 33, 34, 50, 77, 113, 300, 900):
            for _ in range(12):
                a = rng.choice(1 << 62, n, replace=False).astype(np.uint64)
                out = int(rng.integers(0, neardup.most_different(n, percent) + 1))
                keep = rng.permutation(n)[out:]
                more = int(rng.integers(0, neardup.most_different(n, percent) + 1 - out))
                b = np.concatenate([a[keep], rng.choice(1 << 62, more, replace=False).astype(np.uint64)])
                both = len(keep)
                if 100 * both >= percent * (len(a) + len(b) - both) and out + more:
                    assert set(neardup.routing_keys(np.sort(a), percent)) & set(neardup.routing_keys(np.sort(b), percent))


def near_sets(rng, groups, count, longest=200):
    base = [rng.integers(0, 1 << 62, rng.integers(5, longest)) for _ in range(groups)]
    sets = []
    for i in range(count):
        x = base[i % groups].copy()
        x[rng.permutation(len(x))[: rng.integers(0, 1 + len(x) // 4)]] = rng.integers(0, 1 << 62)
        sets.append(np.unique(x).astype(np.uint64))
    return sets


def connected(pairs, component):
    """Members to the smallest member that pairs or equal components connect them with."""
    parent = list(range(len(component)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in [*pairs, *((i, int(np.flatnonzero(component == c)[0])) for i, c in enumerate(component))]:
        x, y = root(i), root(j)
        parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(component))]


@pytest.mark.parametrize("bits, piece", [(8192, None), (8192, 16), (64, 16), (256, None)])
def test_tree_finds_all_components(bits, piece):
    rng = np.random.default_rng(4)
    sets = near_sets(rng, 12, 300)
    pairs = [(i, j) for i in range(300) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
    for component, side in [(np.arange(300), np.full(300, -1)), (np.arange(300) // 2, np.full(300, -1)), (np.arange(300), np.arange(300) // 12 % 2)]:
        links = neardup.Tree(sets, component, side, bits).links(80, piece)
        wanted = [(i, j) for i, j in pairs if side[i] < 0 or side[i] != side[j]]
        assert wanted and set(links) <= {*wanted, *((j, i) for i, j in wanted)}
        assert len(links) < 300 and connected(links, component) == connected(wanted, component)


def test_tree_prunes_nodes():
    """Most pairs of leaves are never met, and a passage that all sets share doesn't change that."""
    rng = np.random.default_rng(5)
    passage = rng.integers(0, 1 << 62, 40)
    sets = [np.unique(np.concatenate([x, passage.astype(np.uint64)])) for x in near_sets(rng, 200, 2000)]
    tree = neardup.Tree(sets, np.arange(2000), np.full(2000, -1))
    links = tree.links(85)
    assert len(links) > 100 and tree.compared < 2000 * 1999 / 2 / 10


def test_links_come_from_the_trees(spark, monkeypatch):
    rows = copies(6)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found, stars, members = neardup.families(docs, 4, 85)
    family = {r["doc_id"]: r["family"] for r in members.collect()}
    wanted = brute(rows, 4, 85)
    by_class = {}
    for r in found.where("n > 0").collect():
        by_class.setdefault(r["class"], []).append(r["doc_id"])
    linked = {i for i, (_, c) in wanted.items() if c in family and i in family}
    for i in linked:  # whatever links is in one family ...
        if texts[i] and wanted[i][1] != i:
            assert family[i] == family[wanted[i][1]]
    unlinked = [(i, j) for i in family for j in family if i < j and family[i] == family[j] and wanted[i][1] != wanted[j][1]]
    assert unlinked  # ... but not the other way round
    monkeypatch.setattr(neardup, "tree_links", lambda *args: spark.createDataFrame([], "a long, b long"))
    alone = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, 4, 85).collect()}
    assert all(alone[i] == min(x for own in by_class.values() if i in own for x in own) for i in family)


def trees_alone(sets, percent):
    return neardup.Tree(sets, np.arange(len(sets)), np.full(len(sets), -1)).links(percent)


def test_odd_trees():
    none = np.zeros(0, np.uint64)
    assert trees_alone([none], 80) == [] and trees_alone([none, none], 80) == []
    assert trees_alone([np.array([1], np.uint64), np.array([2], np.uint64)], 80) == []
    assert trees_alone([np.array([7], np.uint64)] * 3, 80) == [(0, 1), (0, 2)] or len(trees_alone([np.array([7], np.uint64)] * 3, 80)) == 2


@pytest.mark.parametrize("tile, landmarks", [(3, 1), (12, 4)])
def test_large_families(spark, monkeypatch, tile, landmarks):
    rows = copies(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(neardup, "TILE", tile)
    monkeypatch.setattr(neardup, "LANDMARKS", landmarks)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, 3, 70).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 3, 70).items()}


def test_rows_that_share_an_id(spark):
    one, other = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    docs = spark.createDataFrame([(5, one), (5, other), (5, other), (7, one), (3, other + " end"), (9, None), (9, "c")], "doc_id long, text string")
    rows = sorted((r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(docs, 4, 85).collect())
    assert rows == [(3, 3), (5, 3), (5, 3), (5, 5), (7, 5), (9, 9), (9, 9)]


# mixing


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == pytest.approx([187.5, 75, 37.5])
    # the first source is at its limit, the excess goes to the others
    assert mixing.targets([10, 500, 490], [5, 2, 1]) == pytest.approx([30, 970 * 2 / 3, 970 / 3])
    assert mixing.targets([], []) == [] and mixing.targets([0, 0], [5, 2]) == [0, 0]


def test_flight_keeps_totals():
    rng = np.random.default_rng(0)
    size, chance = rng.integers(1, 1000, 400).astype(float), np.full(400, 0.37)
    out = mixing.flight(size, chance, rng.random(400))
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert out.sum() == pytest.approx(chance.sum()) and (out * size).sum() == pytest.approx((chance * size).sum(), rel=1e-6)
    mean = np.mean([mixing.flight(size, chance, np.random.default_rng(s).random(400)) for s in range(300)], axis=0)
    assert abs(mean.mean() - 0.37) < 0.01 and np.abs(mean - 0.37).max() < 0.2


@pytest.mark.parametrize("block", [4096, 40])
def test_mixing(spark, small, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK", block)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    frame = mixing.mixed(docs).toPandas()
    assert len(frame) == 1000
    again = mixing.mixed(docs.repartition(7)).toPandas()
    assert frame.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))
    source = docs.select("doc_id", "source", "text").toPandas()
    source["words"] = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in source["text"]]
    both = frame.merge(source)
    assert (both["size"] == both["words"]).all() and (both["taken"] <= 3 * both["size"]).all() and (both["taken"] % both["size"].clip(lower=1) == 0).all()
    per = both.groupby("source").agg(size=("size", "sum"), given=("source_size", "first"), target=("target", "first"), taken=("taken", "sum")).sort_index()
    assert (per["size"] == per["given"]).all()
    sizes, weights = per["size"].to_numpy(float), np.array([(5, 2, 1)[i % 3] for i in range(len(per))], float)
    low, high = 0.0, 1e12  # words for a weight of 1: targets are min(3 size, weight times that), and their sum is all words
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if np.minimum(3 * sizes, weights * middle).sum() < sizes.sum() else (low, middle)
    assert per["target"].tolist() == pytest.approx(np.minimum(3 * sizes, weights * low).tolist())
    assert (np.abs(per["taken"] - per["target"]) <= 0.002 * per["target"] + 5).all()


def test_mixing_of_odd_tables(spark):
    rows = [(1, None, "b"), (2, "", "b"), (3, "one two three", None), (3, "one two three", None), (None, "x y", "a"), (5, "z " * 1000, "a")]
    frame = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    assert len(frame) == 6 and (frame["taken"] <= 3 * frame["size"]).all()
    assert frame[frame["size"] == 0]["taken"].tolist() == [0, 0]
    assert mixing.mixed(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_mixing_of_a_hot_row_and_many_sources(spark):
    rows = [(7, "one two three four", "hot")] * 3000 + [(i, "word " * (i % 13 + 1), f"host{i % 400:03d}") for i in range(4000)]
    frame = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)).toPandas()
    assert len(frame) == 7000
    hot = frame[frame["source_size"] == 12000]
    assert len(hot) == 3000 and hot["times"].max() - hot["times"].min() <= 1 and abs(hot["taken"].sum() - hot["target"].iloc[0]) <= 8
    per = frame.groupby("place").agg(size=("size", "sum"), given=("source_size", "first"), target=("target", "first"), taken=("taken", "sum")).sort_index()
    assert len(per) == 401 and (per["size"] == per["given"]).all()
    order = sorted({r[2] for r in rows})
    sizes = [sum(len(r[1].split()) for r in rows if r[2] == x) for x in order]
    assert per["target"].tolist() == pytest.approx(mixing.targets(sizes, [(5, 2, 1)[i % 3] for i in range(401)]))
    assert (np.abs(per["taken"] - per["target"]) <= 20).all()


def test_landing_keeps_the_chances():
    rng = np.random.default_rng(0)
    size, chance = rng.integers(1, 2000, 26).astype(float), rng.random(26)
    out = np.array([mixing.landing(size, chance, s) for s in range(400)])
    assert np.abs((out * size).sum(1) - (chance * size).sum()).max() < 100
    assert np.abs(out.mean(0) - chance).max() < 0.15


@pytest.mark.parametrize("long, its", [(0, 0.5), (30_000, 0.03), (30_000, 0.9)])
def test_landing_design_keeps_every_chance(long, its):
    """Also where one document is longer than all others, which no sample outweighs."""
    rng = np.random.default_rng(3)
    size, chance = rng.integers(1, 900, 24).astype(float), rng.random(24)
    size[5], chance[5], chance[6], chance[7] = long or size[5], its, 0.0, 1.0
    samples = mixing.nested(chance)
    cost = np.abs(samples @ size - (size * chance).sum())
    more = rng.random((500, 24)) < chance
    every = np.concatenate([samples, more])
    base, share = mixing.design(every, np.concatenate([cost, np.abs(more @ size - (size * chance).sum())]), chance)
    assert share @ every[base] == pytest.approx(chance, abs=1e-9)
    out = np.array([mixing.landing(size, chance, s) for s in range(100)])
    assert set(np.unique(out)) <= {0.0, 1.0} and (out[:, 6] == 0).all() and (out[:, 7] == 1).all()
    assert (np.abs(out.mean(0) - chance) < 4.5 * np.sqrt(chance * (1 - chance) / 100) + 1e-9).all()
    error = np.abs(out @ size - (size * chance).sum())
    assert error.max() < 50 if not long else np.median(error) < 0.5 * long


def test_landing_of_ties_and_one_document():
    for n in (1, 2, 9):
        out = np.array([mixing.landing(np.full(n, 7.0), np.full(n, 0.3), s) for s in range(150)])
        assert np.abs(out.mean(0) - 0.3).max() < 0.17 and np.abs(out.sum(1) - 0.3 * n).max() < 1


@pytest.mark.parametrize("each, least, high", [(0.004, -1, 1), (0.996, 0, 2)])
def test_landing_of_few_words(each, least, high):
    """Fewer words to take, or to leave, than any document has: documents are left out, or taken twice, for others; means are the chances."""
    rng = np.random.default_rng(1)
    size, chance = rng.integers(100, 900, 40).astype(float), np.full(40, each)
    out = np.array([mixing.landing(size, chance, s, least, high) for s in range(40)])
    assert set(np.unique(out)) == set(range(least, high + 1))
    plain = np.array([mixing.landing(size, chance, s) for s in range(40)])
    error, before = (np.abs(x @ size - (size * chance).sum()).mean() for x in (out, plain))
    assert error < size.min() and error < 0.75 * before
    assert abs(out.mean() - each) < 0.03


def test_mixed_rows_that_share_an_id(spark):
    from isopleth.llm import stages

    rows = [(1, "a " * 50, "x"), (1, "b " * 70, "x"), (1, "b " * 70, "y"), (2, "c " * 30, "y"), (2, "c " * 30, "y"), (None, "d " * 40, None), (None, "e " * 10, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as _id", "2 as _times", "3 as _print")
    taken = collections.Counter()
    for r in mixing.mixed(docs).collect():
        taken[r["doc_id"], r["size"], r["place"]] += r["times"]
    got = collections.Counter()
    for r in stages.mix(spark, docs, None).collect():
        got[r["doc_id"], len(r["text"].split()), {"x": 0, "y": 1, None: 2}[r["source"]]] += 1
    assert got == +taken


# neighbours


def vectors(n=1500, seed=0, groups=20):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, 32)) * 2
    return (centre[rng.integers(0, groups, n)] + rng.normal(size=(n, 32))).astype(np.float32)


def exact(ids, x, k=5):
    x = x.astype(float)
    norm = np.sqrt((x * x).sum(1))
    out = {}
    for i in np.flatnonzero(ids % 50 == 0):
        s = x @ x[i] / (norm * norm[i])
        order = [j for j in np.lexsort((ids, -np.round(s, 12))) if ids[j] != ids[i]]
        out[ids[i]] = [(ids[j], s[j]) for j in order[:k]]
    return out


@pytest.mark.parametrize("groups", [20, 1])
def test_recall(spark, groups):
    x, ids = vectors(groups=groups), np.arange(1500)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>").repartition(4)
    got = collections.defaultdict(list)
    for r in sorted(ann.neighbours(df).collect()):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    want = exact(ids, x)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert np.mean([len({a for a, _ in got[q]} & {a for a, _ in w}) / 5 for q, w in want.items()]) >= 0.9
    for q, w in got.items():
        for v, s in w:
            a, b = x[q].astype(float), x[v].astype(float)
            assert s == pytest.approx(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)), abs=1e-12)
        assert [s for _, s in w] == sorted((s for _, s in w), reverse=True)


def test_neighbours_of_odd_tables(spark):
    one = [1.0] * 8
    rows = [(i, one) for i in range(0, 120)] + [(200, None), (250, [0.0] * 8), (300, [1.0, None] * 4), (350, [float("nan")] * 8), (400, [float("inf")] * 8), (450, [1.0, 2.0]), (None, one), (500, [-1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = collections.defaultdict(list)
    for r in sorted(ann.neighbours(df).collect()):
        got[r["query_id"]].append(r["vec_id"])
    assert set(got) == {0, 50, 100, 500}
    assert got[0] == [1, 2, 3, 4, 5] and got[50] == [0, 1, 2, 3, 4] and got[100] == [0, 1, 2, 3, 4] and got[500] == [0, 1, 2, 3, 4]
    few = ann.neighbours(df.where("vec_id in (0, 7)")).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in few] == [(0, 1, 7)]
    assert ann.neighbours(df.where("false")).count() == 0


def test_a_hot_vector_over_many_batches(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(40, 64)) * 2
    x = np.concatenate([(centre[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 64))), np.repeat(centre[:1] + 0.1, 2000, 0)]).astype(np.float32)
    ids = rng.permutation(5000)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>").repartition(16)
    got = collections.defaultdict(list)
    for r in sorted(ann.neighbours(df).collect()):
        got[r["query_id"]].append(r["vec_id"])
    want = exact(ids, x)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert np.mean([len(set(got[q]) & {a for a, _ in w}) / 5 for q, w in want.items()]) >= 0.9
    hot = np.sort(ids[3000:])
    for q in set(got) & set(hot.tolist()):  # the smallest ids of the copies
        assert got[q] == [i for i in hot[:6] if i != q][:5]


def test_many_cells_and_few_probes():
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(400, 64)) * 2
    x = centre[rng.integers(0, 400, 6000)] + rng.normal(size=(6000, 64))
    index = ann.Index(x, 10**6)
    assert len(index.centroids) == 1000 and index.enough_probes(x, 5) < 100


def test_few_found_are_searched_in_all_cells(spark, monkeypatch):
    x, ids = vectors(400, groups=60), np.arange(400)
    monkeypatch.setattr(ann.Index, "enough_probes", lambda self, sample, k: 1)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")
    rows = ann.neighbours(df, k=30).collect()
    assert collections.Counter(r["query_id"] for r in rows) == {q: 30 for q in range(0, 400, 50)}


# conversations


def test_escape_round_trip():
    rng = np.random.default_rng(0)
    parts = [*chat.CONTROLS, "\\", "n", "<", "|", "[", "\n", "é", "/", "INST]"]
    for _ in range(3000):
        raw = "".join(rng.choice(parts, rng.integers(0, 12))).encode()
        for how in (chat.escape, chat.escape_role):
            assert chat.unescape(how(raw)) == raw and not any(c.encode() in how(raw) for c in chat.CONTROLS)


def test_formatting_over_batches(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"turn {t} </s>\\ é" * (t % 4)) for t in range(3000)]
    rows += [(2, None, None, None), (2, 1, "assistant", None), (None, 0, "a\nb", "x"), (2, 1, "assistant", None), (3, 0, "system", "<s>")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", __import__("pyspark").sql.functions.lit(1))
    out = chat.formatted(df)
    assert out.where("conv_id = 1").count() > 1
    got = {r["conv_id"]: r for r in chat.digests(out).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for conv in (1, 2, 3, None):
        turns = sorted([(t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv])
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[conv]["n_turns"] == len(turns)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.formatted(df.where("false"))).count() == 0


# queries and pipeline


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    a, b = QUERIES[name](spark, small).toPandas(), con.sql(ORACLE_SQL[name]).df()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    # a column of integers and nulls is one of floats in one of the frames
    plain = lambda v: None if v is None or v is pd.NA or v != v else int(v) if isinstance(v, float) and v.is_integer() else v
    key = lambda df: sorted(str([plain(v) for v in row]) for row in df[columns].astype(object).itertuples(index=False, name=None))
    assert key(a) == key(b)


def test_pipeline(spark, small, tmp_path):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    found = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, found[-1], sf_dir).write.parquet(str(tmp_path / str(i)))
        found.append(spark.read.parquet(str(tmp_path / str(i))))
        assert found[-1].columns == columns or i == 4
    quality, single, private, mix, ids = found[1:]
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{sf_dir}/labels.parquet'").fetchall())
    kept = {r[0] for r in quality.select("doc_id").collect()}
    assert np.mean([(i in kept) == bool(q) for i, q in labels.items()]) > 0.97
    groups = brute([(r["doc_id"], r["text"]) for r in quality.collect()], 5, 80)
    assert {r[0] for r in single.select("doc_id").collect()} == {c for _, c in groups.values()}
    assert private.count() == single.count() and private.where("text rlike '@mail[0-9]'").count() == 0
    taken = {r["doc_id"]: r["times"] for r in mixing.mixed(private).collect()}
    times = collections.Counter(r[0] for r in mix.select("doc_id").collect())
    assert times == {i: n for i, n in taken.items() if n}
    assert ids.count() == mix.count() and ids.where("n_tokens <> size(ids)").count() == 0
    wanted = {tuple(r) for r in bpe.round_trip(mix).select("doc_id", "n_tokens", "decoded_sha256").collect()}
    assert {tuple(r) for r in ids.select("doc_id", "n_tokens", "decoded_sha256").collect()} == wanted
    assert corpus_pipeline.run(spark, sf_dir).count() == ids.count()


def test_stages_of_odd_tables(spark):
    from isopleth.llm import stages

    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "word " * 9000, "en", None, 45000), (3, "mail a@b.org now", "en", "s", 16)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("_times", __import__("pyspark").sql.functions.lit("x"))
    for stage in (stages.near_duplicates, stages.private, stages.mix):
        out = stage(spark, docs, None)
        assert out.columns == docs.columns and out.count() <= 3 * docs.count()
        assert stage(spark, docs.where("false"), None).count() == 0
    assert stages.encode(spark, docs, None).count() == 5


def test_rule_table():
    assert all(" / " in r.value and (r.low is not None or r.high is not None) for r in rules.RULES)


def test_duplicates_are_decided_by_id_and_text(spark):
    from isopleth.llm import stages

    one, other = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(5, one), (5, other), (5, other), (7, one), (3, other + " end"), (9, None), (9, ""), (9, ""), (None, one), (8, "c"), (8, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as _id", "2 as _PRINT", "3 as _text", "4 as component")
    kept = collections.Counter((r["doc_id"], r["text"]) for r in stages.near_duplicates(spark, docs, None).collect())
    assert kept == collections.Counter([(5, one), (3, other + " end"), (9, None), (9, ""), (None, one), (8, "c"), (8, "d")])


@pytest.mark.parametrize("which", ["quality", "toxic"])
def test_scores_against_all_pairs_of_features(spark, small, which):
    """The plain definition: every pair of a text's features, one by one, without the identity."""
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    features, lower = (scorers.quality_features, False) if which == "quality" else (scorers.toxic_features, True)
    model = scorers.train_quality(docs, labels) if which == "quality" else scorers.train(docs, labels, "toxic", 5, 0, features, True)
    machine, weight = model
    got = dict(scorers.score(docs, model, features, lower).collect())
    some = sorted(docs.select("doc_id", "text", "n_chars").collect(), key=lambda r: len(r["text"] or ""))[:40]
    for r in some:
        data = (r["text"] or "").lower().encode() if lower else (r["text"] or "").encode()
        index, _ = features(np.frombuffer(data, np.uint8), np.array([0, len(data)]), np.array([float(r["n_chars"] or 0)]))
        used = [(i, weight[i]) for i in index if weight[i]]
        logit = machine.bias + sum(machine.linear[i] * x for i, x in used)
        for a, (i, x) in enumerate(used):
            for j, y in used[:a]:
                logit += float(machine.factors[i] @ machine.factors[j]) * x * y
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + np.exp(-np.clip(logit, -60, 60))), abs=1e-9)
    assert (weight > 0).sum() > 5 and np.abs(machine.factors).max() > 0


def test_repeated_labelled_documents_and_clashing_columns(spark):
    """A labelled id with a third of all rows trains once; columns named as the operator's own change nothing."""
    rng = np.random.default_rng(0)
    texts = [" ".join([*(f"w{x}" for x in rng.integers(0, 50, 30)), *(["bad", "worse"] if i % 2 else ["good", "fine"])]) for i in range(240)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(240)], "doc_id long, quality int, toxic int")
    plain = {r["doc_id"]: r["score"] for r in scorers.toxicity(docs, labels).collect()}
    odd = docs.union(docs.where("doc_id = 3").crossJoin(spark.range(120)).drop("id")).selectExpr("*", "1 as label", "'x' as meta", "2 as x", "3 as score")
    rows = scorers.toxicity(odd, labels.selectExpr("*", "'y' as text", "'z' as meta")).collect()
    assert len(rows) == 360 and max(abs(plain[r["doc_id"]] - r["score"]) for r in rows) < 1e-9
    assert np.mean([(plain[i] >= 0.5) == i % 2 for i in plain]) > 0.95
    assert scorers.training_rows(scorers._texts(odd, False), labels, "toxic", 5, 0).where("doc_id = 3").count() <= 1


def features_of(data, offs, meta):
    index, ptr = scorers.quality_features(data, offs, meta)
    return [sorted(index[a:b].tolist()) for a, b in zip(ptr[:-1], ptr[1:], strict=True)]


def test_features_of_a_text_do_not_depend_on_its_neighbours(small):
    """All texts of a table, alone, and after a text that ends with their own first word."""
    texts = [t or "" for (t,) in duckdb.sql(f"SELECT text FROM '{small}/documents.parquet' ORDER BY doc_id").fetchall()] + ["", "a a b", "a", ""]
    raw = [t.encode() for t in texts]
    pack = lambda some: (np.frombuffer(b"".join(some), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in some])]), np.zeros(len(some)))
    alone = [features_of(*pack([x]))[0] for x in raw]
    assert features_of(*pack(raw)) == alone and features_of(*pack(raw[::-1])) == alone[::-1]
    for x, own in zip(raw, alone, strict=True):
        words = x.split()
        assert features_of(*pack([b"begin " + (words[0] if words else b"a"), x]))[1] == own


def test_scores_do_not_depend_on_partitions(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    model = scorers.train_quality(docs, labels)
    by_id = [{r.doc_id: r.score for r in scorers.score(docs.repartition(n, F.xxhash64("doc_id", F.lit(n))), model, scorers.quality_features, False).collect()} for n in (1, 7)]
    assert by_id[0] == by_id[1]


def test_many_texts_of_one_id(spark):
    """Each text is read once, whatever the number of rows that share its id."""
    words = [f"w{i}" for i in range(400)]
    rng = np.random.default_rng(4)
    base = [list(rng.choice(words, 40)) for _ in range(150)]
    rows = [" ".join(t) for t in base] + [" ".join([*t[:-1], "end"]) for t in base]
    one = spark.createDataFrame([(7, t) for t in rows], "doc_id long, text string")
    rows, stars, members = neardup.families(one, 4, 85)
    assert one.withColumn("print", neardup.common.text_print()).join(members, ["doc_id", "print"]).count() == members.count() == 300
    found = neardup.grouped(one, k=4, percent=85)
    got = collections.Counter(r["component"] for r in found.collect())
    assert sorted(got.values()) == [2] * 150
    assert found.where("component_id <> 7").isEmpty()


@pytest.mark.parametrize("size", [1e-200, 1e200, 4e-323])
def test_tiny_and_huge_vectors(spark, size):
    """One row, and a tenth of all rows, of another size: recall stays, and scores are those of the vectors as they are."""
    x = vectors(800, seed=6, groups=10).astype(float)
    for some in (slice(3, 4), slice(0, None, 10)):
        y = x.copy()
        y[some] *= size
        assert np.abs(y).max(1).min() > 0
        rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "vec_id long, embedding array<double>").repartition(5)
        got = collections.defaultdict(dict)
        for r in ann.neighbours(rows, every=10).collect():
            got[r.query_id][r.vec_id] = r.score
        scaled = y / np.abs(y).max(1, keepdims=True)
        unit = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
        near = unit @ unit.T
        hits = 0
        for q in range(0, 800, 10):
            assert len(got[q]) == 5 and all(s == pytest.approx(near[q, i], abs=1e-12) for i, s in got[q].items())
            fifth = np.sort(np.delete(near[q], q))[-5]
            hits += sum(near[q, i] >= fifth - 1e-9 for i in got[q])
        assert hits >= 0.9 * 5 * 80


def test_queries_of_a_cell_in_parts(spark, monkeypatch):
    x = vectors(600, seed=7, groups=3)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    whole = sorted(map(tuple, ann.neighbours(rows, every=5).collect()))
    monkeypatch.setattr(ann, "QUERIES", 7)
    monkeypatch.setattr(ann, "BLOCK", 40)
    monkeypatch.setattr(ann, "RERANK", 40)
    parts = sorted(map(tuple, ann.neighbours(rows, every=5).collect()))
    assert len(parts) == len(whole) and np.mean([a[:3] == b[:3] for a, b in zip(whole, parts, strict=True)]) > 0.9


def other_rows(kind: str, n: int) -> np.ndarray:
    rng = np.random.default_rng(11)
    directions = lambda m: (x := rng.normal(size=(m, 64))) / np.linalg.norm(x, axis=1, keepdims=True)
    groups, noise = (30, 0.002) if kind == "tight groups" else (60, 0.01)
    x = directions(groups)[rng.integers(0, groups, n)] + noise * rng.normal(size=(n, 64))
    if kind == "queries elsewhere":
        x[::50] = directions(len(x[::50]))
    if kind == "half in groups":
        some = rng.random(n) < 0.5
        x[some] = directions(some.sum())
    return x


@pytest.mark.parametrize("kind", ["tight groups", "queries elsewhere", "half in groups"])
def test_recall_on_other_rows(spark, kind):
    """Groups within which all codes are equal, and queries whose neighbours lie otherwise than those of most rows."""
    x, ids = other_rows(kind, 6000), np.arange(6000)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = collections.defaultdict(set)
    for r in ann.neighbours(rows).collect():
        got[r["query_id"]].add(r["vec_id"])
    want = exact(ids, x)
    hits = np.array([len(got[q] & {a for a, _ in w}) for q, w in want.items()])
    assert hits.mean() / 5 >= 0.95


def test_a_block_misses_nothing():
    """Whatever the codes say: here books that were fitted on other vectors, which give most rows the same codes."""
    rng = np.random.default_rng(12)
    index = ann.Index(rng.normal(size=(500, 64)), 1)
    x = np.ones(64) + 0.01 * rng.normal(size=(3000, 64))
    cell, codes = index.assign(x)
    assert set(cell) == {0}
    block = pa.table({"cell": pa.array(cell, pa.int32()), "hash": ann._hashes(x), "ids": [[i] for i in range(3000)], "v": ann._lists(x), "codes": [c.tobytes() for c in codes]})
    found = ann._searching(index, 5)(block, pa.table({"hash": ann._hashes(x[:100]), "v": ann._lists(x[:100])})).to_pydict()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    place = {h: i for i, h in enumerate(ann._hashes(x[:100]).tolist())}
    got = collections.defaultdict(set)
    for h, v in zip(found["hash"], found["vec_id"], strict=True):
        got[place[h]].add(v)
    for i, near in enumerate(unit[:100] @ unit.T):
        assert got[i] == set(np.argsort(-near)[:6].tolist())
