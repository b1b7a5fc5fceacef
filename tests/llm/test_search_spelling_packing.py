"""Spelling variants, ranked search and packing against brute force."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from isopleth.llm import bpe, lexical, packing, spelling
from isopleth.llm.registry import QUERIES

# spelling


def lower(x):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)


def words_of(rows):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_pairs(rows):
    n = words_of(rows)
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, found in near.items():
        top = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = top if top is not None and n[top] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def found_variants(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("word", F.lit("x")).repartition(3)
    return collections.Counter((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(docs, **more).collect())


@pytest.mark.parametrize("block", [256, 6])
def test_variants_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    rng = np.random.default_rng(block)
    letters = list("aabcéÿß")
    base = ["".join(rng.choice(letters, rng.integers(5, 13))) for _ in range(60)] + ["prefix" + "".join(rng.choice(letters, 4)) for _ in range(40)] + ["".join(rng.choice(letters, 4)) + "suffix" for _ in range(40)]
    words = []
    for w in base:
        words += [w] * int(rng.integers(3, 40))
        for _ in range(4):
            i, kind = int(rng.integers(0, len(w) + 1)), rng.integers(0, 3)
            other = w[:i] + w[i + 1 :] if kind == 0 else w[:i] + str(rng.choice(letters)) + w[i + (kind == 1) :]
            words += [other] * int(rng.integers(2, 9))
    rng.shuffle(words)
    rows = [(int(i), " ".join(words[i * 40 : i * 40 + 40]).replace("a", "A", 3)) for i in range(-(-len(words) // 40))]
    want = variants_by_pairs(rows)
    got = found_variants(spark, rows)
    assert len(want) > 150 and sum(1 for x in want if x[2] != x[0] and x[2] != x[1]) > 0
    assert set(got) == want and max(got.values()) == 1


def test_variants_of_odd_tables(spark):
    long_ = "q" * 3000
    rows = [(1, None), (2, ""), (None, "other other other"), (3, "Straße STRASSE straße straße"), (3, "other-otherx otherx OTHERX"), (4, f"{long_} {long_} {long_}q {long_}q {long_}q {long_}"), (5, "caf́e Ābcdef x×y÷z aaaaa aaaaa aaaaa")]
    rows += [(6, "same word again " * 4)] * 3
    got = found_variants(spark, rows)
    assert set(got) == variants_by_pairs(rows) and max(got.values()) == 1
    assert (long_, None, long_, 3, 1, None) in got
    assert not found_variants(spark, rows[:2]) and not found_variants(spark, [(1, "a b c")])


def test_blocks_hold_every_pair_once():
    words = sorted({"".join(w) for w in np.random.default_rng(3).choice(list("ab"), (60, 7))})
    seen = collections.Counter()

    def down(some, m, p, s, cap):
        half = (m - p - s) // 2
        if half and len(some) > 4:
            for p2, s2, cap2 in ((p + half, s, cap), (p, s + half, min(cap, p + half))):
                groups = collections.defaultdict(list)
                for w in some:
                    groups[w[:p2], w[len(w) - s2 :]].append(w)
                for own in groups.values():
                    down(own, m, p2, s2, cap2)
        else:
            for i, count, _ in spelling.scan(some, np.ones(len(some), int), m, p, s, cap):
                seen[some[i]] += count

    down(words, 7, 0, 0, 8)
    assert seen == {w: n for w in words if (n := sum(one_edit(w, v) for v in words))}


# search


def ranked(docs, items, k=10):
    terms = lambda t: [lower(x) for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    counts = [(i, collections.Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    total, size = sum(sum(c.values()) for _, c in counts), len(counts)
    df = collections.Counter(w for _, c in counts for w in c)
    out = []
    wanted = collections.defaultdict(set)
    for item, text in items:
        wanted[item] |= set(terms(text))
    for item, own in wanted.items():
        scores = []
        for i, c in counts:
            m = 10 + 90 * sum(c.values()) * size // total
            scores.append((-sum(math.floor(1000 * math.log((2 * size + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in own if c[w]), i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(x for x in scores if x[0] < 0)[:k], 1)]
    return sorted(out, key=str)


def searched(spark, docs, items, k=10):
    docs = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit(1)).repartition(4)
    items = spark.createDataFrame(items, "item_id string, text string").withColumn("item", F.lit(1))
    shards, _ = lexical.index(docs)
    return sorted([tuple(r) for r in lexical.search(shards, items, k).collect()], key=str)


@pytest.mark.parametrize("shard, block", [(8192, 1 << 19), (7, 20)])
def test_search_against_all_documents(spark, monkeypatch, shard, block):
    monkeypatch.setattr(lexical, "SHARD_DOCS", shard)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", block)
    rng = np.random.default_rng(shard)
    words = [f"w{i}" for i in range(50)] + ["Été", "Naïve", "x1", "你好"]
    text = lambda n: "".join(rng.choice(words) + str(rng.choice([" ", "-", "_", "\n"])) for _ in range(n))
    docs = [(int(i), text(int(rng.integers(1, 60)))) for i in range(120)]
    docs += [(200 + i, docs[5][1]) for i in range(15)]  # ties of the last place
    items = [(f"i{j}", text(int(rng.integers(1, 12)))) for j in range(15)] + [("i0", "w1 w2"), ("none", "absent"), ("copy", docs[5][1])]
    got = searched(spark, docs, items)
    assert got == ranked(docs, items)
    assert searched(spark, docs, items, 3) == ranked(docs, items, 3)


def test_search_of_odd_tables(spark):
    long_ = "word other " * 40_000
    docs = [(1, None), (2, ""), (3, "..."), (None, "word Word"), (4, "word word"), (5, long_), (5, "word"), (5, "word")]
    items = [("a", "WORD"), (None, "other"), ("b", None), ("c", "")]
    assert searched(spark, docs, items) == ranked(docs, items)
    assert searched(spark, docs[:3], items) == [] and searched(spark, docs, items[2:]) == [] and searched(spark, [], items) == []


def test_impacts_beyond_64_bits():
    sizes = np.array([10, 10**9])
    got = lexical.impacts(np.array([1, 3]), sizes, 10**11, 10**13)
    assert got.tolist() == [10**9 * c // (1000 * c + 8 * (10 + 90 * int(s) * 10**11 // 10**13)) for c, s in zip((1, 3), sizes, strict=True)]


# packing


def check_plan(histogram, size):
    forms = packing.plan(histogram, size)
    used = np.zeros(size + 1, int)
    for runs, repeats in forms:
        assert 0 < sum(x * times for x, times in runs) <= size and repeats > 0
        for x, times in runs:
            used[x] += repeats * times
    assert (used == histogram).all()
    return sum(repeats for _, repeats in forms)


@pytest.mark.parametrize("size", [64, 2048])
def test_plans_use_every_piece(size):
    rng = np.random.default_rng(size)
    for draw in (rng.integers(1, size + 1, 500), np.clip(np.exp(rng.normal(math.log(size / 6), 1, 20_000)).astype(int), 1, size), np.full(77, 1), np.full(9, size), rng.integers(size // 3, size // 2, 999), np.array([], int)):
        histogram = np.bincount(draw, minlength=size + 1)
        n, least = check_plan(histogram, size), -(-draw.sum() // size)
        assert n >= least
    draw = np.clip(np.exp(rng.normal(math.log(size / 6), 1, 100_000)).astype(int), 1, size)
    histogram = np.bincount(draw, minlength=size + 1)
    assert check_plan(histogram, size) <= 1.001 * draw.sum() / size + 1


def test_fit_of_patterns_that_fill():
    # 100 sequences of 40 + 24, and 50 of 20 + 20 + 24 are found again
    histogram = np.bincount([40] * 100 + [24] * 150 + [20] * 100, minlength=65)
    found = packing.patterns(np.flatnonzero(histogram), 64)
    assert sorted(map(tuple, found.tolist())) == [(24, 20, 20), (40, 24, 0)]
    assert np.allclose(sorted(packing.fit(histogram, found)), [50, 100], atol=1e-3)
    assert check_plan(histogram, 64) == 150


def pack_rows(spark, rows, size=packing.SEQUENCE):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("piece", F.lit(5)).repartition(3)
    return packing.packed(docs, size=size)


def check_packing(rows, got, size, path=None):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.tokenizer_path(path))
    wanted = collections.Counter()
    for doc_id, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for piece, start in enumerate(range(0, len(ids), size)):
            wanted[doc_id, piece, start, len(ids[start : start + size]), ids[start : start + size].tobytes()] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in got) == wanted
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    return len(sequences)


@pytest.mark.parametrize("size", [2048, 32])
def test_packing_against_the_library(spark, size):
    rng = np.random.default_rng(size)
    rows = [(i, " ".join(rng.choice(["alpha", "Beta,", "über", "x.y", "12"], int(rng.integers(0, 90))))) for i in range(300)]
    rows += [(None, None), (7, ""), (8, "long word " * 5000), (8, "long word " * 5000), *[(900, "same text here")] * 60]
    packed = pack_rows(spark, rows, size).cache()
    n = check_packing(rows, packed.collect(), size)
    whole = packing.sequences(packed, size).collect()
    assert len(whole) == n and all(len(r.ids) == 4 * sum(r.lengths) and len(r.doc_ids) == len(r.lengths) for r in whole)
    by_place = {(r.sequence_id, r.offset): bytes(r.ids) for r in packed.collect()}
    for r in whole[:50]:
        starts = np.concatenate([[0], np.cumsum(r.lengths)[:-1]])
        assert bytes(r.ids) == b"".join(by_place[r.sequence_id, int(s)] for s in starts)


def test_packing_of_an_empty_table(spark):
    assert pack_rows(spark, []).isEmpty()


def test_packing_query_is_tight(spark, small):
    rows = QUERIES["op13_packing"](spark, small).agg(F.sum("length").alias("n"), F.countDistinct("sequence_id").alias("s"), F.countDistinct("doc_id").alias("d")).first()
    assert rows.d == 200 and rows.s <= 1.03 * rows.n / 2048 + 1
