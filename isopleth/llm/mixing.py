"""Operator 7: mixing sources to target weights by balanced sampling with the cube method.

Targets. Each source's target of words is its weight's share of all words, at most `most` times the source's own words;
the excess goes to the others by weight until none is above. A document of a source with target T and size S is taken
T / S times in expectation: floor(T / S) times for certain, and once more with the rest of that number as inclusion
probability.

Cube method. The vector of inclusion probabilities moves through the null space of the balancing constraints (number of
documents, number of words) until no more than two documents are undecided: with three undecided documents at hand there
is a direction that changes neither total, and a step along it decides at least one of them. Documents go in descending
order of size, so that what stays undecided at last is small. The flight runs within blocks of a source's documents;
what each block leaves, a few documents, goes through the next round of blocks, until a source has one block. There some
documents of all sizes wait while the others fly. The landing decides them and the last two: of `DRAWS` draws by their
inclusion probabilities it takes the one with the smallest error in words; if that is more than `TOLERANCE` words, as
where a very long document with a small chance is left over, it also looks at even draws, and gives up the chances of
these few documents for the target.

Repeated rows (equal in id, source and text) are one unit of the sample: of c such rows with a chance p each, the whole
part of c p is taken for certain, and the rest is one document's chance. A row with a third of all copies is so counted
within each input partition first, and is one row in its block.

Plan. Sources are numbered by a range partition and numbers within it, and targets are found by a few passes over the
table of sources, each of which gives one row to the driver; the number of sources has no bound.

Sizes are counts of words. Null and empty texts have size 0 and are never taken. The null source is a source, the last
one. All random numbers come from hashes of ids, so that reruns agree. Extra columns are ignored by the query. An empty
table gives an empty result; sources of size 0 have target 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .rules import WHITE

WEIGHTS = (5, 2, 1)
#: A target is at most so many times its source's size.
MOST = 3
#: Documents of a block.
BLOCK = 4096
#: Documents of a source's last block that wait for the landing, besides the two of the flight; other blocks leave half of that, and of their own at most.
LANDING = 64
#: Samples that the landing chooses from: draws by the chances, draws with each document in and out, and how often each draw is brought nearer.
DRAWS, HELD, NEARER = 256, 4, 3
#: Steps of the landing's linear programme for each document, at most; it may end at any step, with chances kept.
STEPS = 20
#: Sources up to which their table is broadcast; beyond, the joins are shuffles.
BROADCAST_SOURCES = 100_000


def size_of(text):
    """Words of a text column."""
    solid = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(solid == "", 0).otherwise(F.size(F.split(solid, common.SPACE))).cast("long")


def targets(sizes: list[int], weights: list[float], total: float | None = None, most: float = MOST) -> list[float]:
    """Shares of the total by weight, each at most `most` times its size; the excess is shared again."""
    total = float(sum(sizes)) if total is None else float(total)
    out, open_, left = [0.0] * len(sizes), list(range(len(sizes))), total
    while open_:
        all_weights = sum(weights[i] for i in open_)
        share = {i: left * weights[i] / all_weights for i in open_}
        over = [i for i in open_ if share[i] > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = share[i]
            break
        for i in over:
            out[i] = float(most * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in over]
    return out


def flight(size: np.ndarray, chance: np.ndarray, random: np.ndarray) -> np.ndarray:
    """Inclusion probabilities after the flight: all 0 or 1 but for two at most; both totals unchanged."""
    out = chance.astype(float).tolist()
    x = (size / max(1.0, float(size.max(initial=1)))).tolist()
    open_: list[int] = []
    tiny = 1e-9
    for new in range(len(out)):
        if not tiny < out[new] < 1 - tiny:
            out[new] = float(round(out[new]))
            continue
        open_.append(new)
        if len(open_) < 3:
            continue
        i, j, k = open_
        # a direction that keeps the sum of the changes and their sum weighted by size at 0
        u = [x[j] - x[k], x[k] - x[i], x[i] - x[j]]
        if not any(u):
            u = [1.0, -1.0, 0.0]
        up = min((((1 - out[a]) / c) if c > 0 else (out[a] / -c)) for a, c in zip(open_, u, strict=True) if c)
        down = min(((out[a] / c) if c > 0 else ((1 - out[a]) / -c)) for a, c in zip(open_, u, strict=True) if c)
        step = up if random[new] < down / (up + down) else -down
        for a, c in zip(open_, u, strict=True):
            out[a] += step * c
            if out[a] < tiny:
                out[a] = 0.0
            elif out[a] > 1 - tiny:
                out[a] = 1.0
        open_ = [a for a in open_ if 0 < out[a] < 1]
    return np.array(out)


def _nearer(options: np.ndarray, held: np.ndarray, size: np.ndarray, words: float, least: int, high: int) -> np.ndarray:
    """Samples with one or two documents changed by one, but not the held one (-1: none), so that each is as near the words as such a change can make it."""
    m, n = options.shape
    rows = np.arange(m)
    up, down = np.where(options < high, size, np.inf), np.where(options > least, -size, np.inf)
    kept = np.flatnonzero(held >= 0)
    up[kept, held[kept]] = down[kept, held[kept]] = np.inf
    change = np.concatenate([up, down, np.zeros((m, 1))], 1)  # the last: no change
    off = options @ size - words
    best, pair = np.full(m, np.inf), np.full((m, 2), 2 * n)
    for k in range(2 * n):
        both = np.abs((off + change[:, k])[:, None] + change[:, k + 1 :])
        at = both.argmin(1)
        error = both[rows, at]
        less = error < np.minimum(best, np.abs(off))
        best[less] = error[less]
        pair[less] = np.stack([np.full(m, k), at + k + 1], 1)[less]
    out = np.concatenate([options, options[:, :1]], 1)
    for one in pair.T:
        np.add.at(out, (rows, np.where(one == 2 * n, n, one % n)), np.where(one < n, 1, -1))
    return np.clip(out[:, :n], least, high)


def design(samples: np.ndarray, cost: np.ndarray, chance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of samples and their probabilities, with which every document has its chance and the expected cost is least.

    A linear programme with a row for each document and one for the whole, solved by the simplex method. The first
    len(chance) + 1 samples must be those of `nested`, which keep the chances; so does what each step gives.
    """
    n = len(chance)
    rows = np.concatenate([samples.T.astype(float), np.ones((1, len(samples)))])
    goal = np.append(chance, 1.0)
    base = np.arange(n + 1)
    for _ in range(STEPS * (n + 1)):
        square = rows[:, base]
        gain = cost - np.linalg.solve(square.T, cost[base]) @ rows
        new = int(gain.argmin())
        if gain[new] > -1e-7 * (1 + cost.max()):
            break
        share, way = np.linalg.solve(square, np.stack([goal, rows[:, new]], 1)).T
        down = np.flatnonzero(way > 1e-9)
        base[down[(np.maximum(share[down], 0) / way[down]).argmin()]] = new
    share = np.maximum(np.linalg.solve(rows[:, base], goal), 0)
    return base, share / share.sum()


def nested(chance: np.ndarray) -> np.ndarray:
    """The samples of the likeliest document, of the two likeliest, and so on, and the empty one: some mixture of them keeps any chances in this order."""
    place = np.empty(len(chance), int)
    place[np.argsort(-chance, kind="stable")] = np.arange(len(chance))
    return place[None, :] < np.arange(len(chance) + 1)[:, None]


def landing(size: np.ndarray, chance: np.ndarray, seed: int = 0, least: int = 0, high: int = 1) -> np.ndarray:
    """Decides what is left by a sampling design that keeps every chance and has the least expected error in words.

    least: -1 if documents are also taken for certain, so that one may be left out for another; high: 2 if one may be
    taken twice for another. The mean of what is taken stays the chance. A document too many, or one that is left out or
    taken twice, counts as one word.
    """
    out = chance.astype(float)
    left = np.flatnonzero((out > 0) & (out < 1))
    if not len(left):
        return out
    rng = np.random.default_rng(seed)
    x, p, n = size[left].astype(float), out[left], len(left)
    words, docs = (x * p).sum(), p.sum()
    held = np.concatenate([np.full(DRAWS, -1), np.repeat(np.arange(n), 2 * HELD)])
    draws = (rng.random((len(held), n)) < p).astype(np.int8)
    draws[np.arange(DRAWS, len(held)), held[DRAWS:]] = np.arange(2 * HELD * n) % 2  # each document in and out
    options = [nested(p).astype(np.int8), draws]
    for _ in range(NEARER):
        options.append(_nearer(options[-1], held, x, words, least, high))
    samples = np.concatenate(options)
    cost = np.abs(samples @ x - words) + np.abs(samples.sum(1) - docs) + ((samples < 0) | (samples > 1)).sum(1)
    base, share = design(samples, cost, p)
    out[left] = samples[rng.choice(base, p=share)]
    return out


def later(size: np.ndarray, chance: np.ndarray, random: np.ndarray, most: int) -> np.ndarray:
    """The flight of all but `most` undecided documents, of all sizes, which stay as they are."""
    open_ = np.flatnonzero((chance > 0) & (chance < 1))
    wait = np.unique(open_[np.linspace(0, len(open_) - 1, min(most, len(open_))).astype(int)]) if len(open_) else open_
    fly = np.setdiff1d(np.arange(len(chance)), wait)
    out = chance.astype(float)
    out[fly] = flight(size[fly], chance[fly], random[fly])
    return out


_ROW = "doc_id long, print long, size long, place long, least int, high int, chance double, draw long"


def _block(rows: pa.Table) -> pa.Table:
    """What one block does: the flight and, in a source's last block, the landing."""
    rows = rows.sort_by([("size", "descending"), ("draw", "ascending"), ("doc_id", "ascending")])
    size, draw = rows["size"].to_numpy(), rows["draw"].to_numpy().view(np.uint64)
    random = (common.mix(draw + np.uint64(len(size))) >> np.uint64(11)).astype(float) / 2**53
    last = rows["blocks"][0].as_py() == 1
    chance = later(size, rows["chance"].to_numpy(), random, LANDING if last else min(LANDING // 2, len(size) // 2))
    if last:
        chance = landing(size, chance, int(np.bitwise_xor.reduce(draw)), rows["least"][0].as_py(), rows["high"][0].as_py())
    return pa.Table.from_arrays([*[rows[c] for c in ("doc_id", "print", "size", "place", "least", "high")], pa.array(chance), pa.array(common.mix(draw).view(np.int64))], ["doc_id", "print", "size", "place", "least", "high", "chance", "draw"])


def row_print(text: str = "text", source: str = "source"):
    """64 bits that tell a row's text and source."""
    return F.xxhash64(F.col(text).cast("binary"), F.col(text).isNull(), F.col(source), F.col(source).isNull())


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_SOURCES else df


def _decided(rows: DataFrame) -> DataFrame:
    """Rows with chances of 0 or 1 (-1: one less than for certain, 2: two more); by rounds of blocks within places (sources)."""
    done, left = None, common.cut(rows)
    while True:
        counts = common.cut(left.groupBy("place").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.lit(1)).cast("int").alias("blocks")))
        most = counts.agg(F.max("blocks")).first()[0] or 1
        parts = left.join(_few(counts), "place").withColumn("block", F.pmod("draw", F.col("blocks")).cast("int"))
        flown = common.cut(parts.groupBy("place", "block").applyInArrow(_block, _ROW))
        settled = flown.where("chance <= 0 or chance >= 1")
        done = settled if done is None else done.unionByName(settled)
        if most == 1:  # every source has landed
            return done
        left = flown.where("chance > 0 and chance < 1")


def plan(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """source, place, source_size, weight, target and times (target by size) of each source; sizes: source, size.

    Shares rise as sources reach their bound, so that a source once above it stays there: each pass counts those above.
    """
    spark = sizes.sparkSession
    ordered = common.cut(sizes.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    before, offsets = 0, []
    for r in sorted(ordered.groupBy(part.alias("part")).count().collect()):  # one row for each partition
        offsets.append((r["part"], before))
        before += r["count"]
    offsets = spark.createDataFrame(offsets, "part long, before long")
    rows = ordered.join(F.broadcast(offsets), part == F.col("part"))
    rows = rows.select("source", F.col("size").alias("source_size"), (F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("place"))
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("place", F.lit(len(weights))).cast("int"))
    rows = common.cut(rows.withColumn("weight", weight))
    total, all_weights = rows.agg(F.sum("source_size"), F.sum("weight")).first()
    left, open_weights, above = float(total or 0), all_weights or 0.0, 0
    over = F.lit(False)
    while open_weights > 0:
        over = F.lit(left) * F.col("weight") / F.lit(open_weights) > most * F.col("source_size")
        n, size, weight_of = rows.where(over).agg(F.count("*"), F.sum("source_size"), F.sum("weight")).first()
        if n == above:
            break
        above, left, open_weights = n, total - most * size, all_weights - weight_of if n < before else 0.0
    share = F.lit(left) * F.col("weight") / F.lit(open_weights) if open_weights > 0 else F.lit(0.0)
    target = F.when(F.lit(True) if not open_weights else over, most * F.col("source_size").cast("double")).otherwise(share)
    return rows.withColumn("target", target).withColumn("times", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, text: str = "text", source: str = "source", id_: str = "doc_id") -> DataFrame:
    """For every row: doc_id, print of text and source, place of the source, size, source_size, target, taken (words), and times (how often the row is taken)."""
    common.ship(docs.sparkSession)
    rows = common.cut(docs.select(F.col(id_).cast("long").alias("doc_id"), F.col(source).alias("source"), size_of(F.col(text)).alias("size"), row_print(text, source).alias("print")))
    rows = rows.withColumn("part", F.spark_partition_id())
    sources = common.cut(plan(rows.groupBy("source").agg(F.sum("size").alias("size")), weights, most))
    named = _few(sources.select(F.col("source").alias("of"), "place"))
    row = ["doc_id", "print", "place"]
    parts = rows.join(named, F.col("source").eqNullSafe(F.col("of"))).groupBy(*row, "size", "part").agg(F.count("*").alias("n"))
    parts = common.cut(parts)
    whole = F.floor(F.col("times") + 1e-12)
    expected = F.col("n") * F.greatest(F.lit(0.0), F.col("times") - whole)
    units = parts.groupBy(*row, "size").agg(F.sum("n").alias("n")).join(_few(sources.select("place", "times")), "place")
    units = units.withColumn("sure", F.when(F.col("size") > 0, F.floor(expected + 1e-12)).otherwise(0))
    units = common.cut(units.withColumn("chance", F.when(F.col("size") > 0, F.greatest(F.lit(0.0), expected - F.col("sure"))).otherwise(0.0)))
    least, high = -(whole > 0).cast("int"), F.when(whole + 2 <= most, 2).otherwise(1)
    drawn = _decided(units.select("doc_id", "print", "size", "place", least.alias("least"), high.alias("high"), "chance", F.xxhash64("doc_id", "print").alias("draw")))

    # n equal rows are taken `extra` times more (-1: once less), the first ones more often; numbered over the parts they were counted in
    same = lambda a, b: a["doc_id"].eqNullSafe(b["d"]) & (a["print"] == b["p"]) & (a["place"] == b["s"])
    renamed = lambda df, *more: df.select(F.col("doc_id").alias("d"), F.col("print").alias("p"), F.col("place").alias("s"), *more)
    extra = renamed(drawn, F.col("chance").cast("long").alias("once"))
    extra = renamed(units.join(extra, same(units, extra)), (F.col("sure") + F.col("once")).alias("extra"), F.col("n").alias("of"))
    out = parts.join(extra, same(parts, extra)).drop("d", "p", "s")
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*row).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = out.withColumn("before", before).withColumn("number", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    out = out.join(_few(sources.select("place", "source_size", "target", whole.alias("whole"))), "place")
    at = F.col("before") + F.col("number")
    times = F.when(F.col("size") > 0, F.col("whole") + F.floor(F.col("extra") / F.col("of")) + (at <= F.pmod("extra", "of")).cast("long")).otherwise(0).cast("long")
    return out.select("doc_id", "print", "place", "size", "source_size", "target", (times * F.col("size")).alias("taken"), times.alias("times"))


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    return mixed(common.table(spark, sf_dir, "documents")).drop("print", "place")
