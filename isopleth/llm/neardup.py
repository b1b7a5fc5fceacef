"""Operator 2: n-gram Jaccard self-join by signature trees, exact, and its connected components.

Texts are sets of hashed word shingles. Texts with equal sets are one class, known by 64 bits of a fingerprint (which
coincide about three times among 10**10 distinct sets); only classes are joined.

Families. Which texts need a common tree is found without loss: the shingles of a set of n are dealt by hash into the
parts of its size band. Two sets that link differ in at most D(n) shingles, so among the D(n) + 1 largest nonempty parts
of either one, ordered by their contents, there is a part with the same contents in both (the parts before the first
shared one all differ). A hash of each such part's contents is a key, and linked sets share a key. (A set with D(n)
nonempty parts or fewer also takes a key for its band.) Classes that share a key, directly or over others, are a family.
Keys tell nothing of a link. They are reduced within each batch before the shuffle, so that a key with a third of all
rows comes to its reducer as one row for each batch, and are a stream there.

Signature trees. A family's classes form one tree. Its bitmaps have a bit for each shingle that two members share (up to
`BITS`; beyond, bits are shared by hash); leaves go by size band, then bitmap. A node has the OR of the bitmaps below it,
the fewest bits, the ranges of size, the most shared shingles, and the component if there is only one. A dual traversal
from (root, root) drops pairs of nodes whose largest possible overlap is below what the threshold needs, whose sizes
don't match, or that are within one component. Leaves that meet are decided on the spot: by the bitmaps where each
shared shingle has its own bit, else by the whole sorted sets. A link merges components (union-find), so that a tree
gives fewer links than it has members.

Large families. A family of more than `TILE` members or `TILE_SHINGLES` shingles is dealt into trees by hash, and about
`LANDMARKS` of its members are in all of these, which ties together the components of the trees. What is then left, and
lost by neither: keys whose members are not within one component get trees of their own, in blocks that are joined by
pairs, without pairs of blocks that are within one component. The pairs of classes that share a key there and don't
link are the one cost that can grow faster than the input.

Components are found by joins with pointer jumping. Nothing but row counts comes to the driver.

Null, empty and blank texts have an empty set and link with nothing. Rows with a null doc_id take no part and have a
null component. Repeated rows are in one class. Very long texts are whole sets. Rows that share a doc_id but not the
text are rows of their own, and each may be in another component. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from . import common

#: Bits of a tree's bitmaps, at most.
BITS = 8192
#: Children of a node.
FANOUT = 8
#: Members of a tree, and their shingles together (32 MB), at most.
TILE, TILE_SHINGLES = 8192, 1 << 22
#: Members of a large family that are in all of its trees, about.
LANDMARKS = 64
#: Rows up to which a list of documents, with their trees, is broadcast (about 60 MB); beyond, the join is a shuffle.
BROADCAST_IDS = 500_000
_BAND = 1.5
#: Classes and members that a task remembers so as not to give them twice; equal rows beyond are dropped later.
_SEEN = 100_000
_FOLD = np.uint64(0x9FB21C651E98DF25)


@lru_cache(maxsize=1 << 16)
def most_different(n: int, percent: int) -> int:
    """Largest symmetric difference of a set of n with a set that it links to."""
    best = 0
    for m in (n, 100 * n // percent, -(-percent * n // 100)):
        for size in (m - 1, m, m + 1):
            if size > 0 and 100 * min(n, size) >= percent * max(n, size):
                best = max(best, n + size - 2 * -(-percent * (n + size) // (100 + percent)))
    return best


def _bands(n: int, percent: int) -> list[int]:
    """Bands of the smaller set, over all pairs that a set of n can be in."""
    of = lambda m: int(np.log(m) / np.log(_BAND) + 1e-9)
    return list(range(of(max(1, -(-percent * n // 100))), of(n) + 1))


@lru_cache(maxsize=1 << 10)
def _parts(band: int, percent: int) -> int:
    """So many parts that the largest sets of a band have more nonempty ones than they can differ in."""
    top = _BAND ** (band + 1) * 100 / percent
    differ = 1.03 * top * (100 - percent) / percent + 4
    parts = differ
    while parts < 64 * top and parts * (1 - np.exp(-top / parts)) < differ:
        parts *= 1.04
    return int(parts) + 1


def routing_keys(shingles: np.ndarray, percent: int) -> np.ndarray:
    """Keys of one set; sets that link, and are not equal, share one at least."""
    n = len(shingles)
    most = most_different(n, percent) if n else 0
    if not most:
        return np.zeros(0, np.int64)
    out = []
    low, high = (shingles & np.uint64(0xFFFFFFFF)).astype(np.float64), (shingles >> np.uint64(32)).astype(np.float64)
    for band in _bands(n, percent):
        parts = _parts(band, percent)
        part = (common.mix(shingles + np.uint64(band + 1)) % np.uint64(parts)).astype(np.int64)
        count = np.bincount(part, minlength=parts)
        full = np.flatnonzero(count)
        sums = np.bincount(part, low, parts)[full].astype(np.uint64) * _FOLD + np.bincount(part, high, parts)[full].astype(np.uint64)
        key = common.mix(common.mix(sums) + np.uint64(band << 32) + full.astype(np.uint64))
        out.append(key[np.lexsort((key, -count[full]))[: most + 1]])
        if len(full) <= most:
            out.append(common.mix(np.array([band + (1 << 60)], np.uint64)))
    return np.concatenate(out).view(np.int64)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's k-word shingles."""
    for at, end, data, offs in common.slabs(column):
        data = common.lowered(data)
        starts, ends, first = common.word_spans(data, offs)
        words = common.span_hashes(data, starts, ends)
        runs = np.zeros(max(0, len(words) - k + 1), np.uint64)
        for j in range(k):
            runs = common.mix(runs * _FOLD + words[j : j + len(runs)])
        for i in range(end - at):
            a, b = int(first[i]), int(first[i + 1])
            if b - a >= k:
                yield np.unique(runs[a : b - k + 1])
            elif b > a:
                x = np.uint64(0)
                with np.errstate(over="ignore"):
                    for w in words[a:b]:
                        x = common.mix(np.array([x * _FOLD + w + np.uint64(b - a)], np.uint64))[0]
                yield np.array([x], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    """Arrow lists of 64-bit numbers."""
    ends = np.concatenate([[0], np.cumsum([len(x) for x in arrays])])
    flat = pa.array(np.concatenate([np.zeros(0, np.int64), *(x.view(np.int64) for x in arrays)]))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)


def class_of(shingles: np.ndarray) -> int:
    """Class of a set."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _first_of_key(keys: list[np.ndarray], classes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each set its keys that no other of the batch had before, and its other keys with the set that had them."""
    size = np.array([len(x) for x in keys])
    if not size.sum():
        none = np.zeros(0, np.int64)
        return [(none, none, none)] * len(keys)
    owner, flat = np.repeat(np.arange(len(keys)), size), np.concatenate(keys)
    order = np.lexsort((owner, flat))
    new = np.concatenate([[True], flat[order][1:] != flat[order][:-1]])
    first = np.empty(len(flat), np.int64)
    first[order] = owner[order][np.maximum.accumulate(np.where(new, np.arange(len(flat)), 0))]
    ends, out = np.cumsum(size), []
    for i, (k, a, b) in enumerate(zip(keys, ends - size, ends, strict=True)):
        own = first[a:b] == i
        out.append((k[own], k[~own], classes[first[a:b][~own]]))
    return out


_DESCRIBED = "doc_id long, print long, n long, class long, keys array<long>, met array<long>, by array<long>"


def described(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, a print of the text, set size, class, and routing keys.

    Keys are given once for each class and task, and not for rows without an id. Those that an earlier row of the batch
    has are in `met`, with that row's class in `by`.
    """

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            named = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            sizes, classes, keys = [], [], []
            for i, x in enumerate(shingle_sets(batch.column("text"), k)):
                sizes.append(len(x))
                classes.append(own := class_of(x))
                keys.append(routing_keys(x, percent) if named[i] and own not in seen else np.zeros(0, np.int64))
                if named[i] and len(seen) < _SEEN:
                    seen.add(own)
            new, met, by = zip(*_first_of_key(keys, np.array(classes, np.int64)), strict=True) if keys else ((), (), ())
            columns = [batch.column("doc_id").cast(pa.int64()), batch.column("print"), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), _lists(list(new)), _lists(list(met)), _lists(list(by))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "print", "n", "class", "keys", "met", "by"])

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), common.text_print().alias("print"))
    return rows.mapInArrow(common.tidy(run), _DESCRIBED)


def _stars(batches):
    """From rows sorted by (key, class): each later member of a key with the key's first one."""
    key = first = last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k, ids = batch.column("key").to_numpy(), batch.column("class").to_numpy()
        new = np.concatenate([[key is None or k[0] != key], k[1:] != k[:-1]])
        begin = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
        heads = np.where(begin >= 0, ids[np.maximum(begin, 0)], first if first is not None else 0)
        before = np.concatenate([[last if last is not None else ids[0]], ids[:-1]])
        rest = ~new & (ids != heads) & (ids != before)
        yield pa.RecordBatch.from_arrays([pa.array(k[rest]), pa.array(heads[rest]), pa.array(ids[rest])], ["key", "a", "b"])
        key, first, last = k[-1], heads[-1], ids[-1]


# the signature tree


class Tree:
    """The leaves in tree order, and levels of nodes from the leaves up.

    sets: sorted shingle hashes of each member; component: a number for each, equal for members known to be connected;
    side: members with the same side, if it is not negative, need not be compared.
    """

    def __init__(self, sets: list[np.ndarray], component: np.ndarray, side: np.ndarray, most_bits: int | None = None):
        n = np.array([len(x) for x in sets], np.int64)
        _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = times > 1
        own = shared[token]
        leaf, bit = np.repeat(np.arange(len(n)), n)[own], (np.cumsum(shared) - 1)[token][own]
        words = max(1, min(-(-int(shared.sum()) // 64), (most_bits or BITS) // 64))
        self.exact = int(shared.sum()) <= 64 * words
        bits = np.zeros((len(n), words), np.uint64)
        ends = np.searchsorted(leaf, np.arange(0, len(n) + 1024, 1024))
        for at, a, b in zip(range(0, len(n), 1024), ends[:-1], ends[1:], strict=False):
            some = np.zeros((min(1024, len(n) - at), 64 * words), bool)
            some[leaf[a:b] - at, bit[a:b] % (64 * words)] = True
            bits[at : at + 1024] = np.packbits(some, axis=1).view(np.uint64)
        band = np.where(n > 0, np.log(np.maximum(n, 1)) * 20, -1).astype(np.int64)
        self.order = np.lexsort((n, *bits.T[:4][::-1], band, side))
        o = self.order
        most = np.bincount(leaf, minlength=len(n))
        self.sets = [sets[i] for i in o]
        level = {"bits": bits[o], "fewest": np.bitwise_count(bits[o]).sum(1, dtype=np.int64), "most": most[o], "low": n[o], "high": n[o], "side": side[o]}
        self.levels = [level]
        while len(level["low"]) > 1:
            at = np.arange(0, len(level["low"]), FANOUT)
            sides = np.minimum.reduceat(level["side"], at), np.maximum.reduceat(level["side"], at)
            level = {
                "bits": np.bitwise_or.reduceat(level["bits"], at, axis=0),
                "fewest": np.minimum.reduceat(level["fewest"], at),
                "most": np.maximum.reduceat(level["most"], at),
                "low": np.minimum.reduceat(level["low"], at),
                "high": np.maximum.reduceat(level["high"], at),
                "side": np.where(sides[0] == sides[1], sides[0], -1),
            }
            self.levels.append(level)
        self.parent = np.unique(component[o], return_index=True, return_inverse=True)
        self.parent = self.parent[1][self.parent[2]].tolist()
        self.compared = 0
        self._fresh()

    def _fresh(self) -> None:
        """Component of each node, -1 if there are several."""
        found = np.array(self.parent)
        while (found != found[found]).any():
            found = found[found]
        self.levels[0]["of"] = found
        for below, level in zip(self.levels, self.levels[1:], strict=False):
            at = np.arange(0, len(below["of"]), FANOUT)
            first, last = np.minimum.reduceat(below["of"], at), np.maximum.reduceat(below["of"], at)
            level["of"] = np.where(first == last, first, -1)

    def _root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def _apart(self, level: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        of, side = level["of"], level["side"]
        return ((of[i] < 0) | (of[i] != of[j])) & ((side[i] < 0) | (side[i] != side[j]))

    def possible(self, depth: int, i: np.ndarray, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Those pairs of nodes below which two members may link, by sizes and the overlap that the bitmaps allow."""
        x = self.levels[depth]
        most, low, high = x["most"], x["low"], x["high"]
        fits = self._apart(x, i, j) & (100 * high[i] >= percent * low[j]) & (100 * high[j] >= percent * low[i])
        fits &= (100 + percent) * np.minimum(most[i], most[j]) >= percent * (low[i] + low[j])  # 100 o >= p (a + b - o)
        i, j = i[fits], j[fits]
        both = np.bitwise_count(x["bits"][i] & x["bits"][j]).sum(1, dtype=np.int64)
        overlap = np.minimum(most[i] - np.maximum(0, x["fewest"][i] - both), most[j] - np.maximum(0, x["fewest"][j] - both))
        if self.exact:
            overlap = np.minimum(overlap, both)
        fits = (overlap > 0) & ((100 + percent) * overlap >= percent * (low[i] + low[j]))
        return i[fits], j[fits]

    def links(self, percent: int, piece: int | None = None) -> list[tuple[int, int]]:
        """Links (as places in the given order) that connect all members that links connect: fewer than members."""
        out: list[tuple[int, int]] = []
        piece = piece or max(256, (1 << 24) // self.levels[0]["bits"][0].nbytes)  # 16 MB of bitmaps at a time
        todo = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while todo:
            depth, i, j = todo.pop()
            if len(i) > piece:
                todo += [(depth, i[piece:], j[piece:]), (depth, i[:piece], j[:piece])]
                continue
            self.compared += len(i) if depth == 0 else 0
            i, j = self.possible(depth, i, j, percent)
            if not len(i):
                continue
            if depth:
                down = np.arange(FANOUT)
                a, b = np.broadcast_arrays((i[:, None] * FANOUT + down)[:, :, None], (j[:, None] * FANOUT + down)[:, None, :])
                last = len(self.levels[depth - 1]["low"])
                some = (a < last) & (b < last) & ((a < b) if depth == 1 else (a <= b))
                a, b = a[some], b[some]
                near = np.argsort(b - a, kind="stable")  # neighbours first: they are the likeliest to merge
                todo.append((depth - 1, a[near], b[near]))
                continue
            before = len(out)
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                one, two = self._root(x), self._root(y)
                if one != two and (self.exact or _linked(self.sets[x], self.sets[y], percent)):
                    self.parent[max(one, two)] = min(one, two)
                    out.append((int(self.order[x]), int(self.order[y])))
            if len(out) > before:
                self._fresh()
        return out


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x)
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def _groups(batches, column: str):
    """Whole groups of sorted rows, as tables, by equal values of a column."""
    held = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        values = table[column].to_numpy()
        edge = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else []
        for a, b in zip(edge, [*edge[1:], len(values)], strict=True):
            if held and held[-1][column][0].as_py() != values[a]:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(a, b - a))
    if held:
        yield pa.concat_tables(held)


def tree_links(docs: DataFrame, assigned: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) of classes, from one signature tree for each tile: of each component's smallest class with the others.

    assigned: doc_id and print of a row, class, and an array of (tile, component, side); the texts are read again, a row that
    shares both is another copy of the text, and only sets of these classes are shuffled, once for each tile.
    """
    assigned = common.cut(assigned)
    some = F.broadcast(assigned) if assigned.count() <= BROADCAST_IDS else assigned
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), common.text_print().alias("print"))
    rows = rows.join(some, ["doc_id", "print"]).select("class", "tiles", "text")

    def sets(batches):
        seen: set[int] = set()
        for batch in batches:
            wanted, keep, found = batch.column("class").to_pylist(), [], []
            for i, x in enumerate(shingle_sets(batch.column("text"), k)):
                if wanted[i] not in seen and class_of(x) == wanted[i]:
                    keep.append(i)
                    found.append(x)
                    if len(seen) < _SEEN:
                        seen.add(wanted[i])
            yield pa.RecordBatch.from_arrays([batch.column("class").take(pa.array(keep, pa.int64())), batch.column("tiles").take(pa.array(keep, pa.int64())), _lists(found)], ["class", "tiles", "shingles"])

    kind = "array<struct<tile:bigint,component:bigint,side:int>>"
    rows = rows.select("class", F.col("tiles").cast(kind).alias("tiles"), "text").mapInArrow(common.tidy(sets), f"class long, tiles {kind}, shingles array<long>")
    rows = rows.select("class", "shingles", F.explode("tiles").alias("x")).select("x.*", "class", "shingles")
    rows = rows.repartition(common.n_tasks(docs.sparkSession), "tile").sortWithinPartitions("tile")

    def run(batches):
        a, b = [], []
        for tile in _groups(batches, "tile"):
            classes = tile["class"].to_numpy()
            lists = tile["shingles"].combine_chunks()
            flat, offs = lists.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            _, one = np.unique(np.stack([classes, tile["side"].to_numpy()]), axis=1, return_index=True)  # equal rows of several tasks
            tree = Tree([np.sort(flat[offs[i] : offs[i + 1]]) for i in one], tile["component"].to_numpy()[one], tile["side"].to_numpy()[one])
            if tree.links(percent):
                own, of = classes[one][tree.order], tree.levels[0]["of"]
                low = np.full(len(own), np.iinfo(np.int64).max)
                np.minimum.at(low, of, own)
                rest = low[of] != own
                a.append(low[of][rest])
                b.append(own[rest])
        none = np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *a])), pa.array(np.concatenate([none, *b]))], ["a", "b"])

    return common.cut(rows.mapInArrow(common.tidy(run), "a long, b long"))


def _pieces(members, shingles):
    """Trees that so many members with so many shingles need."""
    return F.greatest(F.ceil(members / TILE), F.ceil(shingles / TILE_SHINGLES), F.lit(1)).cast("int")


def _tile(tile, component, side):
    return F.struct(tile.alias("tile"), component.alias("component"), side.cast("int").alias("side"))


def _first_tiles(members: DataFrame) -> DataFrame:
    """One tree for each family, or several that have landmarks in common; members: doc_id, print, class, n, family, pieces."""
    own = F.pmod(F.xxhash64("class", F.lit(1)), F.col("pieces")).cast("int")
    landmark = F.pmod(F.xxhash64("class", F.lit(2)), F.ceil(F.col("members") / LANDMARKS)) == 0
    numbers = F.when(landmark, F.sequence(F.lit(0), F.col("pieces") - 1)).otherwise(F.array(own))
    return members.select("doc_id", "print", "class", F.transform(numbers, lambda i: _tile(F.xxhash64("family", i), F.col("class"), F.lit(-1))).alias("tiles"))


def _later_tiles(stars: DataFrame, members: DataFrame, label: DataFrame) -> DataFrame:
    """Trees for those keys within large families whose members are not within one component; members: of these families."""
    within = stars.join(members.select(F.col("class").alias("a")), "a", "left_semi")
    rows = within.select("key", F.col("a").alias("class")).union(within.select("key", "b")).distinct()
    rows = rows.join(members.select("class", "n"), "class").join(label.withColumnRenamed("id", "class"), "class", "left")
    rows = rows.withColumn("label", F.coalesce("label", "class"))
    keys = rows.groupBy("key").agg(F.count("*").alias("m"), F.sum(F.xxhash64("class").cast("decimal(38,0)")).alias("s"), F.min("label").alias("l"), F.max("label").alias("h"))
    keys = keys.where("l <> h").groupBy("m", "s").agg(F.min("key").alias("key")).select("key")  # equal lists of members are one
    rows = common.cut(rows.join(keys, "key"))

    # blocks: of one large component, or of many small ones
    by_label = rows.groupBy("key", "label").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    by_label = by_label.withColumn("own", _pieces(F.col("m"), F.col("s")))
    small = by_label.where("own = 1").groupBy("key").agg(_pieces(F.sum("m"), F.sum("s")).alias("small"))
    by_label = by_label.join(small, "key", "left").select("key", "label", "own", "small")
    block = F.when(F.col("own") > 1, F.xxhash64("label", F.pmod(F.xxhash64("class"), F.col("own")))).otherwise(F.pmod(F.xxhash64("label"), F.col("small")).cast("long"))
    rows = common.cut(rows.join(by_label, ["key", "label"]).select("key", "class", "label", block.alias("block")))
    blocks = rows.groupBy("key", "block").agg(F.min("label").alias("l"), F.max("label").alias("h"))
    other = blocks.select("key", F.col("block").alias("other"), F.col("l").alias("ol"), F.col("h").alias("oh"))
    pairs = blocks.join(other, "key").where("block <= other and not (l = h and ol = oh and l = ol)").select("key", "block", "other")
    sides = pairs.select("key", "block", F.xxhash64("key", "block", "other").alias("tile"), F.when(F.col("block") == F.col("other"), -1).otherwise(0).alias("side"))
    sides = sides.union(pairs.where("block <> other").select("key", F.col("other").alias("block"), F.xxhash64("key", "block", "other").alias("tile"), F.lit(1).alias("side")))
    tiles = rows.join(sides, ["key", "block"]).groupBy("class").agg(F.collect_list(_tile(F.col("tile"), F.col("label"), F.col("side"))).alias("tiles"))
    return tiles.join(members.select("doc_id", "print", "class"), "class").select("doc_id", "print", "class", "tiles")


def families(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows (doc_id, print, n, class); classes that share a key (key, a, b); members of families (doc_id and print of the first row, class, n, family)."""
    spark = docs.sparkSession
    whole, whole_path = common.stored(described(docs, k, percent), "described")
    rows = common.cut(whole.select("doc_id", "print", "n", "class"))
    routed = whole.select("class", F.explode("keys").alias("key")).repartition(common.n_tasks(spark), "key").sortWithinPartitions("key", "class")
    stars = routed.mapInArrow(common.tidy(_stars), "key long, a long, b long")
    met = whole.select("class", F.explode(F.arrays_zip("met", "by")).alias("x")).select(F.col("x.met").alias("key"), F.col("x.by").alias("a"), F.col("class").alias("b"))
    stars = common.cut(stars.unionByName(met.where("a <> b")))
    common.drop(spark, whole_path)
    common.release(spark)
    family = components(stars.select("a", "b").distinct()).select(F.col("id").alias("class"), F.col("label").alias("family"))
    named = rows.where("n > 0 and doc_id is not null").groupBy("class").agg(F.min(F.struct("doc_id", "print")).alias("first"), F.min("n").alias("n"))
    named = named.select("class", "first.doc_id", "first.print", "n")
    return rows, stars, common.cut(named.join(family, "class"))


def grouped(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, print of the text, n_shingles, component (a number of its own for each) and component_id of every row."""
    spark = docs.sparkSession
    common.ship(spark)
    rows, stars, members = families(docs, k, percent)
    sizes = members.groupBy("family").agg(F.count("*").alias("members"), _pieces(F.count("*"), F.sum("n")).alias("pieces"))
    members = members.join(sizes, "family")
    links = tree_links(docs, _first_tiles(members), k, percent)
    label = components(links)
    large = common.cut(members.where("pieces > 1"))
    if not large.isEmpty():
        links = links.unionByName(tree_links(docs, _later_tiles(stars, large, label), k, percent))
        label = components(links)
    common.release(spark)

    usable = rows.where("n > 0 and doc_id is not null")
    low = usable.groupBy("class").agg(F.min("doc_id").alias("low"))
    found = label.select(F.col("id").alias("class"), F.col("label").alias("component")).join(members.select("class", F.col("doc_id").alias("low")), "class")
    found = found.join(found.groupBy("component").agg(F.min("low").alias("component_id")), "component").select("class", "component", "component_id")
    low = low.join(found, "class", "left").select("class", F.coalesce("component", "class").alias("component"), F.coalesce("component_id", "low").alias("component_id"))
    joined = usable.join(low, "class").select("doc_id", "print", F.col("n").alias("n_shingles"), "component", "component_id")
    rest = rows.where("n = 0 or doc_id is null").select("doc_id", "print", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component"), F.when(F.col("n") == 0, F.col("doc_id")).alias("component_id"))
    return joined.unionByName(rest)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    return grouped(docs, k, percent).drop("print", "component")


def op2_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"), k=4, percent=85)


def oracle(k: int = 4, percent: int = 85) -> str:
    """The same in SQL, by a join of all shingles; for small tables."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(words) >= {k} THEN list_transform(range(1, len(words) - {k} + 2), lambda i: array_to_string(words[i : i + {k - 1}], ' '))
      WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingles FROM w),
e AS (SELECT doc_id, unnest(shingles) AS x FROM s),
n AS (SELECT doc_id, len(shingles) AS n FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n p ON o.a = p.doc_id JOIN n q ON o.b = q.doc_id WHERE 100 * c >= {percent} * (p.n + q.n - c)),
g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, g.b FROM r JOIN g ON g.a = r.b)
SELECT n.doc_id, n.n::bigint AS n_shingles, (SELECT min(b) FROM r WHERE r.a = n.doc_id)::bigint AS component_id FROM n"""
