"""Operator 9: approximate nearest neighbours by cosine, with an inverted file and product-quantised residuals.

Fit, on a bounded hash-ordered sample (`SAMPLE`): coarse centroids by k-means on unit vectors, the square root of the
number of rows, and for each of the `PARTS` sub-vectors of the residuals a codebook of up to 256 words. Index, every
row: the nearest centroid's cell and one byte for each part. Search: a query probes so many of the cells nearest to it
as the sample's true neighbours call for (few where vectors form groups, many where they don't: of random directions in
64 dimensions, about half), and more if those of queries like it do: up to `CALIBRATING` queries are compared with every
row first, and queries that are equally far from their nearest centroid get the cells that these needed. In each cell it
builds its asymmetric distance table and ranks the rows by the sum of table entries. The best of each block (`RERANK` of a
full one, `LEAST_RERANKED` at least) are scored exactly, in double precision on the original vectors, and after them
every row that its codes don't exclude: a row is no farther from its decoded vector than is known of it, so that
its distance is at least that of the decoded vector less that. Within the cells probed nothing is missed, whatever
the rows are like. A query that finds fewer than k this way, though there are more, is searched again in all cells.

Scale and skew. Only centroids, codebooks and the number of rows of each cell are on the driver. (A quarter of the sample
is the most centroids; from 25 million rows on cells grow instead.) Cells with more than `BLOCK` rows are cut into blocks
by a hash of the vector, and its queries into parts, so that a crowded cell is searched by many tasks. Vectors that occur many times stand for one
entry with their `k + 1` smallest ids, reduced within each batch, then over batches in two steps, before cells are cut;
equal query vectors are searched once: a vector with a third of all rows costs no more than another, and ties go to the
smaller id. (Equal vectors are told by 64 bits of a hash.)

Vectors that are null, zero, or hold null or non-finite components take no part, neither do vectors of another length
than the most frequent one (the longer, in a tie) and rows with a null id. With fewer candidates than k a query gets
all. Repeated ids are rows of their own as candidates with equal vectors counted once. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Rows that the index is fitted on, at most.
SAMPLE = 20_000
PARTS, WORDS = 16, 256
#: Rows of a block of a cell, and candidates of a block that are scored exactly for each query.
BLOCK, RERANK, LEAST_RERANKED = 4096, 64, 16
#: Share of the sample's true neighbours that must be in the probed cells, and queries of the sample used for that.
COVERED, CALIBRATING = 0.97, 512
#: Groups of those queries by their distance from the nearest centroid, at most, and queries of a group, at least.
GROUPS, GROUP = 8, 32
#: Rounding of the distances by tables, relative, and of distances and cosines otherwise.
TABLE_ROUNDING, DISTANCE_ROUNDING, COSINE_ROUNDING = 1e-5, 1e-6, 1e-12
#: Query vectors that are searched in a cell at a time.
QUERIES = 4096
#: First steps of the reduction of a vector that many batches have.
SALTS = 64
#: Hashes of repeated vectors up to which they are broadcast (8 MB); beyond, the joins are shuffles.
BROADCAST_HASHES = 1_000_000


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Centroids of the rows of x; fewer than k if there are fewer rows."""
    rng = np.random.default_rng(seed)
    centroids = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, centroids)
        count = np.bincount(near, minlength=len(centroids))
        order = np.argsort(near, kind="stable")
        full = np.flatnonzero(count)
        sums = np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(count[full])[:-1]]), axis=0)
        centroids[full] = sums / count[full, None]
    return centroids


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Index of the nearest centroid of each row."""
    half = (centroids**2).sum(1) / 2
    return np.concatenate([(x[i : i + 4096] @ centroids.T - half).argmax(1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


class Index:
    """Centroids and codebooks."""

    def __init__(self, sample: np.ndarray, rows: int):
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        self.centroids = kmeans(unit, int(np.clip(np.sqrt(rows), 1, max(1, len(unit) // 4))))
        residual = unit - self.centroids[nearest(unit, self.centroids)]
        self.edges = np.linspace(0, unit.shape[1], min(PARTS, unit.shape[1]) + 1).astype(int)
        self.books = [kmeans(residual[:, a:b], min(WORDS, len(unit)), rounds=5) for a, b in zip(self.edges[:-1], self.edges[1:], strict=True)]

    def enough_probes(self, sample: np.ndarray, k: int) -> int:
        """Cells to probe so that the wanted share of true neighbours is in them, as measured within the sample.

        Neighbours within a sample are farther than those within all rows, so that the number is on the safe side.
        """
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        some = unit[:: max(1, len(unit) // CALIBRATING)][:CALIBRATING]
        near = some @ unit.T
        near[near > 1 - 1e-12] = -2  # itself, and its copies
        best = np.argpartition(-near, min(k, near.shape[1]) - 1, axis=1)[:, :k]
        cell = nearest(unit, self.centroids)[best]
        place = np.argsort(self.probes(some, len(self.centroids)), axis=1)
        ranks = np.sort(np.take_along_axis(place, cell, 1).reshape(-1))
        return int(ranks[int(COVERED * (len(ranks) - 1))]) + 1

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and codes of each vector."""
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        cell = nearest(unit, self.centroids)
        residual = unit - self.centroids[cell]
        codes = np.stack([nearest(residual[:, a:b], book) for a, b, book in zip(self.edges[:-1], self.edges[1:], self.books, strict=True)], 1)
        return cell, codes.astype(np.uint8)

    def probes(self, queries: np.ndarray, n: int) -> np.ndarray:
        """The n cells nearest to each query."""
        unit = queries / np.linalg.norm(queries, axis=1, keepdims=True)
        far = (self.centroids**2).sum(1) / 2 - unit @ self.centroids.T
        return np.argsort(far, axis=1, kind="stable")[:, :n]

    def reach(self, queries: np.ndarray) -> np.ndarray:
        """Distance of each query from its nearest centroid, squared."""
        unit = queries / np.linalg.norm(queries, axis=1, keepdims=True)
        return ((unit - self.centroids[nearest(unit, self.centroids)]) ** 2).sum(1)

    def misses(self, unit: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Distance of each unit vector of a cell from the vector that its codes stand for."""
        rest = unit - self.centroids[cell]
        for part, (a, b, book) in enumerate(zip(self.edges[:-1], self.edges[1:], self.books, strict=True)):
            rest[:, a:b] -= book[codes[:, part]]
        return np.linalg.norm(rest, axis=1)

    def distances(self, queries: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of a cell's codes from each query, by tables."""
        residual = queries / np.linalg.norm(queries, axis=1, keepdims=True) - self.centroids[cell]
        out = np.zeros((len(queries), len(codes)), np.float32)
        for part, (a, b, book) in enumerate(zip(self.edges[:-1], self.edges[1:], self.books, strict=True)):
            table = ((residual[:, None, a:b] - book[None]) ** 2).sum(2).astype(np.float32)
            out += table[:, codes[:, part]]
        return out


def usable(embeddings: DataFrame, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id and vector of the rows that take part."""
    v = F.col(vector)
    rows = embeddings.select(F.col(id_).cast("long").alias("id"), v.cast("array<double>").alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()  # one row
    return rows.where(F.size("v") == (size[0]["n"] if size else 0))


def _matrix(column) -> np.ndarray:
    """Vectors, each scaled by a power of two so that its largest component is about 1.

    That is exact and leaves cosines as they are, and norms of tiny and huge vectors neither vanish nor overflow.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.zeros((0, 1))
    out = column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    return np.ldexp(out, -np.frexp(np.abs(out).max(1))[1][:, None])


def _lists(x: np.ndarray) -> pa.Array:
    n, size = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * size + 1, max(size, 1), dtype=np.int32) if size else np.zeros(n + 1, np.int32)), pa.array(x.reshape(-1)))


def _distinct(ids: np.ndarray, vectors: np.ndarray, most: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct vectors with their `most` smallest ids."""
    _, first, group = np.unique(_hashes(vectors), return_index=True, return_inverse=True)
    order = np.lexsort((ids, group))
    cut = np.concatenate([[0], np.cumsum(np.bincount(group))])
    sorted_ids = ids[order]
    return [np.unique(sorted_ids[a:b])[:most] for a, b in zip(cut[:-1], cut[1:], strict=True)], vectors[first]


def _hashes(vectors: np.ndarray) -> np.ndarray:
    """A hash of each vector's bits; 0 and -0 are one."""
    bits = common.mix((vectors + 0.0).view(np.uint64) if vectors.dtype == np.float64 else (vectors + 0.0).astype(np.float64).view(np.uint64))
    out = np.zeros(len(vectors), np.uint64)
    for column in bits.T:
        out = common.mix(out * np.uint64(0x9FB21C651E98DF25) + column)
    return out.view(np.int64)


_ENTRY = "cell int, hash long, ids array<long>, v array<double>, codes binary"


def _entries(rows: DataFrame, index: Index, k: int) -> DataFrame:
    """The inverted file: an entry for each distinct vector of a batch."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, vectors = _distinct(batch.column("id").to_numpy(), _matrix(batch.column("v")), k + 1)
            cell, codes = index.assign(vectors)
            flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]), pa.int32()), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(_hashes(vectors)), flat, _lists(vectors), pa.array([x.tobytes() for x in codes], pa.binary())], ["cell", "hash", "ids", "v", "codes"])

    return rows.mapInArrow(common.tidy(run), _ENTRY)


def _true_cells(entries: DataFrame, queries: np.ndarray, k: int) -> DataFrame:
    """The k + 1 vectors of all that are nearest to each of some queries: (query, hash, cell, score)."""
    schema = pa.schema([("query", pa.int32()), ("hash", pa.int64()), ("cell", pa.int32()), ("score", pa.float64())])
    wanted = queries / np.linalg.norm(queries, axis=1, keepdims=True)

    def run(batches):
        score, found = np.zeros((len(wanted), 0)), np.zeros((len(wanted), 0, 2), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("v"))
            near = np.concatenate([score, wanted @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T], axis=1)
            new = np.stack([batch.column("hash").to_numpy(), batch.column("cell").to_numpy().astype(np.int64)], 1)
            best = np.argpartition(-near, k, axis=1)[:, : k + 1] if near.shape[1] > k + 1 else np.broadcast_to(np.arange(near.shape[1]), near.shape)
            old = score.shape[1]
            both = new[np.maximum(best - old, 0)]
            if old:
                both = np.where((best < old)[:, :, None], np.take_along_axis(found, np.minimum(best, old - 1)[:, :, None], 1), both)
            score, found = np.take_along_axis(near, best, 1), both
        each = np.repeat(np.arange(len(wanted)), score.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(each, pa.int32()), pa.array(found[:, :, 0].reshape(-1)), pa.array(found[:, :, 1].reshape(-1), pa.int32()), pa.array(score.reshape(-1))], schema=schema)

    found = entries.select("hash", "cell", "v").mapInArrow(common.tidy(run), "query int, hash long, cell int, score double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "hash"))
    return found.withColumn("place", place).where(F.col("place") <= k + 1).drop("place")


def _enough(entries: DataFrame, index: Index, queries: DataFrame, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells to probe, at least `least`: bounds between groups of queries by `Index.reach`, and a number for each group.

    Those in which the wanted share of true neighbours is, as measured on some queries and all rows.
    """
    some = queries.orderBy(F.xxhash64("id", F.lit(9)), "id").limit(CALIBRATING).toArrow()
    if not some.num_rows:
        return np.zeros(0), np.array([least])
    _, some = _distinct(some["id"].to_numpy(), _matrix(some["v"]), 1)
    found = _true_cells(entries, some, k).toArrow()  # k + 1 rows for each of them
    query, cell = found["query"].to_numpy(), found["cell"].to_numpy()
    place = np.argsort(index.probes(some, len(index.centroids)), axis=1)
    other = found["hash"].to_numpy() != _hashes(some)[query]
    query, rank = query[other], place[query, cell][other]
    reach = index.reach(some)
    bounds = np.quantile(reach, np.linspace(0, 1, int(np.clip(len(some) // GROUP, 1, GROUPS)) + 1)[1:-1])
    group = np.searchsorted(bounds, reach)[query]
    need = [np.sort(rank[group == g]) for g in range(len(bounds) + 1)]
    return bounds, np.array([max(least, int(r[int(np.ceil(COVERED * (len(r) - 1)))]) + 1) if len(r) else least for r in need])


def _probing(rows: DataFrame, index: Index, probes: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Distinct query vectors with the cells to search: (cell, hash, v)."""
    bounds, enough = probes

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            _, vectors = _distinct(batch.column("id").to_numpy(), _matrix(batch.column("v")), 1)
            own = np.minimum(enough[np.searchsorted(bounds, index.reach(vectors))], len(index.centroids))
            cells = index.probes(vectors, own.max())
            each = np.repeat(np.arange(len(vectors)), own)
            yield pa.RecordBatch.from_arrays([pa.array(cells[np.arange(cells.shape[1]) < own[:, None]], pa.int32()), pa.array(_hashes(vectors)[each]), _lists(vectors[each])], ["cell", "hash", "v"])

    return rows.mapInArrow(common.tidy(run), "cell int, hash long, v array<double>").dropDuplicates(["cell", "hash"])


_FOUND = "hash long, vec_id long, score double"


def _once(entries: DataFrame, k: int) -> DataFrame:
    """One entry for each vector: those that several batches have are reduced in two steps."""
    repeated = common.cut(entries.groupBy("hash").count().where("count > 1").select("hash"))
    if repeated.isEmpty():
        return entries
    few = F.broadcast(repeated) if repeated.count() <= BROADCAST_HASHES else repeated
    some = entries.join(few, "hash", "left_semi").withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(SALTS)))
    best = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids")
    # equal vectors may be written with 0 or -0, so that any of them stands for all
    one = [F.min("cell").alias("cell"), best, F.min_by("v", "cell").alias("v"), F.min_by("codes", "cell").alias("codes")]
    some = some.groupBy("hash", "salt").agg(*one).groupBy("hash").agg(*one).select(entries.columns)
    return entries.join(few, "hash", "left_anti").select(entries.columns).unionByName(some)


def _searching(index: Index, k: int):
    """Best candidates of one block for all queries that probe its cell: none of its rows has a higher cosine."""

    def run(block: pa.Table, queries: pa.Table) -> pa.Table:
        schema = pa.schema([("hash", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not block.num_rows or not queries.num_rows:
            return schema.empty_table()
        ids, vectors, cell = block["ids"].to_pylist(), _matrix(block["v"]), block["cell"][0].as_py()
        codes = np.frombuffer(b"".join(block["codes"].to_pylist()), np.uint8).reshape(block.num_rows, -1)
        norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        unit = vectors / norms[:, None]
        misses = index.misses(unit, cell, codes)
        smallest = np.array([min(x) for x in ids])
        hashes, wanted = queries["hash"].to_numpy(), _matrix(queries["v"])
        some_best = min(len(ids), max(LEAST_RERANKED, k + 1, -(-RERANK * len(ids) // BLOCK)))
        last = min(len(ids), k + 1)
        out = []
        for at in range(0, len(wanted), 64):
            some = wanted[at : at + 64]
            far = index.distances(some, cell, codes)
            own = np.sqrt(np.einsum("ij,ij->i", some, some))
            some_unit = some / own[:, None]
            first = np.argpartition(far, some_best - 1, axis=1)[:, :some_best]
            score = np.einsum("qbj,qj->qb", unit[first], some_unit)
            reach = np.sqrt(np.maximum(2 - 2 * np.partition(score, -last, axis=1)[:, -last], 0)) + DISTANCE_ROUNDING
            # what is left are rows whose codes don't put them beyond the best so far
            left = np.sqrt(far) * (1 - TABLE_ROUNDING) - misses <= reach[:, None]
            np.put_along_axis(left, first, True, axis=1)
            rows = np.flatnonzero(left.any(0))
            near = some_unit @ unit[rows].T
            least = np.partition(near, -last, axis=1)[:, -last] - COSINE_ROUNDING
            for i, q in enumerate(some):
                best = rows[near[i] >= least[i]]
                score = np.einsum("ij,j->i", vectors[best], q) / (norms[best] * own[i])
                for j in np.lexsort((smallest[best], -score))[: k + 1]:
                    out += [(hashes[at + i], x, score[j]) for x in ids[best[j]]]
        return pa.Table.from_arrays([pa.array([x[c] for x in out], t) for c, t in enumerate(schema.types)], schema=schema)

    return run


def neighbours(embeddings: DataFrame, every: int = 50, k: int = 5, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found of each row whose id is divisible by `every`."""
    spark = embeddings.sparkSession
    common.ship(spark)
    rows = usable(embeddings, id_, vector)
    total = rows.count()
    result = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], result)
    sample = rows.orderBy(F.xxhash64("id", F.lit(9)), "id").limit(SAMPLE).toArrow()
    sample = _matrix(sample["v"])
    index = Index(sample, total)
    entries = common.cut(_once(common.cut(_entries(rows, index, k)), k))
    sizes = {r["cell"]: r["count"] for r in entries.groupBy("cell").count().collect()}  # one row for each cell
    blocks = spark.createDataFrame([(c, -(-n // BLOCK)) for c, n in sizes.items()], "cell int, blocks int")
    entries = entries.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod("hash", F.col("blocks")).cast("int")).drop("blocks")
    queries = rows.where(F.col("id") % every == 0)

    def best_of(some: DataFrame, probes: tuple[np.ndarray, np.ndarray]) -> DataFrame:
        """The k + 1 best of each query vector, so that k are left without the query's own row."""
        # the queries of a cell are cut as well, into parts that meet all blocks of the cell
        probing = common.cut(_probing(some, index, probes))
        asked = probing.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts")).join(blocks.withColumnRenamed("blocks", "n"), "cell")
        asked = F.broadcast(common.cut(asked))  # one row for each cell
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
        parted = probing.join(asked, "cell").select("cell", F.pmod("hash", F.col("parts")).cast("int").alias("part"), "hash", "v", each("n").alias("block"))
        wanted = entries.join(asked, "cell").select(*entries.columns, each("parts").alias("part"))
        keys = "cell", "block", "part"
        found = wanted.groupBy(*keys).cogroup(parted.groupBy(*keys)).applyInArrow(_searching(index, k), _FOUND)
        best = found.groupBy("hash", "vec_id").agg(F.max("score").alias("score"))
        # the best are kept within each partition first: no list of all candidates is made
        place = F.row_number().over(Window.partitionBy("hash").orderBy(F.desc("score"), "vec_id"))
        best = best.withColumn("place", place).where(F.col("place") <= k + 1)
        return best.groupBy("hash").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))).alias("best"))

    probes = _enough(entries, index, queries, k, index.enough_probes(sample, k))
    best = common.cut(best_of(queries, probes))

    def hashed(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(_hashes(_matrix(batch.column("v"))))], ["query_id", "hash"])

    asked = queries.mapInArrow(common.tidy(hashed), "query_id long, hash long").distinct()
    if probes[1].min() < len(index.centroids):
        # too few in the probed cells: all cells, for these queries only
        short = best.where(F.size("best") < min(k + 1, total)).select("hash")
        short = common.cut(asked.join(short, "hash").select(F.col("query_id").alias("id")))
        if not short.isEmpty():
            more = best_of(queries.join(short, "id", "left_semi"), (np.zeros(0), np.array([len(index.centroids)])))
            best = best.join(more.select("hash"), "hash", "left_anti").unionByName(more)
    own = asked.join(best, "hash").withColumn("best", F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k))
    out = own.select("query_id", F.posexplode("best").alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score"))


def op9_ann(spark, sf_dir: str) -> DataFrame:
    return neighbours(common.table(spark, sf_dir, "embeddings"))
