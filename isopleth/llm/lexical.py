"""Operator 12: ranked lexical search over document-sharded postings.

Index. Each task turns its documents into shards of up to `SHARD_DOCS` documents or about `SHARD_POSTINGS` postings: the
sorted hashes of the shard's terms, the bounds of their postings, and for each posting the document's number in the
shard and the term's count there (compressed sparse rows). Terms are cut and hashed with numpy for whole slabs of texts;
no text is shuffled. The index is a table in the shared folder and is read by every search.

Search. Queries go over the shards in blocks of about `BLOCK_TERMS` terms, one after the other, so that a block's terms
and weights are bounded and sent with the task. A first pass adds up the document frequencies of the block's terms, a
second one scores: a shard's integer impacts are computed once, then for each query the impacts of its terms are added,
term at a time, to a dense accumulator of the shard's documents. The best are selected by a partition of the scores that
keeps all ties of the last place, ordered by score and id, merged over the shards of a task, and then over tasks.

Terms are told by 64 bits of a hash. Rows of a document table with equal ids are documents of their own; null ids stay
null and come after all others of the same score. Rows that share an item_id are one item with the terms of all of them;
a null item_id is an item as well. Null and empty texts have no terms: as documents they don't count, as items they have
no rows. Texts of any length are indexed whole. Extra columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

TOP = 10
SHARD_DOCS, SHARD_POSTINGS = 8192, 1 << 19
#: Distinct terms of a block of queries, about; an item is in one block.
BLOCK_TERMS = 1 << 19

_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

_SHARD = "doc_ids array<long>, sizes binary, terms binary, bounds binary, places binary, counts binary"
_INT64_MAX = np.iinfo(np.int64).max


def terms(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of a slab, and the number of the text that each is in."""
    low = common.lowered(data)
    starts, ends, first = common.word_spans(low, offs, _BETWEEN)
    return common.span_hashes(low, starts, ends), np.repeat(np.arange(len(offs) - 1), np.diff(first))


def counted(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term, text and count of each distinct pair, in order of texts."""
    found, text = terms(data, offs)
    order = np.lexsort((found, text))
    found, text = found[order], text[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return found[at], text[at], np.diff(np.append(at, len(found)))


def _shard(ids: list, sizes: list[np.ndarray], parts: list[tuple]) -> pa.RecordBatch:
    term, place, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(term, kind="stable")
    term = term[order]
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(term)), bool), term[1:] != term[:-1]]))
    bounds = np.append(at, len(term)).astype("<i4")
    columns = np.concatenate(sizes).astype("<i8"), term[at].astype("<u8"), bounds, place[order].astype("<i4"), count[order].astype("<i4")
    return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), *(pa.array([x.tobytes()], pa.binary()) for x in columns)], ["doc_ids", "sizes", "terms", "bounds", "places", "counts"])


def index(docs: DataFrame, text: str = "text", id_: str = "doc_id") -> tuple[DataFrame, str]:
    """The shards of a table of documents, and their path in the shared folder."""

    def run(batches):
        ids, sizes, parts, postings = [], [], [], 0
        for batch in batches:
            own = batch.column("id")
            for at, end, data, offs in common.slabs(batch.column("text")):
                term, place, count = counted(data, offs)
                size = np.bincount(place, count, end - at).astype(np.int64)
                full = np.flatnonzero(size)  # texts without a term are no documents
                number = np.cumsum(size > 0) - 1 + len(ids)
                ids += own.slice(at, end - at).take(pa.array(full)).to_pylist()
                sizes.append(size[full])
                parts.append((term, number[place], count))
                postings += len(term)
                if len(ids) >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                    yield _shard(ids, sizes, parts)
                    ids, sizes, parts, postings = [], [], [], 0
        if ids:
            yield _shard(ids, sizes, parts)

    common.ship(docs.sparkSession)
    rows = docs.select(F.col(id_).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    return common.stored(rows.mapInArrow(common.tidy(run), _SHARD), "postings")


def query_terms(items: DataFrame, text: str = "text", id_: str = "item_id") -> DataFrame:
    """item and term (hash) of each distinct pair."""

    def run(batches):
        for batch in batches:
            for at, end, data, offs in common.slabs(batch.column("text")):
                term, place, _ = counted(data, offs)
                yield pa.RecordBatch.from_arrays([batch.column("item").slice(at, end - at).take(pa.array(place)), pa.array(term.view(np.int64))], ["item", "term"])

    common.ship(items.sparkSession)
    rows = items.select(F.col(id_).alias("item"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(common.tidy(run), f"item {rows.schema['item'].dataType.simpleString()}, term long").distinct()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(counts: np.ndarray, sizes: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Integer impact of each posting, before the term's weight; sizes: of the posting's document."""
    if 90 * n_docs * int(sizes.max(initial=0)) <= _INT64_MAX:
        share = 90 * n_docs * sizes // n_terms
    else:  # beyond 64 bits
        share = np.array([90 * n_docs * int(x) // n_terms for x in sizes], np.int64)
    return 1_000_000_000 * counts // (1000 * counts + 8 * (10 + share))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores above 0, by score, then by id; ties of the last place are decided by id."""
    some = np.flatnonzero(scores > 0)
    if len(some) > k:
        least = np.partition(scores[some], len(some) - k)[len(some) - k]
        some = some[scores[some] >= least]
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def _searching(queries: list[tuple[int, np.ndarray, np.ndarray]], n_docs: int, n_terms: int, k: int):
    """A function that scores shards for queries of (number, terms, weights), and gives the best of the task for each."""

    def run(batches):
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                own = {c: batch.column(c)[i] for c in batch.schema.names}
                get = lambda c, kind: np.frombuffer(own[c].as_py(), kind)  # noqa: B023, E731
                known, bounds, places = get("terms", "<u8"), get("bounds", "<i4"), get("places", "<i4")
                impact = impacts(get("counts", "<i4").astype(np.int64), get("sizes", "<i8")[places], n_docs, n_terms)
                ids = np.asarray(own["doc_ids"].values.fill_null(_INT64_MAX), np.int64)
                scores = np.zeros(len(ids), np.int64)
                for number, wanted, weights in queries:
                    at = np.searchsorted(known, wanted)
                    hit = at < len(known)
                    hit[hit] = known[at[hit]] == wanted[hit]
                    if not hit.any():
                        continue
                    scores[:] = 0
                    for t, w in zip(at[hit].tolist(), weights[hit].tolist(), strict=True):
                        a, b = bounds[t], bounds[t + 1]
                        scores[places[a:b]] += w * impact[a:b]  # a document has one posting of a term
                    top = best(scores, ids, k)
                    if len(top):
                        a, b = scores[top], ids[top]
                        if number in held:
                            a, b = np.concatenate([held[number][0], a]), np.concatenate([held[number][1], b])
                            top = best(a, b, k)
                            a, b = a[top], b[top]
                        held[number] = a, b
        if held:
            number = np.repeat(list(held), [len(x) for x, _ in held.values()])
            score, id_ = (np.concatenate(x) for x in zip(*held.values(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(id_, mask=id_ == _INT64_MAX), pa.array(score)], ["number", "doc_id", "score"])

    return run


def _frequencies(shards: DataFrame, wanted: np.ndarray) -> dict[int, int]:
    """In how many documents each of these sorted terms is."""

    def run(batches):
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for terms_, bounds in zip(batch.column("terms").to_pylist(), batch.column("bounds").to_pylist(), strict=True):
                known, bounds = np.frombuffer(terms_, "<u8"), np.frombuffer(bounds, "<i4")
                at = np.searchsorted(known, wanted)
                hit = at < len(known)
                hit[hit] = known[at[hit]] == wanted[hit]
                total[hit] += np.diff(bounds)[at[hit]]
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["at", "n"])

    found = shards.select("terms", "bounds").mapInArrow(common.tidy(run), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # one row for each term of a block
    return dict(zip(found["at"].to_pylist(), found["n"].to_pylist(), strict=True))


def search(shards: DataFrame, items: DataFrame, k: int = TOP, text: str = "text", id_: str = "item_id") -> DataFrame:
    """item, rank, doc_id and score: the k best documents of each item."""
    spark: SparkSession = shards.sparkSession
    wanted = common.cut(query_terms(items, text, id_))
    kind = wanted.schema["item"].dataType.simpleString()
    result = f"item {kind}, rank int, doc_id long, score long"

    def sums(batches):
        for batch in batches:
            sizes = [np.frombuffer(x, "<i8") for x in batch.column("sizes").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([sum(map(len, sizes))], pa.int64()), pa.array([int(sum(x.sum() for x in sizes))], pa.int64())], ["docs", "terms"])

    n_docs, n_terms = shards.select("sizes").mapInArrow(common.tidy(sums), "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    total = wanted.count()
    if not n_docs or not total:
        return spark.createDataFrame([], result)
    n_blocks = -(-total // BLOCK_TERMS)
    block = F.pmod(F.xxhash64("item"), F.lit(n_blocks))
    found = []
    for b in range(n_blocks):
        rows = wanted.where(block == b).toArrow().to_pydict()  # about BLOCK_TERMS rows
        term = np.array(rows["term"], np.int64).view(np.uint64)
        distinct = np.unique(term)
        frequency = _frequencies(shards, distinct)
        weights = np.array([weight(n_docs, frequency.get(i, 0)) for i in range(len(distinct))], np.int64)
        names = list(dict.fromkeys(rows["item"]))
        if not names:
            continue
        number = {x: i for i, x in enumerate(names)}
        of = np.array([number[x] for x in rows["item"]], np.int64)
        order = np.argsort(of, kind="stable")
        cuts = np.searchsorted(of[order], np.arange(len(names) + 1))
        queries = []
        for i in range(len(names)):
            own = np.sort(term[order[cuts[i] : cuts[i + 1]]])
            queries.append((i, own, weights[np.searchsorted(distinct, own)]))
        scored = shards.mapInArrow(common.tidy(_searching(queries, n_docs, n_terms, k)), "number long, doc_id long, score long")
        named = spark.createDataFrame(list(enumerate(names)), f"number long, item {kind}")
        found.append(scored.join(named, "number").select("item", "doc_id", "score"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op12_search(spark, sf_dir: str) -> DataFrame:
    shards, _ = index(common.table(spark, sf_dir, "documents"))
    return search(shards, common.table(spark, sf_dir, "benchmark")).withColumnRenamed("item", "item_id")


def oracle() -> str:
    """The contract in SQL."""
    cut = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH occ AS (
  SELECT doc_id, unnest(regexp_extract_all({low.format("text")}, {cut})) AS term FROM documents
), tf AS (
  SELECT doc_id, term, count(*)::bigint AS tf FROM occ GROUP BY ALL
), size AS (
  SELECT doc_id, sum(tf)::bigint AS n FROM tf GROUP BY ALL
), al AS (
  SELECT count(*)::bigint AS docs, sum(n)::bigint AS terms FROM size
), df AS (
  SELECT term, count(*)::bigint AS df FROM tf GROUP BY ALL
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all({low.format("text")}, {cut})) AS term FROM benchmark
), scored AS (
  SELECT item_id, doc_id, sum(floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::bigint * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::bigint AS score
  FROM q JOIN tf USING (term) JOIN df USING (term) JOIN size USING (doc_id), al GROUP BY ALL
)
SELECT item_id, rank, doc_id, score FROM (SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::int AS rank FROM scored WHERE score > 0) WHERE rank <= {TOP}"""
