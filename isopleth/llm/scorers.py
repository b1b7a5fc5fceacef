"""Quality (operator 1) and toxicity (operator 5): factorisation machines over hashed terms.

Both work alike. A bounded, hash-ordered sample of the labelled documents that training may see is taken
(`TRAINING_ROWS`, a documented parameter). Executors count, by class, in how many sampled documents each hashed bucket
occurs; all buckets whose rates differ between the classes by at least `SCREEN` standard errors stay, weighted by that
number. The driver gets those counts (one number for each of 2**18 buckets and class at most) and then the sampled rows
reduced to the kept buckets, and fits the machine there. Every document is then scored on its whole text, in one pass
without a shuffle.

Null and empty texts have no terms: their score is the machine's value for what remains (statistics, or the bias).
Repeated rows are scored each on its own; of rows that share an id, one trains (that with the smallest text); labels that repeat for an id count once, as their largest value; null labels
and ids do not train. Extra columns of either table are ignored. With no labels, or labels of one class, the score is
constant.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, fm

#: Labelled documents that are used for fitting, at most.
TRAINING_ROWS = 20_000
#: Standard errors between the classes' rates from which a bucket is kept.
SCREEN = 3.5
TERM_BUCKETS = 1 << 18
#: Passes over the sample.
EPOCHS = 8
#: Beyond the hashed terms: 32 bins for each of up to 32 statistics.
STATISTICS, BINS = 32, 32
BUCKETS = TERM_BUCKETS + STATISTICS * BINS

_ASCII_SEPARATOR = np.zeros(256, bool)
_ASCII_SEPARATOR[:128] = [not chr(i).isalpha() for i in range(128)]

#: What makes rows of features of a slab: (bytes, offsets, metadata) -> (bucket, pointer to each row's first).
Features = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _distinct(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of each text from its terms' hashes."""
    n = len(first) - 1
    row = np.repeat(np.arange(n, dtype=np.uint64), np.diff(first))
    pairs = np.unique(row << np.uint64(18) | hashes & np.uint64(TERM_BUCKETS - 1))
    return (pairs & np.uint64(TERM_BUCKETS - 1)).astype(np.int64), np.searchsorted(pairs >> np.uint64(18), np.arange(n + 1, dtype=np.uint64))


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sparse rows side by side."""
    n = len(parts[0][1]) - 1
    row = np.concatenate([np.repeat(np.arange(n), np.diff(ptr)) for _, ptr in parts])
    order = np.argsort(row, kind="stable")
    return np.concatenate([x for x, _ in parts])[order], sum(ptr for _, ptr in parts)


def toxic_features(data: np.ndarray, offs: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed terms: runs of letters, and their beginnings of 5 to 8 bytes for inflected forms."""
    starts, ends, first = common.word_spans(data, offs, _ASCII_SEPARATOR)
    parts = [_distinct(common.span_hashes(data, starts, ends), first)]
    for size in (5, 6, 7, 8):
        parts.append(_distinct(common.mix(common.span_hashes(data, starts, np.minimum(ends, starts + size)) + np.uint64(size)), first))
    return _joined(parts)


_CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "symbol": b"#*$%&|<>", "bar": b"|", "mark": b"!?", "stop": b".,;:", "quote": b"'\"()[]{}", "high": range(128, 256), "other": b"@_=+-/\\^~`"}
_CLASS = np.zeros((256, len(_CLASSES)), np.float64)
for _i, _members in enumerate(_CLASSES.values()):
    _CLASS[list(_members), _i] = 1


def quality_features(data: np.ndarray, offs: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words, statistics of structure in logarithmic bins, and the length column as metadata."""
    n = len(offs) - 1
    low = common.lowered(data)
    starts, ends, first = common.word_spans(low, offs)
    hashes = common.span_hashes(low, starts, ends)
    words, ptr = _distinct(hashes, first)
    size, count = np.diff(offs).astype(float), np.diff(first).astype(float)
    per = lambda x, by: x / np.maximum(by, 1)
    of = lambda table: np.diff(np.concatenate([[0.0], np.cumsum(table[data])])[offs])
    some = [per(of(_CLASS[:, i]), size) for i in range(_CLASS.shape[1])]
    lines = of((np.arange(256) == 10).astype(float)) + (size > 0)
    longest = np.zeros(n)
    full = np.flatnonzero(first[1:] > first[:-1])
    if len(full):
        longest[full] = np.maximum.reduceat(ends - starts, first[full])
    again = np.concatenate([[False], hashes[1:] == hashes[:-1]]) if len(hashes) else np.zeros(0, bool)
    again[first[:-1][first[:-1] < len(again)]] = False  # a text's first word has none before it
    repeats = np.diff(np.concatenate([[0], np.cumsum(again)])[first])
    heads = np.concatenate([[0], np.cumsum((low[starts] != data[starts]).astype(np.int64))])[first] if len(starts) else np.zeros(n + 1)
    some += [per(np.diff(ptr).astype(float), count), per(repeats, count), per(np.diff(heads), count), per(size, 16 * count), per(longest, 64), per(count, 64 * lines)]
    bins = [np.minimum(np.log2(1 + 2047 * np.clip(x, 0, 1)) * 2, BINS - 1).astype(np.int64) for x in some]
    bins += [np.minimum(np.log2(1 + x), BINS - 1).astype(np.int64) for x in (size, count, lines, np.maximum(meta, 0))]
    stats = np.stack([TERM_BUCKETS + i * BINS + b for i, b in enumerate(bins)], 1)
    return _joined([(words, ptr), (stats.reshape(-1), np.arange(n + 1) * stats.shape[1])])


def _texts(docs: DataFrame, lower: bool) -> DataFrame:
    text = F.lower("text") if lower else F.col("text")
    meta = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.length("text").cast("double")
    return docs.select("doc_id", text.cast("binary").alias("text"), F.coalesce(meta, F.lit(0.0)).alias("meta"))


def _batches(batches: Iterator[pa.RecordBatch], features: Features):
    for batch in batches:
        text, meta = batch.column("text"), batch.column("meta").to_numpy(zero_copy_only=False)
        for at, end, data, offs in common.slabs(text):
            yield batch, at, end, *features(data, offs, meta[at:end])


def training_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, most: int = TRAINING_ROWS) -> DataFrame:
    """The documents (with `label`) that training sees: at most `most`, the smallest by a hash of the id; of rows that share an id, one."""
    some = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (common.crc_rest("doc_id", modulus) != held))
    some = some.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    some = some.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(most)
    rows = docs.join(F.broadcast(some), "doc_id")  # at most `most` rows of 12 bytes
    one = F.min(F.struct("text", "meta", "label")).alias("x")
    return common.cut(rows.groupBy("doc_id").agg(one).select("doc_id", "x.*"))


def train(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, features: Features, lower: bool, most: int = TRAINING_ROWS) -> tuple[fm.Machine, np.ndarray]:
    """A machine, and the weight of each bucket (0: not used)."""
    common.ship(docs.sparkSession)
    sample = training_rows(_texts(docs, lower), labels.select("doc_id", label), label, modulus, held, most)

    def counts(batches):
        total = np.zeros((2, BUCKETS + 1), np.int64)
        for batch, at, end, index, ptr in _batches(batches, features):
            y = batch.column("label").to_numpy(zero_copy_only=False)[at:end].clip(0, 1)
            row = np.repeat(y, np.diff(ptr))
            for k in (0, 1):
                total[k, :BUCKETS] += np.bincount(index[row == k], minlength=BUCKETS)
                total[k, BUCKETS] += (y == k).sum()
        for k in (0, 1):
            used = np.flatnonzero(total[k])
            yield pa.RecordBatch.from_arrays([pa.array(used * 2 + k), pa.array(total[k][used])], ["key", "n"])

    total = np.zeros((BUCKETS + 1, 2))
    found = sample.mapInArrow(common.tidy(counts), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    total.reshape(-1)[found["key"].to_numpy()] = found["n"].to_numpy()
    zeros, ones = total[BUCKETS]
    if not zeros or not ones:
        return fm.fit(np.zeros(0, np.int64), np.zeros(0), np.zeros(int(zeros + ones) + 1, np.int64), np.full(int(zeros + ones), float(ones > 0)), BUCKETS), np.zeros(BUCKETS)
    both = total[:BUCKETS].sum(1)
    rate = (both + 0.5) / (zeros + ones + 1)
    z = (total[:BUCKETS, 1] / ones - total[:BUCKETS, 0] / zeros) / np.sqrt(rate * (1 - rate) * (1 / ones + 1 / zeros))
    weight = np.where((np.abs(z) >= SCREEN) & (both >= 4), np.minimum(np.abs(z), 12) / 12, 0)
    weight[TERM_BUCKETS:][both[TERM_BUCKETS:] > 0] = 1

    def kept(batches):
        for batch, at, end, index, ptr in _batches(batches, features):
            own = weight[index] > 0
            edge = np.concatenate([[0], np.cumsum(own)])[ptr]
            ids = batch.column("doc_id").slice(at, end - at)
            lists = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(index[own], pa.int32()))
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), batch.column("label").slice(at, end - at).cast(pa.int32()), lists], ["doc_id", "label", "index"])

    rows = sample.mapInArrow(common.tidy(kept), "doc_id long, label int, index array<int>").toArrow().combine_chunks()
    lists = rows["index"].combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0)
    flat, edge = lists.values.to_numpy(), lists.offsets.to_numpy().astype(np.int64)
    digest = fm.row_sums(common.mix(flat.astype(np.uint64)) >> np.uint64(24), edge)
    order = np.lexsort((digest, rows["doc_id"].to_numpy()))  # the same order whatever the partitions
    lens = np.diff(edge)[order]
    ptr = np.concatenate([[0], np.cumsum(lens)])
    index = flat[np.repeat(edge[:-1][order] - ptr[:-1], lens) + np.arange(ptr[-1])].astype(np.int64)
    label_of = rows["label"].to_numpy()[order].clip(0, 1).astype(float)
    machine = fm.fit(index, weight[index], ptr, label_of, BUCKETS, epochs=EPOCHS, factor_decay=1e-3)
    return machine, weight


def _scorer(model: tuple[fm.Machine, np.ndarray]):
    """Scores of rows of buckets. Only the kept buckets are sent along: they are 2**18 at most."""
    machine, weight = model
    used = np.flatnonzero(weight)
    place = np.zeros(BUCKETS, np.int32)
    place[used] = np.arange(1, len(used) + 1)
    small = fm.Machine(machine.bias, np.concatenate([[0], machine.linear[used]]), np.concatenate([np.zeros((1, machine.factors.shape[1])), machine.factors[used]]))
    value = np.concatenate([[0], weight[used]])

    def scores(index: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        own = place[index]
        hit = own > 0
        return small.scores(own[hit], value[own[hit]], np.concatenate([[0], np.cumsum(hit)])[ptr])

    return scores


def score(docs: DataFrame, model: tuple[fm.Machine, np.ndarray], features: Features, lower: bool) -> DataFrame:
    """doc_id and score of every row."""
    common.ship(docs.sparkSession)
    scorer = _scorer(model)

    def scored(batches):
        for batch, at, end, index, ptr in _batches(batches, features):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, end - at).cast(pa.int64()), pa.array(scorer(index, ptr))], ["doc_id", "score"])

    return _texts(docs, lower).mapInArrow(common.tidy(scored), "doc_id long, score double")


def train_quality(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1):
    return train(docs, labels, "quality", modulus, held, quality_features, False)


def kept(docs: DataFrame, model: tuple[fm.Machine, np.ndarray], least: float = 0.5) -> DataFrame:
    """The rows whose quality scores `least` or more, with all their columns: one pass, rows go by as they are scored."""
    common.ship(docs.sparkSession)
    scorer = _scorer(model)
    columns = docs.columns
    meta = "n_chars" in columns

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            text = batch.column("text").cast(pa.string())
            size = pc.fill_null(batch.column("n_chars").cast(pa.float64()) if meta else pc.utf8_length(text).cast(pa.float64()), 0).to_numpy(zero_copy_only=False)
            good = np.zeros(n, bool)
            for at, end, data, offs in common.slabs(text):
                good[at:end] = scorer(*quality_features(data, offs, size[at:end])) >= least
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(common.tidy(run), docs.schema)


def quality(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1) -> DataFrame:
    """Score of every document's quality, fitted on labels outside the held-out remainder."""
    return score(docs, train_quality(docs, labels, modulus, held), quality_features, False)


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0) -> DataFrame:
    """Score of every document's toxicity, fitted on labels outside the held-out remainder."""
    return score(docs, train(docs, labels, "toxic", modulus, held, toxic_features, True), toxic_features, True)


def _contract(scores: DataFrame, modulus: int, held: int) -> DataFrame:
    return scores.select("doc_id", (common.crc_rest("doc_id", modulus) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op1_quality(spark, sf_dir: str) -> DataFrame:
    return _contract(quality(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")), 3, 1)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    return _contract(toxicity(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")), 5, 0)
