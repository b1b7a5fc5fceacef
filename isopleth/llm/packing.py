"""Operator 13: packing of documents into sequences by patterns, fitted by non-negative least squares.

Pieces. Each document's ids, with the end id, are cut into pieces of `SEQUENCE` ids only where they are longer. A task
numbers its pieces of each length; the numbers of all tasks before it are added by a small join, so that every piece has
its number among all pieces of its length without a shuffle of ids.

Plan. The histogram of lengths (one number for each length up to `SEQUENCE`) is all that the driver sees. Patterns are
all sets of up to `DOCUMENTS` lengths of the histogram that fill a sequence exactly. Their repeat counts are fitted to
the histogram by non-negative least squares (accelerated projected gradients, the patterns being sparse), rounded down,
and held within what is there. What is left of the histogram is packed longest first into the fullest sequence that has
room, with whole counts at once, so that the plan takes as long for any number of documents. A plan is a list of
sequence forms, each a few runs of equal lengths, with its number of repeats.

Places. Runs are laid out by length: a piece's number among its length tells the form, the repeat and the place in the
run, by a search in the plan's table, whose size is bounded by the lengths.

Null texts count as empty: a document has its end id at least. Repeated rows are packed each; null ids stay null. Texts
of any length are encoded whole. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, idfile

SEQUENCE, END_ID = 2048, 0
#: Documents of a pattern, at most, and steps of the fit.
DOCUMENTS, STEPS = 3, 300
#: Offsets (one for each task and length) up to which they are broadcast; beyond, the join is a shuffle.
BROADCAST_OFFSETS = 500_000

_PIECE = "doc_id long, piece int, start long, length int, ids binary, part int, number long"


def pieces(docs: DataFrame, path: str | None = None, size: int = SEQUENCE, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids (little-endian 32-bit), part, and number in part and length."""

    def run(batches):
        part, words = TaskContext.get().partitionId(), idfile.library(path)
        seen = np.zeros(size + 1, np.int64)
        end = np.array([END_ID], "<u4")
        for batch in batches:
            for at, upto, data, offs in common.slabs(batch.column("text")):
                own, numbers, starts, lengths, blobs, places = batch.column("id").slice(at, upto - at), [], [], [], [], []
                for row, ids in enumerate(words.encode(data, offs)):
                    n = len(ids) + 1
                    raw = ids.astype("<u4", copy=False).tobytes() + end.tobytes()
                    for piece, start in enumerate(range(0, n, size)):
                        length = min(size, n - start)
                        numbers.append(row)
                        places.append(piece)
                        starts.append(start)
                        lengths.append(length)
                        blobs.append(raw[4 * start : 4 * (start + length)])
                length = np.array(lengths, np.int64)
                # numbers within each length go on from the slabs before
                order = np.argsort(length, kind="stable")
                ordered = length[order]
                first = np.searchsorted(ordered, ordered)
                number = np.empty(len(length), np.int64)
                number[order] = seen[ordered] + np.arange(len(length)) - first
                seen += np.bincount(length, minlength=size + 1)
                columns = [own.take(pa.array(numbers, pa.int64())), pa.array(places, pa.int32()), pa.array(starts, pa.int64()), pa.array(length, pa.int32()), pa.array(blobs, pa.binary()), pa.array(np.full(len(length), part), pa.int32()), pa.array(number)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids", "part", "number"])

    common.ship(docs.sparkSession)
    rows = docs.select(F.col(id_).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(common.tidy(run), _PIECE)


def patterns(lengths: np.ndarray, size: int = SEQUENCE) -> np.ndarray:
    """All sets of one, two or three of these lengths, descending, that fill a sequence; unused places are 0."""
    there = np.zeros(size + 1, bool)
    there[lengths] = True
    out = [np.array([[size, 0, 0]])] if there[size] else []
    lengths = np.sort(lengths)
    half = lengths[(2 * lengths >= size) & (lengths < size)]
    half = half[there[size - half]]
    out.append(np.stack([half, size - half, np.zeros_like(half)], 1))
    for a in lengths[(3 * lengths >= size) & (lengths < size)].tolist():
        b = lengths[(lengths <= a) & (2 * lengths >= size - a) & (lengths < size - a)]
        b = b[there[size - a - b]]
        out.append(np.stack([np.full_like(b, a), b, size - a - b], 1))
    return np.concatenate(out).astype(np.int64)


def fit(histogram: np.ndarray, found: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Non-negative repeat counts of patterns whose lengths sum to the histogram, by least squares."""
    if not len(found):
        return np.zeros(0)
    scale = float(histogram.max())
    wanted = histogram.astype(float) / scale
    wanted[0] = 0

    def made(x: np.ndarray) -> np.ndarray:
        out = np.bincount(found.reshape(-1), np.repeat(x, found.shape[1]), len(histogram))
        out[0] = 0  # unused places
        return out

    def back(r: np.ndarray) -> np.ndarray:
        return r[found].sum(1)

    x = np.ones(len(found)) / np.sqrt(len(found))
    for _ in range(12):  # the largest eigenvalue, for the step
        x = back(made(x))
        top = np.linalg.norm(x)
        x /= top
    step = 1 / (1.05 * top)
    x, y, t = np.zeros(len(found)), np.zeros(len(found)), 1.0
    for _ in range(steps):
        new = np.maximum(0, y - step * back(made(y) - wanted))
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / after * (new - x)
        x, t = new, after
    return x * scale


def residual_forms(left: np.ndarray, size: int = SEQUENCE) -> list[tuple[list[tuple[int, int]], int]]:
    """Sequence forms (runs of (length, times), repeats) of a histogram: longest first, into the fullest that has room."""
    room: list[list] = [[] for _ in range(size + 1)]  # forms by what is free
    room[size] = None
    for length in np.flatnonzero(left)[::-1].tolist():
        count = int(left[length])
        for free in range(length, size):
            if not count:
                break
            forms, room[free] = room[free], []
            times = free // length
            while forms and count:
                runs, repeats = forms.pop()
                many = min(repeats, count // times)
                if many:
                    room[free - times * length].append((runs + [(length, times)], many))
                    count -= many * times
                    repeats -= many
                if repeats and count and count < times:
                    room[free - count * length].append((runs + [(length, count)], 1))
                    count, repeats = 0, repeats - 1
                if repeats:
                    forms.append((runs, repeats))
            room[free] += forms
        times = size // length
        if count >= times:
            room[size - times * length].append(([(length, times)], count // times))
        if count % times:
            room[size - count % times * length].append(([(length, count % times)], 1))
    return [form for forms in room[:size] for form in forms]


def plan(histogram: np.ndarray, size: int = SEQUENCE) -> list[tuple[list[tuple[int, int]], int]]:
    """Sequence forms, each with its runs of (length, times) and its repeats, that use up the histogram exactly."""
    found = patterns(np.flatnonzero(histogram), size)
    repeats = np.floor(fit(histogram, found) + 1e-6).astype(np.int64)
    left, forms = histogram.copy(), []
    for i in np.argsort(-repeats, kind="stable").tolist():
        if not repeats[i]:
            break
        runs = {}
        for length in found[i].tolist():
            if length:
                runs[length] = runs.get(length, 0) + 1
        many = min(int(repeats[i]), *(int(left[x]) // times for x, times in runs.items()))
        if many:
            forms.append((list(runs.items()), many))
            for x, times in runs.items():
                left[x] -= many * times
    return forms + residual_forms(left, size)


def places(forms: list[tuple[list[tuple[int, int]], int]]) -> tuple[np.ndarray, ...]:
    """Of each run of each form, in order of lengths: key of its first piece, first sequence, times, and offset.

    The key is the length, shifted, and the number of the first piece among those of the length.
    """
    rows, base = [], 0
    for runs, repeats in forms:
        offset = 0
        for length, times in runs:
            rows.append((length, base, times, offset, repeats * times))
            offset += length * times
        base += repeats
    rows = np.array(rows, np.int64).reshape(-1, 5)
    rows = rows[np.argsort(rows[:, 0], kind="stable")]
    before = np.cumsum(rows[:, 4]) - rows[:, 4]
    before -= before[np.searchsorted(rows[:, 0], rows[:, 0])] if len(rows) else 0
    return (rows[:, 0] << 44) + before, rows[:, 1], rows[:, 2], rows[:, 3]


def packed(docs: DataFrame, path: str | None = None, size: int = SEQUENCE, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """Every piece with its ids and its place: doc_id, piece, start, length, ids, sequence_id, offset."""
    each, _ = common.stored(pieces(docs, path, size, text, id_), "pieces")
    parts = common.cut(each.groupBy("length", "part").agg(F.count("*").alias("n")))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    histogram = np.zeros(size + 1, np.int64)
    for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # one row for each length
        histogram[r["length"]] = r["n"]
    key, base, times, offset = places(plan(histogram, size))

    def run(batches):
        for batch in batches:
            length, number = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "number"))
            at = np.searchsorted(key, (length << 44) + number, side="right") - 1
            within = (length << 44) + number - key[at]
            found = [pa.array(base[at] + within // times[at]), pa.array(offset[at] + within % times[at] * length)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *found], [*kept, "sequence_id", "offset"])

    kept = ["doc_id", "piece", "start", "length", "ids"]
    offsets = F.broadcast(offsets) if parts.count() <= BROADCAST_OFFSETS else offsets
    numbered = each.join(offsets, ["length", "part"]).select(*kept, (F.col("number") + F.col("before")).alias("number"))
    numbered = numbered.withColumn("length", F.col("length").cast("long"))
    return numbered.mapInArrow(common.tidy(run), "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long")


def sequences(rows: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """sequence_id, the doc_ids and lengths of its pieces in order, and its ids in one piece; rows: of `packed`.

    A sequence has at most `size` pieces, so that no group grows with the table.
    """
    own = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", F.hex("ids").alias("ids"))))
    whole = rows.groupBy("sequence_id").agg(own.alias("x"))
    return whole.select("sequence_id", F.col("x.doc_id").alias("doc_ids"), F.col("x.length").alias("lengths"), F.unhex(F.array_join("x.ids", "")).alias("ids"))


def op13_packing(spark, sf_dir: str) -> DataFrame:
    rows = packed(common.table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
