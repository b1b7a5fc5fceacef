"""Operator 11: spelling variants by forward and reversed sorted dictionaries.

Words. Maximal runs of ASCII letters and U+00C0 to U+00FF, lower-cased in A-Z only, one code point deleted where the
contract's crc32 says so, counted over all documents; those of `LEAST_LENGTH` code points and `LEAST_COUNT` occurrences
make the dictionary. Counts are added up within each worker before the shuffle, so that a frequent word costs a row for
each task and not for each occurrence.

Near words. Of two words at one edit, the shorter with m code points, the common prefix and the common suffix have m - 1
code points together at least, so that one of them has m // 2: a half is intact. Each word stands, for both lengths that
the shorter one may have, in the forward dictionary under its first half and in the reversed one under its last half.
Both are sorted by range, and blocks of words that share a half are scanned in order. A block of over `BLOCK` words is
subdivided: the middle, which is not shared yet, has an intact half as well, and the words go on with that half added to
the prefix or to the suffix, until blocks are small or the middle is one code point, of which there are 90. A pair is
verified in the one block that its common prefix leads to (`cap`), so that no pair counts twice. Blocks give one row for
each word with its number of near words and the best of them; pairs are not written.

Forms. A word's form is its most frequent near word if that is at least twice as frequent; ties go to the smaller in
code-point order. Counts double along forms, so that there is no circle, and roots are found by pointers that jump.

Null texts have no words; a null doc_id counts as the empty text in front of the colon; repeated rows count each. Words
may be of any length. Extra columns are ignored. An empty table, or one without words, gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LEAST_LENGTH, LEAST_COUNT = 5, 3
#: The contract's deletions: of the code point at `h % length`, where this divides h.
DELETED = 97
#: Words of a block that is not subdivided.
BLOCK = 256
#: Words that a worker counts before it passes counts on.
COUNTED = 300_000
#: Blocks to subdivide up to which their keys are broadcast; beyond, the join is a shuffle.
BROADCAST_BLOCKS = 100_000

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def runs(data: np.ndarray, offs: np.ndarray):
    """Words of each text of a slab, lower-cased, as lists of bytes."""
    solid = _LETTER[data]
    pair = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] & 0xC0 == 0x80))  # U+00C0 to U+00FF, and nothing else
    solid[pair] = solid[pair + 1] = True
    raw = np.where(solid, common.lowered(data), 32).astype(np.uint8).tobytes()
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        yield raw[a:b].split()


def _changed(word: bytes, h: int) -> bytes:
    text = word.decode()
    place = h % len(text)
    return (text[:place] + text[place + 1 :]).encode()


def dictionary(docs: DataFrame, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """word and n of all words that are long and frequent enough."""

    def run(batches):
        counts: Counter = Counter()

        def full():
            words = [w for w in counts if len(w) - w.count(b"\xc3") >= LEAST_LENGTH]
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array([counts[w] for w in words], pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            ids = batch.column("id").to_pylist()
            for at, end, data, offs in common.slabs(batch.column("text")):
                for id_, words in zip(ids[at:end], runs(data, offs), strict=True):
                    start = zlib.crc32(b"%b:" % (b"" if id_ is None else id_.encode()))
                    own = Counter(words)
                    for w in [w for w in own if not zlib.crc32(w, start) % DELETED]:
                        counts[_changed(w, zlib.crc32(w, start))] += own.pop(w)
                    counts.update(own)
                if len(counts) > COUNTED:
                    yield full()
        yield full()

    common.ship(docs.sparkSession)
    rows = docs.select(F.col(id_).cast("string").alias("id"), F.col(text).cast("binary").alias("text"))
    counted = rows.mapInArrow(common.tidy(run), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


_KEY = ["m", "cap", "prefix", "suffix"]


def _keyed(entries: DataFrame) -> DataFrame:
    """Entries (word, n, m, p, s, cap) with the prefix of p and the suffix of s code points."""
    return entries.withColumn("prefix", F.expr("left(word, p)")).withColumn("suffix", F.expr("right(word, s)"))


def _children(entries: DataFrame) -> DataFrame:
    """Each entry twice: half of the middle goes to the prefix, or to the suffix; then it must not be common as a prefix."""
    half = F.floor((F.col("m") - F.col("p") - F.col("s")) / 2).cast("int")
    forward = F.struct((F.col("p") + half).alias("p"), F.col("s").alias("s"), F.col("cap").alias("cap"))
    reverse = F.struct(F.col("p").alias("p"), (F.col("s") + half).alias("s"), F.least(F.col("cap"), F.col("p") + half).alias("cap"))
    return entries.select("word", "n", "m", F.explode(F.array(forward, reverse)).alias("x")).select("word", "n", "m", "x.*")


def blocks(words: DataFrame) -> DataFrame:
    """Entries of all blocks, none of which is both large and divisible."""
    size = F.length("word")
    start = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("m"))
    open_ = _keyed(_children(start.select("word", "n", "m", F.lit(0).alias("p"), F.lit(0).alias("s"), (F.col("m") + 1).alias("cap"))))
    done = None
    while True:
        large = open_.where("m - p - s > 1").groupBy(*_KEY).count().where(F.col("count") > BLOCK).select(*_KEY)
        large = common.cut(large)
        n = large.count()
        if not n:
            return open_ if done is None else done.unionByName(open_)
        few = F.broadcast(large) if n <= BROADCAST_BLOCKS else large
        small = open_.join(few, _KEY, "left_anti").select(open_.columns)
        done = small if done is None else done.unionByName(small)
        open_ = _keyed(_children(open_.join(few, _KEY, "left_semi").drop("prefix", "suffix")))
        open_ = common.cut(open_)


def _points(words: list[str], size: int, start: int, end: int) -> np.ndarray:
    """Code points of the middles of words of one length."""
    return np.array([w[start : size - end] for w in words], f"<U{max(1, size - end - start)}").view(np.uint32).reshape(len(words), -1)


def _common(a: np.ndarray, b: np.ndarray, columns: range, shift: int) -> np.ndarray:
    """How many of the columns, in this order, agree before the first that doesn't; those of b are shifted."""
    alive = np.ones((len(a), len(b)), bool)
    out = np.zeros((len(a), len(b)), np.int32)
    for c in columns:
        alive &= a[:, c, None] == b[None, :, c + shift]
        if not alive.any():
            break
        out += alive
    return out


def scan(words: list[str], n: np.ndarray, m: int, p: int, s: int, cap: int) -> list[tuple[int, int, int]]:
    """(index, number of near words, index of the best one) from one block whose words are in code-point order."""
    size = np.array([len(w) for w in words])
    short, long_ = np.flatnonzero(size == m), np.flatnonzero(size == m + 1)
    out = []
    if not len(short):
        return out
    middle = m - p - s
    a = _points([words[i] for i in short], m, p, s)
    for other, extra in ((short, 0), (long_, 1)):
        if len(other) < 2 - extra:
            continue
        b = a if not extra else _points([words[i] for i in other], m + 1, p, s)
        columns = range(middle)
        lead, trail = _common(a, b, columns, 0), _common(a, b, columns[::-1], extra)
        near = (lead + trail >= middle - 1 + extra) & (lead + p < cap)
        if not extra:
            np.fill_diagonal(near, False)
        for hit, own, others in ((near, short, other), *(((near.T, other, short),) if extra else ())):
            count = hit.sum(1)
            best = np.where(hit, n[others][None, :], -1).argmax(1)  # the first of the largest is the smallest word
            out += [(int(own[i]), int(count[i]), int(others[best[i]])) for i in np.flatnonzero(count)]
    return out


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best_n and best of each word that has near words; words: word, n."""

    def run(batches):
        held = None

        def scanned(t: pa.RecordBatch, cuts: list[int]):
            names, n = t.column("word").to_pylist(), t.column("n").to_numpy()
            m, p, s, cap = (t.column(c).to_numpy().tolist() for c in ("m", "p", "s", "cap"))
            rows = [], [], [], []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b - a > 1:
                    for i, count, best in scan(names[a:b], n[a:b], m[a], p[a], s[a], cap[a]):
                        for column, x in zip(rows, (names[a + i], count, n[a + best], names[a + best]), strict=True):
                            column.append(x)
            return pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(rows, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "n_near", "best_n", "best"])

        for batch in batches:
            batch = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            if not batch.num_rows:
                continue
            keys = list(zip(*(batch.column(c).to_pylist() for c in _KEY), strict=True))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1])]
            held = batch.slice(cuts[-1])  # its block may go on
            yield scanned(batch, cuts)
        if held is not None:
            yield scanned(held, [0, held.num_rows])

    common.ship(words.sparkSession)
    entries = blocks(words)
    ordered = entries.repartitionByRange(common.n_tasks(words.sparkSession), *_KEY).sortWithinPartitions(*_KEY, "word")
    found = ordered.mapInArrow(common.tidy(run), "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("least"), "best")).alias("x")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("x.least")).alias("best_n"), F.col("x.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root: the end of each word's chain of forms; forms: word, form."""
    up = common.cut(forms.select("word", F.col("form").alias("up")))
    while True:
        step = up.join(up.select(F.col("word").alias("up"), F.col("up").alias("next")), "up", "left")
        step = common.cut(step.select("word", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")))
        if step.where("moved").isEmpty():
            return step.select("word", F.col("up").alias("root"))
        up = step.select("word", "up")


def variants(docs: DataFrame, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """word, n, n_near, form, form_n and root of all words of the documents."""
    words = common.cut(dictionary(docs, text, id_))
    found = words.join(near_words(words), "word", "left")
    frequent = F.col("best_n") >= 2 * F.col("n")
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(frequent, F.col("best")).alias("form"), F.when(frequent, F.col("best_n")).alias("form_n"))
    found = common.cut(found)
    ends = roots(found.where("form is not null").select("word", "form"))
    return found.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word")).select("word", "form", "root", "n", "n_near", "form_n")


def op11_spelling(spark, sf_dir: str) -> DataFrame:
    return variants(common.table(spark, sf_dir, "documents"))


def oracle() -> str:
    """The contract in SQL: crc32 bit by bit, near words by the results of deletions."""
    return f"""
WITH RECURSIVE found AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS w FROM documents
), own AS (
  SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n FROM found GROUP BY ALL
), hashed AS (
  SELECT w, n, xor(4294967295, list_reduce([4294967295] || flatten(list_transform(string_split(coalesce(doc_id::varchar, '') || ':' || w, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::bigint] || bits ELSE [195::bigint] || bits || [unicode(x)::bigint - 64] || bits END)),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS h FROM own, (SELECT list_transform(range(8), lambda i: -1::bigint) AS bits)
), words AS (
  SELECT w AS word, sum(n)::bigint AS n FROM (SELECT CASE WHEN h % {DELETED} = 0 THEN substring(w, 1, (h % length(w))::bigint) || substring(w, (h % length(w))::bigint + 2) ELSE w END AS w, n FROM hashed) WHERE length(w) >= {LEAST_LENGTH} GROUP BY ALL HAVING sum(n) >= {LEAST_COUNT}
), cuts AS (
  SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rest FROM words, unnest(range(1, length(word) + 1)) u(i)
), near AS (
  SELECT a.word, b.word AS other, b.n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON c.rest = w.word
), best AS (
  SELECT word, count(*)::bigint AS n_near, max(n) AS top, (list(other ORDER BY n DESC, other))[1] AS other FROM near GROUP BY word
), forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(b.n_near, 0)::bigint AS n_near, CASE WHEN b.top >= 2 * w.n THEN b.other END AS form, CASE WHEN b.top >= 2 * w.n THEN b.top END AS form_n FROM words w LEFT JOIN best b USING (word)
), chain AS (
  SELECT word, word AS root, form FROM forms UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON c.form = f.word
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n::bigint AS form_n FROM forms f JOIN chain c ON c.word = f.word AND c.form IS NULL"""
