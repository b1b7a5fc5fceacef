"""Operator 8: token ids in files of canonical, length-limited Huffman code.

Documents are put in ascending order of id by a range shuffle of their texts, each partition is tokenised once, and its
ids are kept compressed in the shared folder. From there: global counts of the ids (one number for each id of the
vocabulary), code lengths by package-merge on the driver, and blocks written as Parquet rows. A block holds whole
documents, about `BLOCK_IDS` ids, and decodes without any other block: its payload is the code words most significant
bit first, with the bit offset of every `STEP`-th id as checkpoints. Lengths of the code are one small table beside the
blocks; the code itself is canonical (ordered by length, then id).

The decoder goes through all checkpoints of a block in step: each lane looks up the next `limit` bits in a table that
gives the id and its length.

Null texts count as empty, so a document has its end id at least. Rows with equal doc_id follow each other in the order
of their texts' hashes; null doc_ids come first. A text of any length is in one block. Extra columns are ignored. An
empty table gives files without blocks and an empty result.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common

END_ID = 1
BLOCK_IDS = 1 << 17
STEP = 128
#: Longest code word in bits; the decoding table has 2**limit entries.
LIMIT = 18

#: Units that a worker remembers in each of two generations.
UNITS = 300_000

_CODEC = "zstd"


class LibraryIds:
    """Ids from the tokenizers library, with the units it is given remembered.

    Units stand between white space, and full stops and commas are units of their own: for a tokenizer that drops white
    space both cuts are exact (see `bpe`), the second where no other mark touches the stop or comma. Of new units those of letters only are one
    pre-token each, which ends with the only token that has the word end; they are encoded together as one text, and the
    ids cut there. Other texts are cut into runs of letters and of marks, which is exact without apostrophes, parts of
    special tokens and characters beyond ASCII that are no letters; with one of those, at white space only.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        # the same model for units that are normalised already, one pre-token each, and in the characters of their bytes
        self.normal = Tokenizer(self.library.model)
        self.normal.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        characters = bpe.byte_characters()
        characters[32] = " "
        self.characters = "".join(characters)
        suffix = self.library.model.end_of_word_suffix
        vocab = self.library.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for x, i in vocab.items() if x.endswith(suffix)]] = True
        self.units, self.older = {}, {}  # the older generation goes when the younger is full
        self.words: dict[bytes, bytes] = {}

    def _each(self, parts: list[bytes]) -> list[bytes]:
        found = self.library.encode_batch_fast([x.decode("utf-8", "replace") for x in parts], add_special_tokens=False) if parts else []
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _learn(self, new: list[bytes]) -> None:
        letters, normal, odd = [], [], []
        for unit in new:
            if unit.isalpha():  # ASCII, in lower case
                letters.append(unit)
                normal.append(unit)
                continue
            text = unicodedata.normalize("NFC", unit.decode("utf-8", "replace"))
            low = text.lower()
            if "\u03a3" not in text and low.isalpha():  # sigma: the library lowers each letter on its own
                letters.append(unit)
                normal.append(low.encode())
            else:
                odd.append(unit)
        parts = [b" ".join(normal[i : i + 256]).decode("latin-1").translate(self.characters) for i in range(0, len(normal), 256)]
        ids = np.array([i for x in self.normal.encode_batch_fast(parts, add_special_tokens=False) for i in x.ids], "<u4")
        cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
        if len(cuts) == len(letters):
            raw, last = ids.tobytes(), 0
            for unit, cut in zip(letters, cuts, strict=True):
                self.units[unit] = raw[last : 4 * cut]
                last = 4 * cut
        else:  # not expected; one by one is always right
            self.units.update(zip(letters, self._each(letters), strict=True))
        # beside a character beyond ASCII that is no letter, a mark would not be a pre-token of its own
        self.units.update((x, y if x.isascii() else None) for x, y in zip(odd, self._each(odd), strict=True))

    def _by_words(self, text: bytes) -> np.ndarray:
        split = text.split()
        if len(self.words) > UNITS // 8:
            self.words.clear()
        new = list({w for w in split if w not in self.words})
        self.words.update(zip(new, self._each(new), strict=True))
        out = np.frombuffer(b"".join(map(self.words.__getitem__, split)), "<u4")
        for w in new:
            if len(w) > bpe.REMEMBERED_BYTES:
                del self.words[w]
        return out

    def encode(self, data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
        """Ids of each text of a slab: units are looked up once for each distinct one of the slab."""
        raw, low = data.tobytes(), common.lowered(data).tobytes()
        n = len(offs) - 1
        if not len(data):
            return [np.zeros(0, "<u4")] * n
        stop = _STOP[data]
        touched = np.zeros(len(data), bool)
        touched[:-1] = (stop[:-1] & ~_MAY_FOLLOW[data[1:]]) | (stop[1:] & ~_MAY_PRECEDE[data[:-1]]) | ((data[:-1] == 60) & (data[1:] == 124))
        plain = np.diff(np.concatenate([[0], np.cumsum(touched)])[offs]) == 0
        # plain texts are split together; stops and commas stand between blanks
        spread = low.replace(b".", b" . ").replace(b",", b" , ")
        ends = offs + 2 * np.concatenate([[0], np.cumsum(stop)])[offs]
        texts = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(spread)])
        split = pc.ascii_split_whitespace(texts.filter(pa.array(plain)))
        counts, by_words = np.zeros(n, np.int64), np.zeros(n, bool)
        counts[plain] = split.value_lengths().to_numpy(zero_copy_only=False)
        units = [split.flatten().view(pa.large_binary())]
        # of the others runs of marks are units, but for contractions and special tokens
        runs = []
        for i in np.flatnonzero(~plain).tolist():
            own = low[offs[i] : offs[i + 1]]
            if b"'" in own or b"<|" in own:
                by_words[i] = True
            else:
                found = _RUNS.findall(own)
                counts[i] = len(found)
                runs += found
        units = pa.concat_arrays([*units, pa.array(runs, pa.large_binary())]).dictionary_encode()
        at = units.indices.to_numpy()
        known, size, odd = self._known(units.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids = np.frombuffer(b"".join(known), "<u4")
        # the ids of unit after unit, and where each text's units and ids begin
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        cut = np.concatenate([[0], np.cumsum(counts[order])])
        place = np.concatenate([[0], np.cumsum(size[at])])
        ids = ids[np.repeat((np.cumsum(size) - size)[at] - place[:-1], size[at]) + np.arange(place[-1])]
        # texts with a unit that may not be cut there
        by_words[order] |= np.diff(np.concatenate([[0], np.cumsum(odd[at])])[cut]) > 0
        out = [ids[:0]] * n
        for i, a, b in zip(order.tolist(), place[cut[:-1]].tolist(), place[cut[1:]].tolist(), strict=True):
            out[i] = self._by_words(raw[offs[i] : offs[i + 1]]) if by_words[i] else ids[a:b]
        return out

    def _known(self, found: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Ids of each unit, their number, and which units may not be cut where they are."""
        if len(self.units) > UNITS:
            self.units, self.older = {}, self.units
        units, older = self.units, self.older
        units[b""] = b""  # before and after the blanks at a text's ends
        ids = list(map(units.get, found, repeat(_NEW)))
        places = [i for i, x in enumerate(ids) if x is _NEW]
        new = []
        for i in places:
            unit = found[i]
            if unit in older:
                units[unit] = older[unit]
            else:
                new.append(unit)
        if new:
            self._learn(new)
        for i in places:
            ids[i] = units[found[i]]
        for unit in new:
            if len(unit) > bpe.REMEMBERED_BYTES:
                del units[unit]
        odd = np.zeros(len(ids), bool)
        try:
            size = np.fromiter(map(len, ids), np.int64, len(ids))
        except TypeError:  # units without ids
            odd[:] = [x is None for x in ids]
            ids = [b"" if x is None else x for x in ids]
            size = np.fromiter(map(len, ids), np.int64, len(ids))
        return ids, size // 4, odd


#: Stands for a unit that is not known yet.
_NEW = b"new"

_RUNS = re.compile(rb"[a-z\x80-\xff]+|[0-9]|[^\sa-z0-9\x80-\xff]+")
_STOP = np.zeros(256, bool)
_STOP[[44, 46]] = True
_MAY_FOLLOW = np.zeros(256, bool)
_MAY_FOLLOW[[9, 10, 11, 12, 13, 32, *range(48, 58), *range(65, 91), *range(97, 123)]] = True
_MAY_PRECEDE = _MAY_FOLLOW.copy()
_MAY_PRECEDE[128:] = True


_libraries: dict[str, LibraryIds] = {}


def library(path: str | None) -> LibraryIds:
    path = bpe.tokenizer_path(path)
    if path not in _libraries:
        _libraries[path] = LibraryIds(path)
    return _libraries[path]


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code with no word over `limit` bits (package-merge); 0 for ids that don't occur."""
    counts = np.asarray(counts, np.int64)
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError("limit is too small for so many ids")
    order = used[np.argsort(counts[used], kind="stable")]
    items = counts[order]
    n, level, single = len(items), items, []
    for _ in range(limit - 1):
        packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        merged = np.concatenate([items, packages])
        rank = np.argsort(merged, kind="stable")
        single.append(np.cumsum(rank < n))
        level = merged[rank]
    taken, length = 2 * n - 2, np.zeros(n, np.uint8)
    for own in reversed(single):
        alone = int(own[taken - 1]) if taken else 0
        length[:alone] += 1
        taken = 2 * (taken - alone)
    length[:taken] += 1
    out[order] = length
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Code words by length, then id."""
    out, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        size = lengths[order].astype(np.int64)
        limit = int(size[-1])
        steps = np.uint64(1) << (limit - size).astype(np.uint64)
        first = np.concatenate([[np.uint64(0)], np.cumsum(steps)[:-1]]).astype(np.uint64)
        out[order] = first >> (limit - size).astype(np.uint64)
    return out


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Payload of a block, and the bit offset of every STEP-th id."""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    start = end - size
    n = int(end[-1]) // 32 + 2 if len(ids) else 1
    word, room = start >> 5, 64 - (start & 31) - size
    shifted = codes[ids] << room.astype(np.uint64)
    # words of different ids share no bit, so sums are unions; each sum stays under 2**32
    high = np.bincount(word, (shifted >> np.uint64(32)).astype(np.float64), n)
    low = np.bincount(word + 1, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
    return (high + low).astype(np.uint32).astype(">u4").tobytes(), start[::STEP]


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """For each value of the next `limit` bits the id, shifted by 5, and its length."""
    limit = int(lengths.max(initial=1))
    codes = canonical(lengths)
    order = np.flatnonzero(lengths)
    order = order[np.argsort(codes[order] << (limit - lengths[order]).astype(np.uint64), kind="stable")]
    repeat = 1 << (limit - lengths[order].astype(np.int64))
    table = np.ones(1 << limit, np.uint32)
    table[: repeat.sum()] = np.repeat((order << 5 | lengths[order]).astype(np.uint32), repeat)
    return table, limit


def unpack(payload: bytes, checkpoints: np.ndarray, n: int, table: tuple[np.ndarray, int]) -> np.ndarray:
    """Ids of a block: all lanes between checkpoints advance by one id at a time."""
    found, limit = table
    words = np.frombuffer(payload, ">u4").astype(np.uint64)
    pairs = (words[:-1] << np.uint64(32)) | words[1:]  # the 64 bits from each word on
    pairs = np.concatenate([pairs, [words[-1] << np.uint64(32)], np.zeros(LIMIT + 14, np.uint64)])
    place = checkpoints.astype(np.int64)
    out = np.zeros((STEP, len(place)), np.uint32)
    mask, last = np.int64((1 << limit) - 1), len(words) << 5
    shift = np.int64(64 - limit)
    for step in range(STEP):
        window = (pairs[place >> 5] >> (shift - (place & 31)).view(np.uint64)).view(np.int64) & mask
        both = found[window]
        out[step] = both >> np.uint32(5)
        place += both & np.uint32(31)
        if step % 32 == 31:  # lanes that are past the end stay there
            np.minimum(place, last, out=place)
    return out.T.reshape(-1)[:n]


def _tokenised(docs: DataFrame, path: str | None) -> DataFrame:
    """Chunks of documents in order: partition, doc_ids, their numbers of ids, and the ids compressed."""
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    # texts that share an id, or have none, are dealt by their hashes
    rows = rows.repartitionByRange(common.n_tasks(docs.sparkSession), "doc_id", "hash").sortWithinPartitions("doc_id", "hash").drop("hash")

    def run(batches):
        part, words = TaskContext.get().partitionId(), library(path)
        for batch in batches:
            for at, end, data, offs in common.slabs(batch.column("text"), 1 << 19):
                ids = words.encode(data, offs)
                both = np.concatenate([x for each in ids for x in (each, np.array([END_ID], "<u4"))]).astype("<u4")
                narrow = both.astype("<u2") if both.max() < 1 << 16 else both
                blob = pa.compress(narrow.tobytes(), codec=_CODEC, asbytes=True)
                yield pa.RecordBatch.from_pylist([{"part": part, "doc_ids": batch.column("doc_id").slice(at, end - at).to_pylist(), "sizes": [len(x) + 1 for x in ids], "n": len(both), "width": narrow.itemsize, "ids": blob}], schema=_CHUNK)

    return common.cut(rows.mapInArrow(common.tidy(run), "part int, doc_ids array<long>, sizes array<int>, n long, width int, ids binary"))


_CHUNK = pa.schema([("part", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("n", pa.int64()), ("width", pa.int32()), ("ids", pa.binary())])
_BLOCK = pa.schema([("part", pa.int32()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("n", pa.int64()), ("checkpoints", pa.list_(pa.int64())), ("payload", pa.binary())])
_BLOCK_DDL = "part int, start long, doc_ids array<long>, sizes array<int>, n long, checkpoints array<long>, payload binary"


def _chunk_ids(row: dict) -> np.ndarray:
    raw = pa.decompress(row["ids"], decompressed_size=row["n"] * row["width"], codec=_CODEC, asbytes=True)
    return np.frombuffer(raw, f"<u{row['width']}").astype(np.int64)


def write(docs: DataFrame, out: str, path: str | None = None) -> None:
    """Write the files of a table of documents (doc_id, text) below `out`: `codes` and `blocks`."""
    common.ship(docs.sparkSession)
    spark = docs.sparkSession
    chunks = _tokenised(docs, path)

    def counts(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                own = np.bincount(_chunk_ids(row), minlength=len(total))
                own[: len(total)] += total
                total = own
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    found = chunks.select("n", "width", "ids").mapInArrow(common.tidy(counts), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # one row for each id of the vocabulary
    total = np.zeros(int(found["id"].to_numpy().max()) + 1 if len(found) else 0, np.int64)
    total[found["id"].to_numpy()] = found["n"].to_numpy()
    lengths = code_lengths(total)
    codes = canonical(lengths)
    # one number for each partition: where its ids begin
    parts = chunks.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").toPandas()
    begins = dict(zip(parts["part"].tolist(), (parts["n"].cumsum() - parts["n"]).tolist(), strict=True))
    spark.createDataFrame([(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)], "id int, length int").coalesce(1).write.parquet(f"{out}/codes")

    def blocks(batches):
        held, start = [], None

        def block():
            ids = np.concatenate([x for _, x in held])
            payload, checkpoints = pack(ids, lengths, codes)
            rows = [row for row, _ in held]
            return pa.RecordBatch.from_pylist([{"part": rows[0]["part"], "start": start, "doc_ids": [x for r in rows for x in r["doc_ids"]], "sizes": [x for r in rows for x in r["sizes"]], "n": len(ids), "checkpoints": checkpoints.tolist(), "payload": payload}], schema=_BLOCK)

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if start is None:
                    start = begins[row["part"]]
                held.append((row, _chunk_ids(row)))
                if sum(len(x) for _, x in held) >= BLOCK_IDS:
                    yield block()
                    start += sum(len(x) for _, x in held)
                    held = []
        if held:
            yield block()

    chunks.mapInArrow(common.tidy(blocks), _BLOCK_DDL).write.option("compression", "none").option("parquet.block.size", 8 << 20).parquet(f"{out}/blocks")


def read(spark: SparkSession, out: str) -> DataFrame:
    """Documents of the files below `out`: doc_id, start, n_tokens, and their ids as little-endian 32-bit bytes."""
    return _read(spark, out, False)


def _read(spark: SparkSession, out: str, digest: bool) -> DataFrame:
    common.ship(spark)
    code = spark.read.parquet(f"{out}/codes").toArrow()  # at most one row for each id of the vocabulary
    lengths = np.zeros(int(code["id"].to_numpy().max()) + 1 if len(code) else 1, np.uint8)
    lengths[code["id"].to_numpy()] = code["length"].to_numpy()

    def run(batches):
        table = decoding_table(lengths)
        for batch in batches:
            for i in range(batch.num_rows):
                own = {name: batch.column(name)[i] for name in batch.schema.names}
                ids = unpack(own["payload"].as_py(), own["checkpoints"].values.to_numpy(), own["n"].as_py(), table)
                sizes = own["sizes"].values.to_numpy().astype(np.int64)
                ends = np.cumsum(sizes)
                raw = ids.astype("<u4").tobytes()
                each = [raw[4 * (e - s) : 4 * e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
                last = pa.array([zlib.crc32(x) for x in each], pa.int64()) if digest else pa.array(each, pa.binary())
                yield pa.RecordBatch.from_arrays([own["doc_ids"].values, pa.array(own["start"].as_py() + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), last], ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    schema = "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids binary")
    return spark.read.schema(_BLOCK_DDL).parquet(f"{out}/blocks").mapInArrow(common.tidy(run), schema)


def op8_id_files(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    out = common.scratch(spark, "op8")
    write(docs, out)
    return _read(spark, out, True)
