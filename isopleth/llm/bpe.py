"""Operator 3: exact byte-pair encoding by backtracking, and decoding by an offset table.

Encoding. A text is split at the white space that the tokenizer drops anyway; each word is encoded once in a worker and
then looked up. A word that is not known yet is normalised, cut into pre-tokens, and each pre-token is encoded by
backtracking: an Aho-Corasick automaton gives the longest token at every place, and a token may follow another only if
the pair is compatible, that is, if merging their joined text by rank would leave the border between them. The first
complete sequence of compatible tokens is the result of the merges, found in time linear in the pre-token. (The pair test
and the loop follow the publicly described algorithm of the `bpe` crate in GitHub's rust-gems, MIT licence.)

Decoding. One table holds the bytes of all tokens and their offsets; the ids' spans are gathered with numpy.

Splitting at ASCII white space is exact: the normaliser (NFC, white space to a space, lower case of each character)
never joins characters over it and no pre-token or special token contains it. Words of plain Latin letters, digits and
marks (`_PLAIN`, whose classes and cases all versions of Unicode share) are normalised and cut here; all other words by
the library's own normaliser and pre-tokenizer, so that its version of the Unicode tables decides.

Null texts count as empty; empty texts have no ids and decode to an empty text. Texts of any length are encoded whole,
one at a time. Repeated rows are encoded each. Extra columns are kept by `encode` and `decode`, and ignored by the query.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common

DEFAULT_TOKENIZER = "word_bpe_49k.json"
#: Words and pre-tokens that a worker remembers, at most, and their longest length in bytes.
REMEMBERED, REMEMBERED_BYTES = 80_000, 48

_PLAIN = re.compile("[\\x21-\\x7e¡-¬®-ĮıĲ-ňŊ-ž‐-―‘-„†-•…€]*")
#: The file's pattern for plain words; digits and number signs stand alone.
_LETTER, _NUMBER = "a-zªµºÀ-ÖØ-öø-ž", "0-9²³¹¼-¾"
_PRE_TOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_LETTER}{_NUMBER}]+")


def tokenizer_path(path: str | None) -> str:
    """The file of a tokenizer: a path, or the installed public one."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_TOKENIZER)


def byte_characters() -> list[str]:
    """The printable character that byte-level BPE writes for each byte value."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b) if b in plain else chr(extra))
        extra += b not in plain
    return out


class Merges:
    """A merge table in rank order: base symbols first, then one token for each merge."""

    def __init__(self, base: int, pairs: list[tuple[int, int]]):
        import ahocorasick

        self.split = [(i, i) for i in range(base)] + pairs
        self.joined = {pair: base + i for i, pair in enumerate(pairs)}
        if len(self.joined) != len(pairs):
            raise ValueError("a pair is merged twice")
        word = [chr(i + 1) for i in range(base)]
        reachable = [True] * base
        for i, (a, b) in enumerate(pairs):
            word.append(word[a] + word[b])
            reachable.append(reachable[a] and reachable[b] and self.compatible(a, b, base + i))
        self.size = [len(x) for x in word]
        self.longest = ahocorasick.Automaton()
        by_word = {}
        for token, x in enumerate(word):
            if reachable[token]:
                by_word[x] = token
                self.longest.add_word(x, token)
        self.longest.make_automaton()
        #: For each token the longest token that it begins with, or -1.
        self.shorter = [next((by_word[x[:n]] for n in range(len(x) - 1, 0, -1) if x[:n] in by_word), -1) for x in word]
        self.pairs_seen: dict[int, bool] = {}

    def compatible(self, left: int, right: int, limit: int = 1 << 40) -> bool:
        """Whether merging by rank keeps the border between these tokens; only merges before `limit` count."""
        split, joined = self.split, self.joined
        while True:
            if joined.get((left, right), limit) < limit:
                return False
            if left > right:
                limit, left = left, split[left][1]
                if left == limit:  # a base symbol: go on with the other side
                    limit, right = right + 1, split[right][0]
                    if right + 1 == limit:
                        return True
            else:
                limit, right = right + 1, split[right][0]
                if right + 1 == limit:
                    limit, left = left, split[left][1]
                    if left == limit:
                        return True

    def encode(self, symbols: str) -> list[int]:
        """Tokens of a string of base symbols (chr(symbol + 1))."""
        n, size, shorter, seen = len(symbols), self.size, self.shorter, self.pairs_seen
        at = [-1] * n
        for end, token in self.longest.iter(symbols):
            start = end + 1 - size[token]
            at[start] = token  # ends ascend, so the last one for a start is the longest
        dead = bytearray(n + 1)
        out: list[int] = []
        place, token = 0, at[0] if n else -1
        while token >= 0:
            last = out[-1] if out else -1
            while True:
                end = place + size[token]
                if not dead[end]:
                    fits = True
                    if last >= 0:
                        key = last << 20 | token
                        if (fits := seen.get(key)) is None:
                            if len(seen) > 200_000:
                                seen.clear()
                            fits = seen[key] = self.compatible(last, token)
                    if fits:
                        out.append(token)
                        place = end
                        token = at[end] if end < n else -1
                        break
                if (token := shorter[token]) < 0:
                    dead[place] = 1
                    out.pop()
                    place -= size[last]
                    token = last
                    break
        return out


class Encoder:
    """Texts to ids as the tokenizers library gives them without special tokens added."""

    def __init__(self, path: str):
        import regex
        import tokenizers

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        if model["type"] != "BPE" or not suffix or model["unk_token"] or model["byte_fallback"]:
            raise ValueError("this encoder is for byte-level BPE with word ends")
        chars = byte_characters()
        names = [c for c in chars] + [c + suffix for c in chars]
        place = {x: i for i, x in enumerate(names)}
        pairs = []
        for a, b in model["merges"]:
            pairs.append((place[a], place[b]))
            if place.setdefault(a + b, len(names)) != len(names):
                raise ValueError("a token has two merges")
            names.append(a + b)
        self.merges = Merges(512, pairs)
        self.ids = [vocab[x] for x in names]
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special = special
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        bare = tokenizers.Tokenizer.from_str(json.dumps(spec | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": []}))
        self.normalizer, self.pre_tokenizer = bare.normalizer, bare.pre_tokenizer
        self.byte = {c: b for b, c in enumerate(chars)}
        size = max([*vocab.values(), *special.values()]) + 1
        strings = [""] * size
        for x, i in (vocab | special).items():
            strings[i] = x
        self.tokens = OffsetTable([x.encode() + b" " for x in strings])
        self.decimals = OffsetTable([b"%d " % i for i in range(size)])
        self.words = _Remembered(self)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _piece(self, raw: bytes) -> bytes:
        if (found := self.known.get(raw)) is not None:
            return found
        if (found := self.older.get(raw)) is not None:
            self.known[raw] = found
            return found
        symbols = "".join(map(chr, [b + 1 for b in raw[:-1]])) + chr(257 + raw[-1])
        found = np.array([self.ids[t] for t in self.merges.encode(symbols)], "<i4").tobytes()
        if len(raw) <= REMEMBERED_BYTES:
            if len(self.known) >= REMEMBERED:
                self.known, self.older = {}, self.known  # the older generation goes
            self.known[raw] = found
        return found

    def _plain(self, part: str) -> bytes:
        if not _PLAIN.fullmatch(part):
            pieces = self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(part))
            return b"".join([self._piece(bytes([self.byte[c] for c in x])) for x, _ in pieces])
        part = part.lower()
        stem = part.rstrip(".,;:!?")
        if stem.isalpha():  # the usual word: letters, then marks
            return self._piece(stem.encode()) + (self._piece(part[len(stem) :].encode()) if len(stem) < len(part) else b"")
        return b"".join([self._piece(x.encode()) for x in _PRE_TOKEN.findall(part)])

    def word(self, word: bytes) -> bytes:
        """Little-endian 32-bit ids of what stands between white space."""
        text = word.decode("utf-8", "replace")
        if self.cut and "<" in text:
            parts = self.cut.split(text)
            return b"".join([np.array([self.special[x]], "<i4").tobytes() if i % 2 else self._plain(x) for i, x in enumerate(parts)])
        return self._plain(text)

    def encode(self, text: bytes) -> np.ndarray:
        """Ids of a whole text in UTF-8."""
        words = self.words
        if len(words) >= REMEMBERED:
            words.clear()
        return np.frombuffer(b"".join(map(words.__getitem__, text.split())), "<i4")

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' strings joined by a space, as the library decodes without a decoder; special ones stay."""
        return self.tokens.gather(ids)[:-1].tobytes()


class _Remembered(dict):
    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: bytes) -> bytes:
        found = self.encoder.word(word)
        if len(word) <= REMEMBERED_BYTES and len(self) < 2 * REMEMBERED:
            self[word] = found
        return found


class OffsetTable:
    """Byte strings in one buffer, gathered by index."""

    def __init__(self, parts: list[bytes]):
        self.data = np.frombuffer(b"".join(parts), np.uint8)
        self.size = np.array([len(x) for x in parts], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])

    def gather(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        end = np.cumsum(size)
        if not len(end):
            return np.zeros(0, np.uint8)
        return self.data[np.repeat(self.start[ids] - end + size, size) + np.arange(end[-1])]


_encoders: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """The encoder of a tokenizer's file, made once in a process."""
    path = tokenizer_path(path)
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _split(batch: pa.RecordBatch, column: str):
    """Bytes of each text of a batch."""
    data, offs = common.text_buffers(batch.column(column))
    raw = data.tobytes()
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        yield raw[a:b]


def encode(df: DataFrame, text: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """Adds a column of ids (array of int) to all rows; a column of that name is replaced."""
    kept = [c for c in df.columns if c != out]
    schema = df.select(kept).schema.add(out, T.ArrayType(T.IntegerType()))

    def run(batches):
        e = encoder(path)
        for batch in batches:
            ids = [e.encode(x) for x in _split(batch, text)]
            ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]), pa.int32())
            flat = pa.array(np.concatenate([np.zeros(0, np.int32), *ids]), pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.ListArray.from_arrays(ends, flat)], [*kept, out])

    common.ship(df.sparkSession)
    return df.select(kept).mapInArrow(common.tidy(run), schema)


def decode(df: DataFrame, ids: str = "ids", out: str = "text", path: str | None = None) -> DataFrame:
    """Adds the decoded text of a column of ids (null counts as none); a column of that name is replaced."""
    kept = [c for c in df.columns if c != out]
    schema = df.select(kept).schema.add(out, "string")

    def run(batches):
        e = encoder(path)
        for batch in batches:
            lists = batch.column(ids)
            texts = [e.decode(np.asarray(x.values, np.int64)) if x.is_valid else b"" for x in lists]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.binary()).cast(pa.string())], [*kept, out])

    common.ship(df.sparkSession)
    return df.select(kept).mapInArrow(common.tidy(run), schema)


def coded(df: DataFrame, text: str = "text", ids: str = "ids", digest: str = "decoded_sha256", path: str | None = None) -> DataFrame:
    """Replaces the text by its ids and a digest of the text that these decode to: `encode` and `decode` in one worker."""
    kept = [c for c in df.columns if c not in (text, ids, digest)]
    schema = df.select(kept).schema.add(ids, T.ArrayType(T.IntegerType())).add(digest, "string")

    def run(batches):
        e = encoder(path)
        for batch in batches:
            found = [e.encode(x) for x in _split(batch, text)]
            ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in found])]), pa.int32())
            flat = pa.array(np.concatenate([np.zeros(0, np.int32), *found]), pa.int32())
            digests = pa.array([hashlib.sha256(e.decode(x)).hexdigest() for x in found], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.ListArray.from_arrays(ends, flat), digests], [*kept, ids, digest])

    common.ship(df.sparkSession)
    return df.select(*kept, text).mapInArrow(common.tidy(run), schema)


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encodes every whole text, decodes the ids, and digests both, in one pass without a shuffle."""

    def run(batches):
        e = encoder(path)
        for batch in batches:
            n, a, b = [], [], []
            for text in _split(batch, "text"):
                ids = e.encode(text)
                n.append(len(ids))
                a.append(hashlib.sha256(e.decimals.gather(ids)[:-1]).hexdigest())
                b.append(hashlib.sha256(e.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    common.ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(common.tidy(run), DIGESTS)


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(common.table(spark, sf_dir, "documents"))
