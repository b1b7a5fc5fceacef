"""Operator 10: conversations as training text, assembled by columns.

Each turn becomes ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``. Inside roles and texts every backslash is doubled and every
control string (`CONTROLS`) gets a backslash after its first character, so that no control string is left and the
original can be read back; a newline in a role is written as backslash n.

Assembly: for a batch of turns the lengths of all segments (header, role, newline, text, end) are computed at once,
their running sum gives the offsets, and one gather with numpy copies everything into one preallocated buffer that
becomes the Arrow column. Turns that follow each other in a conversation share an output row; a conversation that goes
on in the next batch has another row, with the next chunk number, so that memory is bounded by a batch however long a
conversation is. The loss mask is given as byte spans of the assistants' texts.

Turns are ordered by turn, then role, then text (nulls first); repeated rows are repeated turns. Null roles and texts
are empty. Rows with a null conv_id form one conversation. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

START, END = "<|im_start|>", "<|im_end|>\n"
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<pad>", "<unk>")
TRAINED_ROLE = "assistant"
_CONTROL = re.compile(b"|".join([rb"\\", *(re.escape(c.encode()) for c in CONTROLS)]))
_ESCAPED = re.compile(rb"\\(.)", re.DOTALL)


def escape(raw: bytes) -> bytes:
    return _CONTROL.sub(lambda m: b"\\\\" if m[0] == b"\\" else m[0][:1] + b"\\" + m[0][1:], raw)


def escape_role(raw: bytes) -> bytes:
    return escape(raw).replace(b"\n", b"\\n")


def unescape(raw: bytes) -> bytes:
    """Reads back what `escape` or `escape_role` wrote."""
    if b"\\" not in raw:
        return raw
    return _ESCAPED.sub(lambda m: b"\n" if m[1] == b"n" else m[1], raw)


def _escaped(column: pa.Array, one) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column after escaping; columns without any special byte are left as they are."""
    data, offs = common.text_buffers(column)
    if not np.isin(data, np.frombuffer(b"\\<[\n" if one is escape_role else b"\\<[", np.uint8)).any():
        return data, offs
    raw = data.tobytes()
    parts = [one(raw[a:b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with all turns of a batch; the offset of each turn (one more), and of its text, and the text's size."""
    n = len(roles)
    role, role_at = _escaped(roles, escape_role)
    text, text_at = _escaped(texts, escape)
    fixed = [np.frombuffer(x.encode(), np.uint8) for x in (START, "\n", END)]
    pool = np.concatenate([*fixed, role, text])
    begins = np.cumsum([0, *(len(x) for x in fixed), len(role)])
    size, source = np.empty((n, 5), np.int64), np.empty((n, 5), np.int64)
    for i, part in ((0, 0), (2, 1), (4, 2)):
        size[:, i], source[:, i] = len(fixed[part]), begins[part]
    size[:, 1], source[:, 1] = np.diff(role_at), begins[3] + role_at[:-1]
    size[:, 3], source[:, 3] = np.diff(text_at), begins[4] + text_at[:-1]
    end = np.cumsum(size.reshape(-1))
    start = (end - size.reshape(-1)).reshape(n, 5)
    total = int(end[-1]) if n else 0
    out = np.empty(total, np.uint8)
    np.take(pool, np.repeat((source - start).reshape(-1), size.reshape(-1)) + np.arange(total), out=out)
    return out, np.append(start[:, 0], total), start[:, 3], size[:, 3]


SCHEMA = "conv_id long, chunk long, n_turns long, formatted string, loss array<struct<start:long,size:long>>"
_SPAN = pa.struct([("start", pa.int64()), ("size", pa.int64())])


def formatted(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as rows of text with loss spans, in order of conv_id and chunk."""
    spark = conversations.sparkSession
    common.ship(spark)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = rows.repartition(common.n_tasks(spark), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        last, chunk = object(), 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids = batch.column("conv_id").to_pylist()
            heads = np.array([i for i in range(n) if i == 0 or ids[i] != ids[i - 1]])
            out, turn_at, text_at, text_size = assemble(batch.column("role"), batch.column("text"))
            is_loss = np.array([r == TRAINED_ROLE for r in batch.column("role").to_pylist()], bool)
            own = np.concatenate([turn_at[heads], turn_at[-1:]])
            text = pa.LargeStringArray.from_buffers(len(heads), pa.py_buffer(own.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())
            base = np.repeat(turn_at[heads], np.diff(np.append(heads, n)))
            spans = pa.StructArray.from_arrays([pa.array((text_at - base)[is_loss]), pa.array(text_size[is_loss])], fields=list(_SPAN))
            span_at = np.concatenate([[0], np.cumsum(is_loss)])[np.append(heads, n)]
            chunks = [0] * len(heads)
            chunks[0] = chunk + 1 if ids[0] == last else 0
            last, chunk = ids[-1], chunks[-1]
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in heads], pa.int64()), pa.array(chunks, pa.int64()), pa.array(np.diff(np.append(heads, n))), text, pa.ListArray.from_arrays(pa.array(span_at, pa.int32()), spans)], ["conv_id", "chunk", "n_turns", "formatted", "loss"])

    return rows.mapInArrow(common.tidy(run), SCHEMA)


def parsed(text: bytes) -> list[tuple[bytes, bytes]]:
    """Roles and texts of formatted turns."""
    out = []
    for turn in text.split(END.encode())[:-1]:
        role, _, content = turn[len(START.encode()) :].partition(b"\n")
        out.append((unescape(role), unescape(content)))
    return out


_DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(rows: DataFrame) -> DataFrame:
    """What is read back from formatted rows; a conversation's rows must follow each other in one partition."""

    def run(batches):
        last, state, done = object(), None, []
        names = [x.split()[0] for x in _DIGESTS.split(", ")]
        kinds = [pa.string() if x.endswith("string") else pa.int64() for x in _DIGESTS.split(", ")]
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        close = lambda: (last, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])
        chars = lambda raw: len(raw.decode())
        for batch in batches:
            for conv, text, loss in zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist(), batch.column("loss").to_pylist(), strict=True):
                if state is None or conv != last:
                    if state is not None:
                        done.append(close())
                    last, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                raw = text.encode()
                state[4] += len(text)
                for role, content in parsed(raw):
                    state[0] += 1
                    state[1].update(role + b"\n" + content + b"\n")
                for span in loss:
                    own = unescape(raw[span["start"] : span["start"] + span["size"]])
                    state[2] += chars(own)
                    state[3].update(own)
            if done:
                yield batch_of(done)
                done = []
        if state is not None:
            yield batch_of([close()])

    return rows.mapInArrow(common.tidy(run), _DIGESTS)


_ADDED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op10_chat(spark, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame(_ADDED, "conv_id long, turn long, role string, text string")
    return digests(formatted(rows.unionByName(more)))


def oracle() -> str:
    control = "|".join(re.sub(r"([|\[\]])", r"\\\1", c) for c in CONTROLS)
    size = lambda c: rf"(length({c}) + length({c}) - length(replace({c}, '\', '')) + len(regexp_extract_all({c}, '{control}')))"
    added = " UNION ALL ".join(f"SELECT {c}, {t}, '{r}', '{x}'" for c, t, r, x in _ADDED)
    return rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM
             (SELECT conv_id, turn, role, text FROM conversations UNION ALL {added}))
SELECT conv_id::bigint AS conv_id, count(*)::bigint AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = '{TRAINED_ROLE}'), 0)::bigint AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = '{TRAINED_ROLE}'), '')) AS loss_sha256,
  sum({len(START) + 1 + len(END)} + {size("role")} + length(role) - length(replace(role, chr(10), '')) + {size("text")})::bigint AS formatted_chars
FROM t GROUP BY conv_id"""
