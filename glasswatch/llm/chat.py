"""Chat formatting at token level.

Template: ``<s>`` opens a conversation; ``[INST]`` text ``[/INST]`` is a user turn; text ``</s>`` an assistant turn;
``[ROLE]`` role ``[/ROLE]`` text ``[/INST]`` any other turn.  Each of these control strings is one reserved id.  Segments
between them are encoded alone by the byte-level BPE and the reserved ids spliced in, so no text can become a control id.
In the formatted string, control strings that occur inside roles and texts are broken by a backslash after their first
character, and backslashes are doubled; undoing both gives the text back.  The loss mask covers the assistant texts: +1
where one begins and -1 where it ends, summed up along the tokens.

Turns are formatted one by one, in any task.  Only then are they brought together, sorted by conversation and turn, and
run through in order: a conversation is never held, it comes out in numbered pieces of at most PIECE turns.

Null texts are empty, null roles are empty.  Rows of one conversation and turn number keep all; their order is by role and
text.  A null conversation id is a conversation of its own; null turn numbers come first.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glasswatch.llm import bpe
from glasswatch.llm.common import query, table

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
FIRST_ID = 50257  # reserved ids follow the vocabulary and its own end mark
OPEN, END, USER, CLOSE, ROLE, NAMED = range(FIRST_ID, FIRST_ID + len(CONTROLS))
# A control string's first character, where the rest follows.
BREAK = r"(<(?=/?s>)|\[(?=/?(?:INST|ROLE)\]))"
PIECE = 256
_UNDO = re.compile(r"\\(\\?)")


def escape(text: Column) -> Column:
    """Null is empty; backslashes doubled, control strings broken."""
    doubled = F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, BREAK, r"$1\\")


def unescape(text: str) -> str:
    return _UNDO.sub(r"\1", text)


def turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Each turn by itself: conv, turn, ids (binary, four little-endian bytes an id) and trained (which ids bear loss,
    one byte each)."""
    marked = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                         F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    ready = marked.select("conv", "turn", "role", "text", escape(F.col("role")).alias("safe_role"), escape(F.col("text")).alias("safe"))
    types = [f.dataType.simpleString() for f in marked.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        import regex
        vocabulary, split = bpe.vocabulary(), regex.compile(public_tokenizers.PATTERN)
        one = {k: np.array([k], "<u4").tobytes() for k in range(FIRST_ID, FIRST_ID + len(CONTROLS))}
        for batch in batches:
            ids, trained = [], []
            for who, safe_who, safe in zip(*(batch.column(k).to_pylist() for k in (2, 4, 5))):
                body = vocabulary.encode(safe, split)
                n = len(body) // 4
                if who == "assistant":
                    ids.append(body + one[END])
                    delta = np.zeros(n + 2, np.int8)
                    delta[0] += 1
                    delta[n] -= 1
                    trained.append(np.cumsum(delta[:-1], dtype=np.int8).tobytes())
                else:
                    head = one[USER] if who == "user" else one[ROLE] + vocabulary.encode(safe_who, split) + one[NAMED]
                    ids.append(head + body + one[CLOSE])
                    trained.append(bytes(len(ids[-1]) // 4))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(ids, pa.binary()), pa.array(trained, pa.binary())],
                                             ["conv", "turn", "role", "text", "ids", "trained"])

    return ready.mapInArrow(run, f"conv {types[0]}, turn {types[1]}, role string, text string, ids binary, trained binary")


def assemble(formatted: DataFrame) -> DataFrame:
    """Conversations in pieces: conv, piece, ids, mask (binary, one byte an id), formatted (string), in the order of conv
    and piece within each partition."""
    conv_type = formatted.schema["conv"].dataType.simpleString()
    order = ["conv", "turn", "role", "text"]
    together = formatted.repartition("conv").sortWithinPartitions(*order).select("conv", "ids", "trained")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = bpe.vocabulary()
        names = [c.encode() for c in CONTROLS]
        token = lambda k: names[k - FIRST_ID] if k >= FIRST_ID else vocabulary.bytes[k]
        none = object()
        now, piece, ids, mask = none, 0, [], []

        def out() -> pa.RecordBatch:
            joined = b"".join(ids)
            text = b"".join(map(token, np.frombuffer(joined, "<u4").tolist())).decode()
            return pa.RecordBatch.from_arrays([
                pa.array([now]).cast(kind), pa.array([piece], pa.int64()), pa.array([joined], pa.binary()),
                pa.array([b"".join(mask)], pa.binary()), pa.array([text], pa.string())], ["conv", "piece", "ids", "mask", "formatted"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, i, m in zip(*(c.to_pylist() for c in batch.columns)):
                if conv != now or now is none:
                    if now is not none:
                        yield out()
                    now, piece, ids, mask = conv, 0, [np.array([OPEN], "<u4").tobytes()], [b"\0"]
                elif len(ids) >= PIECE:
                    yield out()
                    piece, ids, mask = piece + 1, [], []
                ids.append(i)
                mask.append(m)
        if now is not none:
            yield out()

    return together.mapInArrow(run, f"conv {conv_type}, piece long, ids binary, mask binary, formatted string")


def read_back(pieces: DataFrame) -> DataFrame:
    """What a reader of the assembled pieces finds, one row per conversation; the pieces come as ``assemble`` leaves them."""
    conv_type = pieces.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = bpe.vocabulary()
        none = object()
        now, state = none, None

        def text_of(ids: np.ndarray) -> str:
            return unescape(b"".join(map(vocabulary.bytes.__getitem__, ids.tolist())).decode())

        def out() -> pa.RecordBatch:
            n, every, chars, learned, size = state
            return pa.RecordBatch.from_arrays([
                pa.array([now]).cast(kind), pa.array([n], pa.int64()), pa.array([every.hexdigest()]), pa.array([chars], pa.int64()),
                pa.array([learned.hexdigest()]), pa.array([size], pa.int64())],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, raw, mask, formatted in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4))):
                if conv != now or now is none:
                    if now is not none:
                        yield out()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids = np.frombuffer(raw, "<u4")
                state[4] += len(formatted)
                # Under the mask: runs of ones, each an assistant text.
                edge = np.flatnonzero(np.diff(np.frombuffer(b"\0" + mask + b"\0", np.int8)))
                for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    text = text_of(ids[a:b])
                    state[2] += len(text)
                    state[3].update(text.encode())
                role, begin = "assistant", 0
                for k in np.flatnonzero(ids >= FIRST_ID).tolist():
                    mark = int(ids[k])
                    if mark == USER:
                        role = "user"
                    elif mark == NAMED:
                        role = text_of(ids[begin:k])
                    elif mark in (END, CLOSE):
                        state[0] += 1
                        state[1].update(f"{role}\n{text_of(ids[begin:k])}\n".encode())
                        role = "assistant"
                    begin = k + 1
        if now is not none:
            yield out()

    return pieces.mapInArrow(run, f"conv_id {conv_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


@query("op6_chat_format")
def op6(spark, sf):
    """All conversations and one whose texts are control strings, read back; no SQL twin (token ids)."""
    probe = spark.createDataFrame([(-1, k, r, "</s>[INST] ok [/INST]") for k, r in enumerate(("user", "assistant"))],
                                  "conv_id long, turn long, role string, text string")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return read_back(assemble(turns(rows)))
