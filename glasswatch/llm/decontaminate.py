"""Benchmark decontamination by pigeonhole edit matching.

Test items and texts are brought to one form: A-Z and the capitals of U+00C0-U+00DE in lower case, ASCII letters, digits and
all non-ASCII characters kept, every other run one space.  An item of m bytes may differ in e = floor(RATE * m) edits
(bytes).  It is cut into e + 1 pieces: if it stands in a text with e edits or fewer, one piece is there unchanged.  An
Aho-Corasick automaton finds the pieces; around each hit Myers' bit-parallel distance decides, so every place within the
budget is found and no other.

Items are a query set against all rows: they are taken in blocks of at most BLOCK_BYTES, one pass over the documents each,
so what is broadcast is bounded whatever the number of items.  Null and empty texts contain nothing; items with no
letter or digit match nothing; equal items each give their own rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type

from glasswatch.llm.common import SLICE_BYTES, query, shared_folder, slices, small, table, text_bytes, written

RATE = 0.08
BLOCK_BYTES = 1 << 20

_KEEP = np.full(256, 0x20, np.uint8)
_KEEP[128:] = np.arange(128, 256)
for _low, _high, _by in ((48, 58, 0), (97, 123, 0), (65, 91, 32)):
    _KEEP[_low:_high] = np.arange(_low, _high) + _by


def normal(column: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Normal forms of all texts, each with one space before and after; their n + 1 offsets; for each byte the byte
    of the batch it stands for; the batch's bytes and offsets."""
    data, offsets = text_bytes(column)
    n = len(offsets) - 1
    form = _KEEP[data]
    if len(data) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        form[1:][capital] += 32
    # A gap byte before each text and one at the end; then only the first of several gaps stays.
    framed = np.full(len(data) + n + 1, 0x20, np.uint8)
    at = np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))
    framed[at] = form
    origin = np.zeros(len(framed), np.int64)
    origin[at] = np.arange(len(data))
    head = offsets[:-1] + np.arange(n)
    origin[head] = offsets[:-1]
    keep = framed != 0x20
    keep[1:] |= framed[:-1] != 0x20
    keep[head] = True
    place = np.concatenate(([0], np.cumsum(keep)))
    return framed[keep].tobytes(), place[np.concatenate((head, [len(framed) - 1]))], origin[keep], data, offsets


def normal_texts(texts: list[str | None]) -> list[bytes]:
    raw, edge, *_ = normal(pa.array(texts, pa.string()))
    return [raw[edge[i]:edge[i + 1]].strip() for i in range(len(texts))]


def myers(pattern: bytes, text: bytes, most: int) -> tuple[int, int]:
    """Least edit distance of the pattern to a part of the text, and where that part ends; (most + 1, 0) if above."""
    m = len(pattern)
    equal = [0] * 256
    for k, c in enumerate(pattern):
        equal[c] |= 1 << k
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = full, 0, m, most + 1, 0
    for k, c in enumerate(text, 1):
        eq = equal[c]
        v = eq | down
        h = (((eq & up) + up) ^ up) | eq
        plus = down | (full & ~(h | up))
        minus = up & h
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus = (plus << 1) & full
        minus = (minus << 1) & full
        up = minus | (full & ~(v | plus))
        down = plus & v
        if score < best:
            best, end = score, k
    return best, end


class Items:
    """A block of test items, cut into pieces."""

    def __init__(self, rows: list[tuple[int | None, bytes]], rate: float = RATE):
        self.rows = [(i, t, int(rate * len(t))) for i, t in rows if t]
        self.find = ahocorasick.Automaton()
        pieces: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text, errors) in enumerate(self.rows):
            edge = [len(text) * j // (errors + 1) for j in range(errors + 2)]
            for a, b in zip(edge, edge[1:]):
                pieces.setdefault(text[a:b].decode("latin-1"), []).append((k, b))
        for piece, where in pieces.items():
            self.find.add_word(piece, where)
        if pieces:
            self.find.make_automaton()

    def search(self, text: bytes) -> dict[int, tuple[int, int, int]]:
        """For each item that the text contains: distance, start and end of the best place (the first of equals)."""
        out: dict[int, tuple[int, int, int]] = {}
        done: set[tuple[int, int]] = set()
        if not self.rows:
            return out
        for last, where in self.find.iter(text.decode("latin-1")):
            for k, stop in where:
                _, item, errors = self.rows[k]
                # All starts that a match through this hit can have lie within ``errors`` of this one; hits are taken
                # together by stretches of that width, and the window below holds every match of the stretch.
                width = errors + 1
                stretch = (last + 1 - stop) // width
                if (k, stretch) in done:
                    continue
                done.add((k, stretch))
                low = max(0, stretch * width - errors)
                window = text[low:(stretch + 1) * width + len(item) + errors]
                best, end = myers(item, window, errors)
                if best <= errors and (k not in out or (best, low + end) < (out[k][0], out[k][2])):
                    back, size = myers(item[::-1], window[:end][::-1], errors)
                    out[k] = (best, low + end - size, low + end)
        return out


def blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = BLOCK_BYTES) -> Iterator[list]:
    """Blocks of (id, normal form) of at most ``size`` bytes (or one item); one block is held at a time."""
    held, used = [], 0
    for row in items.select(id_col, F.col(text_col).cast("string").alias("t")).toLocalIterator():
        text = normal_texts([row[1]])[0]
        if held and used + len(text) > size:
            yield held
            held, used = [], 0
        held.append((row[0], text))
        used += len(text)
    if held:
        yield held


def matches(docs: DataFrame, items: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and item it contains: ids, distance, start and end of the best place (code points of the text)."""
    spark = docs.sparkSession
    types = docs.schema[id_col].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    item_type = to_arrow_type(items.schema["item_id"].dataType)
    schema = f"id {types[0]}, item_id {types[1]}, distance int, start long, end long"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    folder = shared_folder(spark)
    spark.createDataFrame([], schema).write.parquet(folder)
    for block in blocks(items):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            known = Items(sent.value, rate)
            for batch in small(batches, 1, SLICE_BYTES):
                raw, edge, origin, data, offsets = normal(batch.column(1))
                found = []
                for i in range(len(batch)):
                    for k, (distance, start, end) in known.search(raw[edge[i]:edge[i + 1]]).items():
                        a, b = origin[edge[i] + start], origin[edge[i] + end - 1] + 1
                        chars = lambda x, i=i: int(((data[offsets[i]:x] & 0xC0) != 0x80).sum())
                        found.append((i, known.rows[k][0], distance, chars(a), chars(b)))
                if found:
                    cols = list(zip(*found))
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(pa.array(cols[0])), pa.array(cols[1], item_type),
                        pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())],
                        ["id", "item_id", "distance", "start", "end"])
        rows.mapInArrow(run, schema).write.mode("append").parquet(folder)
        sent.unpersist()
    return spark.read.schema(schema).parquet(folder).withColumnRenamed("id", id_col)


def contains(text: Column, sent: Broadcast, rate: float = RATE) -> Column:
    """Whether each text contains an item of a broadcast block."""
    @arrow_udf("boolean")
    def hit(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Items(sent.value, rate)
        for batch in batches:
            found = []
            for first, n in slices(batch, SLICE_BYTES):
                raw, edge, *_ = normal(batch.slice(first, n))
                found += [bool(known.search(raw[edge[i]:edge[i + 1]])) for i in range(n)]
            yield pa.array(found, pa.bool_())
    return hit(text.cast("string"))


def clean(docs: DataFrame, items: DataFrame, rate: float = RATE, text_col: str = "text", size: int = BLOCK_BYTES) -> DataFrame:
    """The documents that contain no item, all columns kept.  Between blocks of items the rest is written, so one block
    is broadcast at a time."""
    sent = None
    for block in blocks(items, size=size):
        if sent is not None:
            docs = written(docs)
            sent.unpersist()
        sent = docs.sparkSession.sparkContext.broadcast(block)
        docs = docs.where(~contains(F.col(text_col), sent, rate))
    return docs


@query("op2_decontaminate")
def op2(spark, sf):
    """Benchmark items in all documents; no SQL twin (edit distance of parts)."""
    return matches(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
