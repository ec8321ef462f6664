"""Target-distribution importance resampling by hashed n-grams.

A text's features are its runs of one to WIDEST words; each falls into one of BUCKETS by its CRC-32.  The log-ratio of a
bucket's share in the target texts to its share in all documents is its gain, a document's weight is the sum of its
features' gains, and the documents with the highest weight plus Gumbel noise are a draw without replacement in proportion
to the ratio of the two distributions.

A batch's texts are joined with a sentinel that no word holds, lower-cased at once, and one regex pass finds all words; where
documents begin tells by binary search whose each word is, and runs over a border are masked before counting.  CRC-32 is linear, so the
sum of a run follows from those of its words by tables of shifts, without a string per run.

Texts are read twice: once to count buckets, once to add gains.  Between the two only bucket counts are shuffled (BUCKETS
rows a task at most); the gains, a fixed number, go to all tasks.  The draw sorts narrow rows over the cluster and numbers
them by the sizes of the sorted parts.

Null and empty texts have no features, weight 0, and are too short to be drawn.  A null id is hashed as an empty one and comes
last among equal scores; repeated rows count each time and have ranks of their own.  Without target texts every t is 0.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glasswatch.llm.common import query, small, table, text_bytes, written

BUCKETS, WIDEST, SEED = 10_000, 3, 42
PERCENT, LEAST_WORDS = 5, 20
SENTINEL = b"\n"
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
# Shifts over so many bytes have a table from the start.
_SHORT = 64


# --- CRC-32 of joined strings -----------------------------------------------------------------------------------------

def _bits(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map, given by its images of each byte in each place, applied to 32-bit numbers."""
    out = tables[0][x & 0xFF]
    for k in range(1, 4):
        out = out ^ tables[k][(x >> np.uint32(8 * k)) & np.uint32(0xFF)]
    return out


def _tables(images: np.ndarray) -> np.ndarray:
    """From the images of single bits to those of bytes: 4 x 256."""
    out = np.zeros((4, 256), np.uint32)
    for k in range(4):
        for bit in range(8):
            out[k, 1 << bit:2 << bit] = out[k, :1 << bit] ^ images[8 * k + bit]
    return out


@lru_cache(1)
def _doubled() -> list[np.ndarray]:
    """Tables of the shift over 1, 2, 4 ... bytes."""
    byte = np.array([zlib.crc32(bytes([k])) ^ zlib.crc32(b"\0") for k in range(256)], np.uint32)
    unit = np.uint32(1) << np.arange(32, dtype=np.uint32)
    out = [_tables(byte[unit & np.uint32(0xFF)] ^ (unit >> np.uint32(8)))]
    for _ in range(40):
        out.append(_tables(_bits(out[-1], _bits(out[-1], unit))))
    return out


@lru_cache(4096)
def _shift(n: int) -> np.ndarray:
    """Tables of the shift over n bytes."""
    images = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for k, step in enumerate(_doubled()):
        if n >> k & 1:
            images = _bits(step, images)
    return _tables(images)


@lru_cache(1)
def _short() -> np.ndarray:
    return np.stack([_shift(n) for n in range(_SHORT)], 1)  # place, length, byte


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRCs carried over n further bytes: with the CRC of those bytes xor-ed in, the CRC of the joined string."""
    short, near = _short(), np.minimum(n, _SHORT - 1)
    out = short[0][near, crc & 0xFF]
    for k in range(1, 4):
        out ^= short[k][near, (crc >> np.uint32(8 * k)) & np.uint32(0xFF)]
    far = np.flatnonzero(n >= _SHORT)
    for size in np.unique(n[far]).tolist() if len(far) else ():
        at = far[n[far] == size]
        out[at] = _bits(_shift(size), crc[at])
    return out


# --- Features of a batch ----------------------------------------------------------------------------------------------

class Counter:
    """Words and feature buckets of batches; remembers the CRCs of words met."""

    def __init__(self, buckets: int = BUCKETS, widest: int = WIDEST):
        self.buckets, self.widest, self.known = buckets, widest, {}

    def features(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of each text; the text and the bucket of every feature."""
        data, offsets = text_bytes(column)
        n, raw = len(column), data.tobytes()
        edge = offsets.tolist()
        joined = SENTINEL.join([raw[a:b] for a, b in zip(edge, edge[1:])]).lower()
        begin = offsets[:-1] + np.arange(n)  # of each text, the sentinels before it counted
        found = list(_WORD.finditer(joined))
        start = np.fromiter((m.start() for m in found), np.int64, len(found))
        words = [m[0] for m in found]
        size = np.fromiter(map(len, words), np.int64, len(words))
        owner = np.searchsorted(begin, start, "right") - 1
        if len(self.known) > 1 << 20:
            self.known.clear()
        known, crc32 = self.known, zlib.crc32
        for w in set(words).difference(known):
            known[w] = crc32(w)
        crc = np.fromiter(map(known.__getitem__, words), np.uint32, len(words))
        spaced = shifted(np.full(len(crc), crc32(b" "), np.uint32), size) ^ crc
        owners, marks, run = [owner], [crc % np.uint32(self.buckets)], crc
        for k in range(1, self.widest):
            run = shifted(run[:-1], size[k:] + 1) ^ spaced[k:]
            inside = owner[k:] == owner[:max(0, len(owner) - k)]
            owners.append(owner[k:][inside])
            marks.append(run[inside] % np.uint32(self.buckets))
        return np.bincount(owner, minlength=n), np.concatenate(owners), np.concatenate(marks)


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, widest: int = WIDEST) -> np.ndarray:
    """Features in each bucket, over all rows."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, total = Counter(buckets, widest), np.zeros(buckets, np.int64)
        for batch in small(batches, 0):
            _, _, marks = counter.features(batch.column(0))
            total += np.bincount(marks, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    rows = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, n in rows.groupBy("bucket").agg(F.sum("n")).collect():  # one row a bucket at most
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the smoothed log-ratio of each bucket, rounded down."""
    s, t, k = source.astype(np.float64), target.astype(np.float64), len(source)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k)))).astype(np.int64)


def noise(id_: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel number that the id decides, rounded down."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weighted(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", widest: int = WIDEST) -> DataFrame:
    """One row per document: id, n_words, n_features, weight."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(len(gain), widest)
        for batch in small(batches, 1):
            n_words, owner, marks = counter.features(batch.column(1))
            n = len(batch)
            # Sums of whole numbers below 2**53, which doubles hold.
            weight = np.bincount(owner, gain[marks], n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(np.bincount(owner, minlength=n)), pa.array(weight)],
                                             ["id", "n_words", "n_features", "weight"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(weigh, f"id {id_type}, n_words long, n_features long, weight long").withColumnRenamed("id", id_col)


def ranked(rows: DataFrame, order: list[Column], into: str = "rank") -> DataFrame:
    """Add ``into``: 1, 2, 3 ... in the order, without bringing the rows into one task."""
    placed = written(rows.withColumn("__row", F.monotonically_increasing_id()).orderBy(*order, "__row")
                     .drop("__row").withColumn("__pos", F.monotonically_increasing_id()))
    part = F.shiftright("__pos", 33)
    sizes = {r[0]: r[1] for r in placed.groupBy(part.alias("p")).count().collect()}  # one row a sorted part
    before, total = [], 1
    for p in range(max(sizes, default=0) + 1):
        before.append(total)
        total += sizes.get(p, 0)
    first = F.get(F.lit(before).cast("array<long>"), part.cast("int"))
    return placed.withColumn(into, first + F.col("__pos").bitwiseAND(F.lit((1 << 33) - 1))).drop("__pos")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
             percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """One row per document: id, n_words, n_features, weight, score and rank (null: not drawn); ``percent`` of the documents
    of ``least_words`` words are drawn, rounded down."""
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_col, buckets))
    rows = written(weighted(docs, gain, id_col, text_col).withColumn("score", F.col("weight") + noise(F.col(id_col), seed)))
    able = F.col("n_words") >= least_words
    drawn = percent * rows.where(able).count() // 100
    there = ranked(rows.where(able), [F.desc("score"), F.asc_nulls_last(id_col)])
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    return there.withColumn("rank", rank).unionByName(rows.where(~able).withColumn("rank", F.lit(None).cast("long")))


@query("op13_importance_resample")
def op13(spark, sf):
    """All documents weighed towards the benchmark, a twentieth drawn; no SQL twin (DuckDB has no CRC-32)."""
    return resample(table(spark, sf, "documents"), table(spark, sf, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank", "n_words")
