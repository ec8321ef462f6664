"""SimHash near-duplicates by anchor-point covering.

Fingerprints: each bit is 1 if it is set in over half the XXH64 hashes of a text's shingles.  Equal fingerprints become
one row before anything else.  Anchors are the code words of a perfect binary code of length 23 (radius 3, so every 23-bit
word has one nearest code word), taken on bits 0-22 and on bits 23-45 of a fingerprint: 2**24 anchors.  A fingerprint
belongs to its nearest anchor, and is copied to every anchor whose own fingerprints can differ from it in THRESHOLD bits
or fewer, which are anchors within the covering radius plus the threshold.  If two fingerprints differ in few enough
bits, the copy of each meets the other at the other's anchor.  Every anchor compares its own with its copies and leaves
links of a spanning forest only, so a dense group yields as many links as members, not pairs.  Anchors with very many
copies are split: own fingerprints and copies are dealt into blocks by their hash, and each pair of blocks is one task's
work.

Empty and null texts have fingerprint zero and are linked like any other.  Null ids take part; they stay null.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glasswatch.llm.common import SLICE_BYTES, lower_ascii, query, small, table, text_bytes, words, written
from glasswatch.llm.components import components

SEED, SHINGLE, THRESHOLD = 42, 3, 2
LENGTH, RADIUS = 23, 3
GENERATOR = 0b110001110101  # of the code, as a polynomial: fixed value
# Copies that one anchor compares in one block.
PART = 4096
# Fingerprints whose copies are made at once, about a thousand each.
AT_ONCE = 512


def normal_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words with single spaces between them, so that a shingle is a slice; where each begins (one number
    more than words), and the first word of each text (n + 1 numbers)."""
    data, offsets = text_bytes(column)
    start, end, first = words(data, offsets)
    size = end - start + 1
    place = np.concatenate(([0], np.cumsum(size)))
    joined = np.full(place[-1], 0x20, np.uint8)
    take = np.repeat(start - place[:-1], size) + np.arange(place[-1])
    inside = np.ones(place[-1], bool)
    inside[place[1:] - 1] = False
    joined[inside] = lower_ascii(data)[take[inside]]
    return joined, place, first


def fingerprints_of(column: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """64-bit fingerprint of each text."""
    joined, place, first = normal_words(column)
    n = len(first) - 1
    out = np.zeros(n, np.uint64)
    if not len(joined):
        return out
    raw, begin, stop = joined.tobytes(), place[:-1], place[1:] - 1
    one = xxhash.xxh64_intdigest
    for i in range(n):
        a, b = int(first[i]), int(first[i + 1])
        if a == b:
            continue
        last = max(a + 1, b - shingle + 1)
        ends = stop[min(a + shingle, b) - 1:b]
        for low in range(a, last, 1 << 16):
            high = min(last, low + (1 << 16))
            h = np.fromiter((one(raw[s:e], SEED) for s, e in zip(begin[low:high].tolist(), ends[low - a:high - a].tolist())),
                            ">u8", high - low)
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
            sums = bits if low == a else sums + bits
        out[i] = np.packbits(2 * sums > last - a).view(">u8")[0]
    return out


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Id and fingerprint (long) of each document."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 1, SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints_of(batch.column(1), shingle).view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")) \
        .mapInArrow(run, f"id {id_type}, fp long").withColumnRenamed("id", id_col)


def _syndrome(x: np.ndarray) -> np.ndarray:
    """Remainder of a 23-bit word by the generator."""
    x = x.copy()
    for bit in range(LENGTH - 1, 10, -1):
        x ^= ((x >> np.uint64(bit)) & np.uint64(1)) * np.uint64(GENERATOR << (bit - 11))
    return x


@lru_cache(1)
def _leaders() -> np.ndarray:
    """The error of weight RADIUS or less for each of the 2**11 remainders; the code is perfect, so each has one."""
    errors = np.array([sum(1 << k for k in c) for w in range(RADIUS + 1) for c in combinations(range(LENGTH), w)], np.uint64)
    out = np.zeros(1 << 11, np.uint64)
    out[_syndrome(errors).astype(np.int64)] = errors
    return out


def nearest(x: np.ndarray) -> np.ndarray:
    """The nearest code word of each 23-bit word."""
    return x ^ _leaders()[_syndrome(x).astype(np.int64)]


def _halves(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = np.uint64((1 << LENGTH) - 1)
    return fp & low, (fp >> np.uint64(LENGTH)) & low


def anchor(fp: np.ndarray) -> np.ndarray:
    a, b = _halves(fp)
    return nearest(a) | nearest(b) << np.uint64(LENGTH)


def anchors_near(fp: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Row and anchor of every copy: anchors of all words at most ``threshold`` bits away."""
    a, b = _halves(fp)
    flips = [np.array([sum(1 << k for k in c) for c in combinations(range(LENGTH), w)], np.uint64) for w in range(threshold + 1)]
    rows, out = [], []
    number = np.arange(len(fp))
    reach = [[nearest((half[:, None] ^ f[None, :]).ravel()).reshape(len(fp), -1) for f in flips] for half in (a, b)]
    for i in range(threshold + 1):
        for j in range(threshold + 1 - i):
            x, y = reach[0][i], reach[1][j]
            pair = x[:, :, None] | y[:, None, :] << np.uint64(LENGTH)
            out.append(pair.ravel())
            rows.append(np.repeat(number, pair.shape[1] * pair.shape[2]))
    row, found = np.concatenate(rows), np.concatenate(out)
    order = np.lexsort((found, row))
    row, found = row[order], found[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (found[1:] != found[:-1])
    return row[new], found[new]


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the links join parts that no earlier link has joined."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    keep = np.zeros(len(a), bool)
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = root(x), root(y)
        if x != y:
            parent[y] = x
            keep[k] = True
    return keep


def compare(own: np.ndarray, copies: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest among own fingerprints and copies that differ in ``threshold`` bits or fewer."""
    both, place = np.unique(np.concatenate((own, copies)), return_inverse=True)
    here, there = place[:len(own)], place[len(own):]
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max(1, (1 << 20) // max(1, len(copies)))
    for k in range(0, len(own), step):
        i, j = np.nonzero(np.bitwise_count(own[k:k + step, None] ^ copies[None, :]) <= threshold)
        a, b = here[k:k + step][i], there[j]
        keep = a != b
        left.append(a[keep])
        right.append(b[keep])
        if sum(map(len, left)) > 1 << 20:  # thin out as it goes, so dense anchors need no more memory
            a, b = np.concatenate(left), np.concatenate(right)
            keep = _forest(len(both), a, b)
            left, right = [a[keep]], [b[keep]]
    a, b = np.concatenate(left), np.concatenate(right)
    keep = _forest(len(both), a, b)
    return both[a[keep]], both[b[keep]]


def links(distinct: DataFrame, threshold: int = THRESHOLD, part: int = PART) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp``; components of all pairs are components of these."""
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for k in range(0, len(fps), AT_ONCE):
                fp = fps[k:k + AT_ONCE]
                row, at = anchors_near(fp, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(at.view(np.int64)), pa.array(fp[row].view(np.int64)),
                                                  pa.array(at == anchor(fp)[row])], ["anchor", "fp", "own"])

    copies = distinct.select("fp").mapInArrow(spread, "anchor long, fp long, own boolean")
    # An anchor none of whose own fingerprints is near has nothing to compare; one fingerprint alone has none either.
    held = written(copies)
    size = held.groupBy("anchor").agg(F.sum(F.col("own").cast("long")).alias("n_own"), F.count(F.lit(1)).alias("n")) \
        .where("n_own > 0 AND n > 1")
    sized = held.join(size, "anchor")
    # Blocks: own ones are dealt into rows of a grid, copies into columns; small anchors have a grid of one.
    side = lambda n: F.ceil(F.col(n) / part).cast("int")
    of = lambda n: F.pmod(F.xxhash64("fp"), side(n)).cast("int")
    spot = lambda r, c: F.struct(r.cast("int").alias("r"), c.cast("int").alias("c"))
    as_copy = F.transform(F.sequence(F.lit(0), side("n_own") - 1), lambda r: F.struct(spot(r, of("n")).alias("at"), F.lit(False).alias("own")))
    as_own = F.transform(F.sequence(F.lit(0), side("n") - 1), lambda c: F.struct(spot(of("n_own"), c).alias("at"), F.lit(True).alias("own")))
    dealt = sized.select("anchor", "fp", F.explode(F.when(F.col("own"), F.concat(as_copy, as_own)).otherwise(as_copy)).alias("x")) \
        .select("anchor", "fp", F.col("x.at.r").alias("r"), F.col("x.at.c").alias("c"), F.col("x.own").alias("own"))
    cells = dealt.repartition("anchor", "r", "c").sortWithinPartitions("anchor", "r", "c")

    def compare_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells follow one another; the open one, of at most two blocks, is carried from batch to batch."""
        open_ = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            open_ = pa.concat_tables([open_, rows]) if open_ is not None else rows
            key = [open_[c].to_numpy() for c in ("anchor", "r", "c")]
            edge = np.flatnonzero(np.concatenate(([True], np.any([k[1:] != k[:-1] for k in key], 0)))) if len(open_) else [0]
            yield from cells_of(open_.slice(0, edge[-1]), edge)
            open_ = open_.slice(edge[-1])
        if open_ is not None and len(open_):
            yield from cells_of(open_, np.array([0, len(open_)]))

    def cells_of(rows: pa.Table, edge: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(rows):
            return
        fp, own = rows["fp"].to_numpy().view(np.uint64), rows["own"].to_numpy()
        left, right = [], []
        for s, e in zip(edge[:-1].tolist(), edge[1:].tolist()):
            mine = own[s:e]
            if mine.any() and not mine.all():
                a, b = compare(fp[s:e][mine], fp[s:e][~mine], threshold)
                left.append(a)
                right.append(b)
        if left:
            a, b = np.concatenate(left), np.concatenate(right)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return cells.mapInArrow(compare_cells, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``fp`` (long) and ``component_id``, the smallest id that links lead to."""
    marked = written(fingerprint(docs, id_col, text_col))
    least = written(marked.groupBy("fp").agg(F.min(id_col).alias("least")))
    joined = written(components(links(least)))
    label = joined.join(least, joined["node"] == least["fp"]).groupBy("root").agg(F.min("least").alias("component_id"))
    of_linked = joined.join(label, "root").select(F.col("node").alias("fp"), "component_id")
    of_all = least.join(of_linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return marked.join(of_all, "fp")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """One row of each component, all columns kept: the one with the least id (null ids last), then the least digest of
    the text; of rows that repeat both, any one."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    name = F.md5(F.concat(F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("-")), F.lit("\0"), text))
    keyed = docs.select(F.struct("*").alias("doc"), name.alias("name"))
    rows = docs.select(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), name.alias("name")).alias("row"), text.alias("text"))
    # Narrow rows decide; the texts travel once, and copies of a row meet before they do.
    least = written(fingerprint(rows, "row", "text", shingle).groupBy("fp").agg(F.min("row").alias("row")))
    joined = written(components(links(least, threshold)))
    pick = least.join(joined, least["fp"] == joined["node"], "left").groupBy(F.coalesce("root", "fp").alias("root")) \
        .agg(F.min("row").alias("row")).select("row.name")
    return keyed.dropDuplicates(["name"]).join(pick, "name", "left_semi").select("doc.*")


@query("op5_simhash")
def op5(spark, sf):
    """Fingerprint and component of all documents; no SQL twin (hash and components)."""
    found = near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
