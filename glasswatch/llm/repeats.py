"""Exact removal of repeated substrings, whole corpus, without sorting suffixes.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else.  Every such string holds an anchor: the
position with the least hash of SEED_BYTES bytes among those in the string.  Two copies of a string have the anchor at the
same offset, so only strings around anchors of equal surroundings need comparing:

1. Each anchor is keyed by the bytes that all its strings have in common: once for strings that reach far to its left, once
   for those that reach to its right.  Keys seen once cannot repeat and are left out.
2. Anchors with equal keys and equal whole surroundings repeat each other completely; one of them stands for all.
3. Where the surroundings of a key differ, hashes of the LENGTH-byte strings at each offset tell which offsets repeat.
   Keys with very many different surroundings are counted by Spark, string by string, rather than in one task.
4. Runs of removed bytes are merged per text.  Texts with equal bytes are worked on once; copies remove each other.

This replaces merging the Burrows-Wheeler transforms of shards: refining the interleave takes one pass over all bytes for
each byte of common prefix, so LENGTH passes over the corpus, each a shuffle (see README for figures).  Here every byte is
read twice and only anchors are shuffled.  Equality of strings is by two hashes modulo a prime, of whole texts by a
128-bit digest; lengths and clipping are part of each.

Null and empty texts have no bytes and lose none.  Repeated rows are copies of each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glasswatch.llm.common import mixed, prefix_hash, query, range_hash, sliding_hash, small, squeezed, table, text_bytes, unsqueezed, whole_groups, written

LENGTH, SEED_BYTES = 400, 32
# Different surroundings of one key that a task compares; keys with more are counted by Spark.
MEMBERS = 2048
HOT = 1000


def _sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least or greatest of each ``width`` neighbours, by prefixes and suffixes of blocks."""
    pick, fill = (np.minimum, np.uint64(2**64 - 1)) if least else (np.maximum, np.uint64(0))
    n = len(x) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    padded = np.full(-(-len(x) // width) * width, fill, np.uint64)
    padded[:len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = pick.accumulate(blocks, 1).ravel()
    behind = pick.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return pick(behind[:n], ahead[width - 1:width - 1 + n])


def anchors(seeds: np.ndarray, length: int = LENGTH, seed: int = SEED_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The position with the least seed hash of each string of ``length`` bytes, the first of equals: each anchor, and
    the least and most offset it has in the strings whose anchor it is (which follow one another)."""
    width, out = length - seed + 1, []
    # The low bits of a hash make room for the place, so the least of them names it; long texts go in stretches.
    mask = np.uint64((1 << 26) - 1)
    for at in range(0, len(seeds) - width + 1, 1 << 25):
        part = seeds[at:at + (1 << 25) + width - 1]
        least = _sliding(part & ~mask | np.arange(len(part), dtype=np.uint64), width, True)
        first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        last = np.concatenate((first[1:], [len(least)])) - 1
        place = (least[first] & mask).astype(np.int64)
        out.append((place + at, place - last, place - first))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def sides(length: int = LENGTH, seed: int = SEED_BYTES) -> list[tuple[int, int]]:
    """The offsets (least, most) of an anchor in the strings of each side."""
    most = length - seed
    return [(0, most // 2), (most // 2 + 1, most)]


def text_keys(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """128-bit digest of each text: texts of one key are taken to be copies."""
    raw = memoryview(data)
    return pa.array([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.binary())


def _anchor_rows(column: pa.Array, length: int, seed: int) -> list[pa.Array]:
    """cls, ctx, key and place of the anchors of a batch of texts."""
    data, offsets = text_bytes(column)
    prefix = prefix_hash(data)
    keys = text_keys(data, offsets)
    out = []
    for i in np.flatnonzero(np.diff(offsets) >= length).tolist():
        s, e = int(offsets[i]), int(offsets[i + 1])
        at, least, most = anchors(sliding_hash(prefix, s, e, seed), length, seed)
        for side, (low, high) in enumerate(sides(length, seed)):
            lo, hi = np.maximum(least, low), np.minimum(most, high)
            here = lo <= hi
            a, lo, hi = at[here] + s, lo[here], hi[here]
            cls = mixed(range_hash(prefix, a - low, a + length - high) + np.uint64(side))
            place = (a - s) << 24 | lo << 12 | hi
            ctx = mixed(range_hash(prefix, a - hi, a + length - lo) + (lo << 12 | hi).astype(np.uint64))
            out.append((cls.view(np.int64), ctx.view(np.int64), np.full(len(a), i), place))
    cls, ctx, text, place = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 4
    return [pa.array(cls), pa.array(ctx), keys.take(pa.array(text)), pa.array(place)]


def _windows(rows: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, offset and hash of every string of ``length`` bytes in some surroundings."""
    data, offsets = text_bytes(rows["bytes"].combine_chunks().cast(pa.large_binary()).view(pa.large_string()))
    prefix = prefix_hash(data)
    low, high = rows["lo"].to_numpy(), rows["hi"].to_numpy()
    n = high - low + 1
    row = np.repeat(np.arange(len(rows)), n)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = offsets[:-1][row] + step
    return row, high[row] - step, range_hash(prefix, start, start + length)


def packed_texts(rows: DataFrame, text_col: str) -> DataFrame:
    """The rows with their text compressed (binary, same name) and ``key``, the digest of its bytes."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString() if f.name != text_col else 'binary'}" for f in rows.schema.fields)
    columns = rows.columns
    place = columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, place):
            data, offsets = text_bytes(batch.column(place))
            raw = data.tobytes()
            packed = pa.array([squeezed(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([packed if k == place else c for k, c in enumerate(batch.columns)] + [text_keys(data, offsets)], [*columns, "key"])

    return rows.mapInArrow(run, f"{kinds}, key binary")


def _around(docs: DataFrame, wanted: DataFrame, text_col: str, length: int) -> DataFrame:
    """The wanted surroundings with their bytes, each once."""
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keyed = packed_texts(texts.where(F.octet_length("text") >= length), "text")
    group = ["cls", "ctx"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = unsqueezed(text)
                for w in wanted:
                    at, lo, hi = w["place"] >> 24, w["place"] >> 12 & 4095, w["place"] & 4095
                    out.append((w["cls"], w["ctx"], lo, hi, raw[at - hi:at - lo + length]))
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (*[pa.int64()] * 4, pa.binary()))], [*group, "lo", "hi", "bytes"])

    by_text = wanted.groupBy("key").agg(F.collect_list("w").alias("wanted"))
    # One row of each text: a copy would send every surrounding again.
    one = keyed.join(by_text.select("key"), "key", "left_semi").dropDuplicates(["key"])
    return one.join(by_text, "key").select("text", "wanted").mapInArrow(cut, "cls long, ctx long, lo long, hi long, bytes binary")


def repeated_ranges(docs: DataFrame, text_col: str = "text", length: int = LENGTH, seed: int = SEED_BYTES, members: int = MEMBERS) -> DataFrame:
    """(key, lo, hi): byte ranges to remove from the texts of each content key, not merged."""
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    names = ("cls", "ctx", "key", "place")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 0):
            yield pa.RecordBatch.from_arrays(_anchor_rows(batch.column(0), length, seed), list(names))

    found = written(texts.mapInArrow(find, "cls long, ctx long, key binary, place long"))
    # Keys that occur once cannot repeat.  Those with over a HOT-th of all anchors, fewer than HOT, are known by name and
    # go to no join, so that none fills a task.
    sizes = written(found.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    total = found.count()
    often = [r[0] for r in sizes.where(F.col("n") * HOT > total).select("cls").collect()]
    is_often = F.array_contains(F.lit(often).cast("array<long>"), F.col("cls"))
    rest = found.where(~is_often).join(sizes.where(~is_often), "cls", "left_semi")
    held = written(found.where(is_often).unionByName(rest).distinct())
    group = ["cls", "ctx"]
    spot = F.struct("key", "place")
    alike = written(held.groupBy(*group).agg(F.min(spot).alias("one"), F.max(spot).alias("other"))
                    .select(*group, "one.*", (F.col("one") != F.col("other")).alias("whole")))
    several = alike.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Surroundings that are not alone under their key, with their bytes from the one text that stands for them.
    wanted = alike.join(several, "cls").select("key", "n", F.struct(*group, "place").alias("w"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _ in whole_groups(batches, ("cls",)):
            row, offset, h = _windows(rows, length)
            cls, ctx = (rows[c].to_numpy()[row] for c in group)
            order = np.lexsort((ctx, h, offset, cls))
            a, b = order[:-1], order[1:]
            equal = (cls[a] == cls[b]) & (offset[a] == offset[b]) & (h[a] == h[b])
            run = np.cumsum(np.concatenate(([True], ~equal))) - 1
            differs = np.zeros(run[-1] + 1, bool)
            differs[run[1:][equal & (ctx[a] != ctx[b])]] = True
            hit = order[differs[run]]
            yield pa.RecordBatch.from_arrays([pa.array(cls[hit]), pa.array(ctx[hit]), pa.array(offset[hit])], [*group, "o"])

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            row, offset, h = _windows(rows, length)
            cls, ctx = (rows[c].to_numpy()[row] for c in group)
            yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(ctx), pa.array(offset), pa.array(h.view(np.int64))], [*group, "o", "h"])

    few = _around(docs, wanted.where(F.col("n") <= members), text_col, length).repartition("cls").sortWithinPartitions("cls") \
        .mapInArrow(compare, "cls long, ctx long, o long")
    strings = _around(docs, wanted.where(F.col("n") > members), text_col, length).mapInArrow(explode, "cls long, ctx long, o long, h long").distinct()
    twice = strings.groupBy("cls", "o", "h").agg(F.min("ctx").alias("c0"), F.max("ctx").alias("c1")).where("c0 <> c1").select("cls", "o", "h")
    many = strings.join(twice, ["cls", "o", "h"], "left_semi").select(*group, "o")
    edges = few.unionByName(many).groupBy(*group).agg(F.min("o").alias("o0"), F.max("o").alias("o1"))
    # All strings of one side overlap, so what repeats on a side is one range.
    verdict = written(alike.select(*group, "whole").join(edges, group, "left").where(F.col("whole") | F.col("o0").isNotNull()))
    at, low, high = F.shiftright("place", 24), F.shiftright("place", 12).bitwiseAND(F.lit(4095)), F.col("place").bitwiseAND(F.lit(4095))
    return held.join(verdict, group).select(
        "key", (at - F.when(F.col("whole"), high).otherwise(F.col("o1"))).alias("lo"),
        (at - F.when(F.col("whole"), low).otherwise(F.col("o0")) + length).alias("hi")).distinct()


def _merged(ranges: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, seed: int = SEED_BYTES, members: int = MEMBERS) -> DataFrame:
    """One row per document: id, n_bytes, removed (array of byte ranges), kept (binary)."""
    ranges = repeated_ranges(docs, text_col, length, seed, members).groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    keyed = packed_texts(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")), "text")
    copies = keyed.groupBy("key").count().where("count > 1").select("key", F.lit(True).alias("copied"))
    known = ranges.join(copies, "key", "full")
    id_type = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, spans, kept = [], [], []
            for text, ranges, copied in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                raw = unsqueezed(text)
                gone = [[0, len(raw)]] if copied and len(raw) >= length else _merged([(r["lo"], r["hi"]) for r in ranges or ()])
                edge = [0, *(x for r in gone for x in r), len(raw)]
                sizes.append(len(raw))
                spans.append(gone)
                kept.append(b"".join(raw[a:b] for a, b in zip(edge[::2], edge[1::2])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                                              pa.array(kept, pa.binary())], ["id", "n_bytes", "removed", "kept"])

    return keyed.join(known, "key", "left").select("id", "text", "ranges", "copied") \
        .mapInArrow(cut, f"id {id_type}, n_bytes long, removed array<array<long>>, kept binary").withColumnRenamed("id", id_col)


@query("op4_repeated_substrings")
def op4(spark, sf):
    """All documents without their repeated strings; no SQL twin (every start of every text)."""
    found = remove(table(spark, sf, "documents"))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
                        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
