"""Language-model scoring by Elias-Fano n-gram tries.

Trigram model with Dirichlet smoothing: p1(w) = (c + 0.5) / (N + 0.5 (V + 1)), p2 = (c(vw) + MU2 p1) / (c(v) + MU2),
p3 = (c(uvw) + MU3 p2) / (c(uv) + MU3); the first token of a text is scored by p1, the second by p2.

Documents are read once into blocks of bounded bytes, stored as arrays of block-local token numbers.  Distinct words of
blocks, not tokens, are counted and given numbers by frequency; as counts fall with the number, a table of the distinct
counts (of which there are fewer than sqrt(2 N)) turns a number into its count.  Each block then sends its distinct trigrams,
with their training counts, to shards by a hash of the middle word; frequent middle words are split further by the first
word, and their bigrams go by both words, so neither a frequent word nor a frequent pair makes a large shard.  A shard
builds its tries: contexts as an Elias-Fano sequence, monotone Elias-Fano pointers to their successors, successors as one
Elias-Fano sequence that is monotone because each context's words are written relative to a base that grows from context
to context, and a quantised log-count for each, from which the smoothed probability follows.  The levels are one memory-mapped file.  A query finds its context, then its word by successor search
relative to that context's base.  Codes go back to the blocks, which add up the smoothed probabilities.

Null and empty texts are one end mark.  Null ids are in no held-out fold.  With no training text every base probability is
1 (the formula with N = V = 0), and so is the model's.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from glasswatch.llm.common import lower_ascii, mixed, prefix_hash, query, range_hash, small, table, text_bytes, words, written

BLOCK_BYTES = 8 << 20
# Distinct n-grams that a shard holds on average.
SHARD = 1_500_000
MU2, MU3 = 60.0, 1.0
END = np.uint64(0x5E0D5E0D5E0D5E0D)
_CODEC = "zstd"


# --- Elias-Fano -------------------------------------------------------------------------------------------------------

class EliasFano:
    """A monotone sequence of unsigned numbers: low bits packed, high bits in unary with a count per 64-bit word."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray, ones: np.ndarray):
        self.n, self.width, self.low, self.high, self.zeros, self.ones = n, width, low, high, zeros, ones

    @classmethod
    def of(cls, values: np.ndarray) -> "EliasFano":
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, min(56, (top // max(n, 1)).bit_length() - 1))
        packed = np.zeros(n * width // 64 + 3, np.uint64)
        part = values & np.uint64((1 << width) - 1)
        if n and width:
            at = np.arange(n, dtype=np.int64) * width
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            # Numbers that begin in one 64-bit word are or-ed together, and what runs over goes to the next word.
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            packed[word[first]] = np.bitwise_or.reduceat(part << shift, first)
            over = np.flatnonzero((at & 63) + width > 64)
            packed[word[over] + 1] |= part[over] >> (np.uint64(64) - shift[over])
        low = packed.view(np.uint8)
        ups = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        raw = np.zeros((int(ups[-1]) if n else 0) + 2, np.uint8)
        raw[ups] = 1
        raw = np.concatenate((raw, np.zeros(-len(raw) % 64, np.uint8)))
        high = np.packbits(raw, bitorder="little").view(np.uint64)
        ones = np.concatenate(([0], np.cumsum(np.bitwise_count(high).astype(np.int64))))
        zeros = np.arange(len(ones), dtype=np.int64) * 64 - ones
        return cls(n, width, low, high, zeros.astype(np.uint32), ones.astype(np.uint32))

    def parts(self) -> list[np.ndarray]:
        return [self.low, self.high.view(np.uint8), self.zeros.view(np.uint8), self.ones.view(np.uint8)]

    def _select(self, counts: np.ndarray, words_: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Position of the k-th (from 0) set bit of ``words_``, of which ``counts`` stand before each word."""
        word = np.searchsorted(counts, k, "right") - 1
        rest = (k - counts[word]).astype(np.int64)
        bits = words_(word)
        place = np.zeros(len(k), np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            part = np.bitwise_count((bits >> place.astype(np.uint64)) & np.uint64((1 << step) - 1)).astype(np.int64)
            go = part <= rest
            rest -= np.where(go, part, 0)
            place += np.where(go, step, 0)
        return word * 64 + place

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at positions."""
        ups = self._select(self.ones, lambda w: self.high[w], i) - i
        return ups.astype(np.uint64) << np.uint64(self.width) | self._low(i)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.int64) * self.width
        view = np.ndarray((len(self.low) - 7,), "<u8", self.low, strides=(1,))
        return (view[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.width) - 1)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Position of the first value that is at least x; n if there is none."""
        x = x.astype(np.uint64)
        up = (x >> np.uint64(self.width)).astype(np.int64)
        last = len(self.high) * 64 - int(self.ones[-1]) - 1
        # Values with high part ``up`` stand between zeros up - 1 and up of the unary part.
        stop = self._select(self.zeros, lambda w: ~self.high[w], np.minimum(up, last)) - np.minimum(up, last)
        stop = np.minimum(stop, self.n)
        before = self._select(self.zeros, lambda w: ~self.high[w], np.clip(up - 1, 0, last)) - np.clip(up - 1, 0, last)
        lo = np.where(up > 0, np.minimum(before, self.n), 0)
        hi = stop.copy()
        low = x & np.uint64((1 << self.width) - 1)
        while True:  # halves the stretch of equal high parts
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < low[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)


class Trie:
    """Contexts, their successors and a code for each, in one memory-mapped file."""

    def __init__(self, context: np.ndarray, word: np.ndarray, code: np.ndarray, folder: str | None = None):
        """n-grams sorted by (context, word), distinct."""
        start = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))) if len(context) else np.zeros(0, np.int64)
        # Word numbers count up from the last word of the context before: each context has a base, and all are monotone.
        size = np.diff(np.concatenate((start, [len(word)])))
        room = word[start + size - 1] + np.uint64(1) if len(start) else np.zeros(0, np.uint64)
        base = np.concatenate(([0], np.cumsum(room)))[:-1].astype(np.uint64) if len(start) else room
        levels = [EliasFano.of(context[start]), EliasFano.of(np.concatenate((start, [len(word)]))), EliasFano.of(base),
                  EliasFano.of(word + np.repeat(base, size))]
        self.file = tempfile.TemporaryFile(dir=folder)
        shape, at = [], 0
        for level in levels:
            for part in level.parts():
                self.file.write(part.tobytes())
                self.file.write(bytes(-len(part) % 8))
                shape.append((at, len(part)))
                at += len(part) + -len(part) % 8
        self.file.write(code.astype("<u2").tobytes() or b"\0\0")
        self.file.flush()
        memory = np.memmap(self.file, np.uint8, "r")
        self.codes = memory[at:].view(np.uint16)
        cut = [memory[a:a + n] for a, n in shape]
        self.contexts, self.pointers, self.bases, self.words = (
            EliasFano(level.n, level.width, cut[4 * k], cut[4 * k + 1].view(np.uint64), cut[4 * k + 2].view(np.uint32), cut[4 * k + 3].view(np.uint32))
            for k, level in enumerate(levels))

    def __enter__(self) -> "Trie":
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Code of each n-gram, 0 for those not there.  Queries sorted by context read each level in order."""
        out = np.zeros(len(context), np.uint16)
        if not self.contexts.n or not len(context):
            return out
        first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
        node = self.contexts.successor(context[first])
        there = node < self.contexts.n
        node = np.minimum(node, self.contexts.n - 1)
        there &= self.contexts.get(node) == context[first]
        end, base = self.pointers.get(node + 1), self.bases.get(node)
        begin = self.pointers.get(node)
        top = self.words.get(end.astype(np.int64) - 1) - base
        size = np.diff(np.concatenate((first, [len(context)])))
        keep = np.repeat(there, size)
        keep &= word <= np.repeat(top, size)
        rows = np.flatnonzero(keep)
        goal = word[rows] + np.repeat(base, size)[rows]
        at = self.words.successor(goal)
        ok = (at < np.repeat(end.astype(np.int64), size)[rows]) & (at >= np.repeat(begin.astype(np.int64), size)[rows])
        rows, at, goal = rows[ok], at[ok], goal[ok]
        hit = self.words.get(at) == goal
        out[rows[hit]] = self.codes[at[hit]]
        return out


_EXACT, _STEP = 1 << 14, 1.0006


def quantise(count: np.ndarray) -> np.ndarray:
    """Counts as 16-bit codes: exact below 2**14, then logarithmic in steps of 0.06 %."""
    big = _EXACT + np.round(np.log(np.maximum(count, _EXACT) / _EXACT) / np.log(_STEP))
    return np.where(count < _EXACT, count, np.minimum(big, 65535)).astype(np.uint16)


def restored(code: np.ndarray) -> np.ndarray:
    code = code.astype(np.float64)
    return np.where(code < _EXACT, code, _EXACT * _STEP ** (np.maximum(code, _EXACT) - _EXACT))


# --- Blocks -----------------------------------------------------------------------------------------------------------

def _pack(x: np.ndarray) -> bytes:
    """Length, then the bytes of the numbers plane by plane, compressed: high planes are mostly zeros."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, _CODEC, asbytes=True)


def _unpack(raw: bytes, kind: type) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(pa.decompress(raw[8:], n, _CODEC, asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).ravel() if n else np.zeros(0, kind)


def blocks(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK_BYTES) -> DataFrame:
    """Tokens of all documents, some at a time: block, ids, train, lengths (words and end), words (hashes), seen (their
    counts in training texts) and tokens (numbers into words, packed)."""
    id_type = docs.schema[id_col].dataType
    arrow_id = to_arrow_type(id_type)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(training, F.lit(True)).alias("train"), F.col(text_col).cast("string").alias("text"))

    def hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
        """Word hashes with an end after each text, words of each text, bytes."""
        data, offsets = text_bytes(column)
        start, end, first = words(data, offsets)
        h = range_hash(prefix_hash(lower_ascii(data)), start, end)
        n = np.diff(first)
        tokens = np.full(len(h) + len(n), END, np.uint64)
        tokens[np.arange(len(h)) + np.repeat(np.arange(len(n)), n)] = h
        return tokens, n, len(data)

    def block(number: int, held: list[tuple]) -> pa.RecordBatch:
        whole = pa.Table.from_batches([x[0] for x in held])
        tokens, n = (np.concatenate([x[k] for x in held]) for k in (1, 2))
        train = whole["train"].to_numpy()
        vocabulary, local, times = np.unique(tokens, return_inverse=True, return_counts=True)
        order = np.argsort(-times, kind="stable")  # frequent words get small numbers, which pack better
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        vocabulary, local = vocabulary[order], rank[local]
        seen = np.bincount(local, np.repeat(train, n + 1), len(vocabulary)).astype(np.int64)
        one = lambda x, t: pa.array([x], pa.list_(t))
        return pa.RecordBatch.from_arrays([
            pa.array([number], pa.int64()), pa.array([whole["id"].to_pylist()], pa.list_(arrow_id)), one(train, pa.bool_()), one(n + 1, pa.int64()),
            one(vocabulary.view(np.int64), pa.int64()), one(seen, pa.int64()), pa.array([_pack(local.astype(np.uint32))], pa.binary())],
            ["block", "ids", "train", "lengths", "words", "seen", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, used = TaskContext.get().partitionId() << 32, [], 0
        for batch in small(batches, 2):
            tokens, n, taken = hashed(batch.column(2))
            held.append((batch.select(["id", "train"]), tokens, n))
            used += taken
            if used >= size:
                yield block(number, held)
                number, held, used = number + 1, [], 0
        if held:
            yield block(number, held)

    return rows.mapInArrow(run, f"block long, ids array<{id_type.simpleString()}>, train array<boolean>, lengths array<long>, "
                                "words array<long>, seen array<long>, tokens binary")


def _numbered(read: DataFrame) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(word, number) of the training words, numbers by falling count; the distinct counts, falling, and the first
    number of each, with the number of words at the end."""
    counts = read.select(F.explode(F.arrays_zip("words", "seen")).alias("x")).where("x.seen > 0") \
        .groupBy(F.col("x.words").alias("word")).agg(F.sum("x.seen").alias("count"))
    placed = written(counts.orderBy(F.desc("count"), "word").withColumn("pos", F.monotonically_increasing_id()))
    part = F.shiftright("pos", 33)
    sizes = {r[0]: r[1] for r in placed.groupBy(part.alias("p")).count().collect()}
    before, total = [], 0
    for p in range(max(sizes, default=0) + 1):
        before.append(str(total))
        total += sizes.get(p, 0)
    number = F.get(F.split(F.lit(",".join(before)), ",").cast("array<long>"), part.cast("int")) + F.col("pos").bitwiseAND(F.lit((1 << 33) - 1))
    steps = sorted(((r[0], r[1]) for r in placed.groupBy(F.col("count").alias("c")).agg(F.count(F.lit(1))).collect()), reverse=True)
    value, size = (np.array(x, np.int64) for x in zip(*steps)) if steps else (np.zeros(0, np.int64),) * 2
    return placed.select("word", number.alias("number")), value, np.concatenate(([0], np.cumsum(size)))


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows of a batch of blocks; arrays stay Arrow arrays."""
    for r in range(len(batch)):
        cells = {name: batch.column(name)[r] for name in batch.schema.names}
        yield {name: x.values if isinstance(x, pa.ListScalar) else x for name, x in cells.items()}


UNKNOWN, START, PAIR = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD  # numbers of no word: not in training, no first word, a bigram's mark


class _Grams:
    """Distinct n-grams of a block in the order in which they are sent, and where each token finds its own."""

    def __init__(self, row: dict[str, pa.Array], steps: tuple[np.ndarray, np.ndarray], shards: int, limit: float):
        value, first = steps
        self.number = _unpack(row["numbers"].as_py(), np.uint32)
        step = np.searchsorted(first, self.number, "right") - 1
        self.count = np.concatenate((value, [0]))[np.minimum(step, len(value))]
        number = np.concatenate((self.number, [START])).astype(np.uint64)
        self.local = t = _unpack(row["tokens"].as_py(), np.uint32).astype(np.int64)
        self.lengths = row["lengths"].to_numpy()
        self.owner = owner = np.repeat(np.arange(len(self.lengths)), self.lengths)
        train = row["train"].to_numpy(zero_copy_only=False)[owner]
        m = len(number)
        self.at = at = np.flatnonzero(owner[1:] == owner[:-1]) + 1
        self.third = np.zeros(len(t), bool)  # tokens with two before them
        self.third[at[1:]] = owner[at[1:] - 2] == owner[at[1:]] if len(at) else False
        if len(at):
            self.third[at[0]] = at[0] > 1 and owner[at[0] - 2] == owner[at[0]]
        # An n-gram with an unseen word has not been seen and is not sent.  One whose first word alone is unseen goes as if
        # it had none, since it also asks for the pair of its last two.
        u = np.where(self.third[at] & (number[t[at - 2]] != UNKNOWN), t[at - 2], m - 1)
        key, self.back = np.unique((u * m + t[at - 1]) * m + t[at], return_inverse=True)
        seen = np.bincount(self.back, train[at], len(key)).astype(np.uint32)
        w, v, u = key % m, key // m % m, key // (m * m)
        split = lambda x: np.ceil(self.count[x] / limit).astype(np.uint64)
        parts = np.maximum(split(v), 1)
        shard = mixed(mixed(number[v]) + mixed(number[u]) % parts) % np.uint64(shards)
        sent = [(shard, number[u], number[v], number[w], seen)]
        # Bigrams of middle words that are split.
        self.hot = at[split(t[at - 1]) > 1]
        key2, self.back2 = np.unique(t[self.hot - 1] * m + t[self.hot], return_inverse=True)
        v, w = key2 // m, key2 % m
        shard = mixed(mixed(number[v]) + mixed(number[w] + np.uint64(PAIR))) % np.uint64(shards)
        sent.append((shard, np.full(len(v), PAIR, np.uint64), number[v], number[w], np.bincount(self.back2, train[self.hot], len(v)).astype(np.uint32)))
        self.n_triples = len(key)
        columns = [np.concatenate(c) for c in zip(*sent)]
        self.n_grams = len(columns[0])
        known = np.flatnonzero(np.all([c != UNKNOWN for c in columns[1:4]], 0))
        self.order = known[np.argsort(columns[0][known].astype(np.uint32), kind="stable")]
        self.columns = [columns[0][self.order].astype(np.int64), *(c[self.order].astype(np.uint32) for c in columns[1:])]

    def scores(self, codes: np.ndarray, pairs: np.ndarray, n_train: int, n_vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Base score, model score and number of known tokens of each document; codes in the order sent."""
        triple, pair_of = np.zeros(self.n_grams), np.zeros(self.n_grams)
        triple[self.order], pair_of[self.order] = restored(codes), restored(pairs)
        c = self.count[self.local].astype(np.float64)
        p1 = (c + 0.5) / (n_train + 0.5 * (n_vocabulary + 1))
        p = p1.copy()
        pair = np.zeros(len(c))  # training count of the pair that ends at a token
        pair[self.at] = pair_of[:self.n_triples][self.back]
        pair[self.hot] = triple[self.n_triples:][self.back2]
        p[self.at] = (pair[self.at] + MU2 * p1[self.at]) / (c[self.at - 1] + MU2)
        known = np.zeros(len(c))
        known[self.at] = triple[:self.n_triples][self.back]
        at = np.flatnonzero(self.third)
        p[at] = (known[at] + MU3 * p[at]) / (pair[at - 1] + MU3)
        total = lambda x: np.bincount(self.owner, x, len(self.lengths))
        return total(np.log10(p1)), total(np.log10(p)), total(c > 0).astype(np.int64)


def _codes(context: np.ndarray, word: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Trie codes of the n-grams: built from those with training counts, asked for all."""
    order = np.lexsort((word, context))
    context, word = context[order], word[order]
    new = np.ones(len(order), bool)
    new[1:] = (context[1:] != context[:-1]) | (word[1:] != word[:-1])
    count = np.add.reduceat(n[order].astype(np.int64), np.flatnonzero(new)) if len(order) else np.zeros(0, np.int64)
    context, word, kept = context[new], word[new], count > 0
    with Trie(context[kept], word[kept], quantise(count[kept])) as trie:
        code = trie.find(context, word)
    out = np.empty(len(order), np.uint16)
    out[order] = code[np.cumsum(new) - 1]
    return out


def score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK_BYTES,
          shard_size: int = SHARD) -> DataFrame:
    """One row per document: id, n_tokens, n_known, train_tokens, base_score, score; learned from the rows for which
    ``training`` holds (or is null)."""
    id_type = docs.schema[id_col].dataType
    read = written(blocks(docs, training, id_col, text_col, size))
    vocabulary, value, first = _numbered(read)
    n_vocabulary, n_train = int(first[-1]), int((value * np.diff(first)).sum())
    n_tokens = read.select(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-n_tokens // shard_size))
    limit = max(1.0, n_tokens / shards / 4)
    steps = docs.sparkSession.sparkContext.broadcast((value, first))

    def number(rows: pa.Table) -> pa.Table:
        """The numbers of a block's words, in their order."""
        i, known = rows["i"].to_numpy(), rows["number"].to_numpy()
        out = np.full(rows["size"][0].as_py(), UNKNOWN, np.uint32)
        out[i] = np.where(np.isnan(known), UNKNOWN, known).astype(np.uint32) if known.dtype.kind == "f" else known
        return pa.table({"block": rows["block"].slice(0, 1), "numbers": pa.array([_pack(out)], pa.binary())})

    used = read.select("block", F.size("words").alias("size"), F.posexplode("words").alias("i", "word"))
    numbers = written(used.join(vocabulary, "word", "left").select("block", "size", "i", "number")
                      .groupBy("block").applyInArrow(number, "block long, numbers binary"))
    ready = read.drop("words", "seen").join(numbers, "block")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                grams = _Grams(row, steps.value, shards, limit)
                shard = grams.columns[0]
                edge = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True]))) if len(shard) else [0]
                for a, b in zip(edge[:-1], edge[1:]):
                    yield pa.RecordBatch.from_arrays([pa.array([shard[a]]), pa.array([row["block"].as_py()], pa.int64()), *(
                        pa.array([_pack(c[a:b])], pa.binary()) for c in grams.columns[1:])], ["shard", "block", "u", "v", "w", "n"])

    def answer(rows: pa.Table) -> pa.Table:
        u, v, w, n = ([_unpack(x.as_py(), np.uint32) for x in rows[c]] for c in "uvwn")
        edge = np.concatenate(([0], np.cumsum([len(x) for x in u])))
        u, v, w, n = (np.concatenate(x).astype(np.uint64) for x in (u, v, w, n))
        triple, pair = np.zeros(len(u), np.uint16), np.zeros(len(u), np.uint16)
        at = np.flatnonzero(u != START)
        triple[at] = _codes(mixed(mixed(u[at]) + v[at]) >> np.uint64(8), w[at], n[at])
        at = np.flatnonzero(u != PAIR)  # for split middle words these are parts, and the blocks do not look at them
        pair[at] = _codes(v[at], w[at], n[at])
        packed = lambda x: pa.array([_pack(x[a:b]) for a, b in zip(edge[:-1], edge[1:])], pa.binary())
        return pa.table({"block": rows["block"], "shard": rows["shard"], "codes": packed(triple), "pairs": packed(pair)})

    asked = ready.mapInArrow(send, "shard long, block long, u binary, v binary, w binary, n binary")
    told = asked.groupBy("shard").applyInArrow(answer, "block long, shard long, codes binary, pairs binary") \
        .groupBy("block").agg(F.collect_list(F.struct("shard", "codes", "pairs")).alias("told"))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                grams = _Grams(row, steps.value, shards, limit)
                parts = sorted(row["told"].to_pylist() if row["told"] is not None else (), key=lambda x: x["shard"])
                codes, pairs = (np.concatenate([np.zeros(0, np.uint16), *(_unpack(x[c], np.uint16) for x in parts)]) for c in ("codes", "pairs"))
                base, model, n_known = grams.scores(codes, pairs, n_train, n_vocabulary)
                yield pa.RecordBatch.from_arrays([
                    row["ids"], pa.array(grams.lengths), pa.array(n_known), pa.array(np.full(len(base), n_train)),
                    pa.array(base), pa.array(model)], ["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return ready.join(told, "block", "left") \
        .mapInArrow(add_up, f"id {id_type.simpleString()}, n_tokens long, n_known long, train_tokens long, base_score double, score double") \
        .withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 1, F.lit(False))


@query("op1_ngram_lm")
def op1(spark, sf):
    """Scores of all documents, learned from four fifths; no SQL twin (the base columns are checked by brute force)."""
    found = score(table(spark, sf, "documents"), ~held_out())
    return found.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
