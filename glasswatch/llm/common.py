"""Helpers shared by the operators: registration, shared storage, words of an Arrow batch."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from glasswatch.sources.readers import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
# Rows of one Arrow batch: long texts make larger batches than Spark's default can bear.
BATCH_ROWS = "500"


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
            return fn(spark, sf_dir)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run
    return add


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that the cluster names in spark.checkpoint.dir.  Where none is set, a local session
    (tests on one machine) gets a temporary one; a cluster has no folder that all machines see, so that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = tempfile.mkdtemp(prefix="glasswatch-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """The rows as a table in shared storage: lineage ends there and lost executors cost no rework."""
    path = folder or shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n + 1 offsets of each; nulls are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = column.fill_null("").cast(pa.large_string())
    if column.offset:
        column = pa.concat_arrays([column])
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8).copy()
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    data = data[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


# Bytes of text worked on at once where arrays take many times that: a worker keeps the memory between its tasks, and an
# executor may have two workers for each core.
SLICE_BYTES = 1 << 18


def slices(column: pa.Array, most: int = 4 << 20):
    """(first, length) of runs of texts of at most ``most`` bytes together (or one text), so that work arrays stay
    small whatever the batch."""
    sizes = pc.binary_length(column.cast(pa.large_string())).fill_null(0).to_numpy(zero_copy_only=False)
    first, used = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if used and used + n > most:
            yield first, k - first
            first, used = k, 0
        used += n
    if len(sizes) > first:
        yield first, len(sizes) - first


def small(batches, column: int, most: int = 4 << 20):
    """The batches, cut where the texts of one column get long together."""
    for batch in batches:
        for first, n in slices(batch.column(column), most):
            yield batch.slice(first, n)


def squeezed(raw: bytes) -> bytes:
    """Bytes packed for a shuffle: their number, then Zstandard."""
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def unsqueezed(packed: bytes) -> bytes:
    size = int.from_bytes(packed[:8], "little")
    return pa.decompress(packed[8:], size, "zstd", asbytes=True) if size else b""


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z become a-z; other bytes stay."""
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of bytes other than ASCII white space, and the first word of each text
    (n + 1 numbers).  Separators are ASCII, so runs of bytes are runs of characters."""
    gap = _SPACE[data]
    inside = ~gap
    start = inside.copy()
    start[1:] &= gap[:-1]
    end = inside.copy()
    end[:-1] &= gap[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    start[edges] = inside[edges]
    end[edges - 1] = inside[edges - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, offsets)


# Hashes of strings: two polynomials modulo the prime 2**31 - 1 with bases drawn once.  Two unlike strings of n bytes have
# one hash with probability (n / 2**31)**2 at most, whatever their bytes; modulo a power of two, some strings always would.
PRIME = np.uint64(2**31 - 1)
_rng = np.random.default_rng(20240229)
_TABLES = _rng.integers(1, 2**31 - 1, (2, 256), dtype=np.uint64)
_BASES = [int(x) for x in _rng.integers(2**16, 2**31 - 2, 2)]
# Powers kept by a worker, of each base and its inverse; longer texts compute theirs.
_KEPT = 6 << 20
# Numbers worked on at once, few enough to stay in a core's cache.
_STRETCH = 1 << 14
_powers: dict[int, np.ndarray] = {}


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, for x below 2**62; works in place."""
    for _ in range(2):
        high = x >> np.uint64(31)
        x &= PRIME
        x += high
    return np.minimum(x, x - PRIME, out=x)  # below the prime the difference wraps round


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1), modulo the prime."""
    held = _powers.get(base)
    if held is not None and len(held) >= n:
        return held[:n]
    out = np.ones(max(n, 1), np.uint64)
    done = 1 if held is None else len(held)
    if held is not None:
        out[:done] = held
    while done < n:
        more = min(done, n - done)
        out[done:done + more] = _reduced(out[:more] * np.uint64(pow(base, done, int(PRIME))))
        done += more
    if n <= _KEPT:
        _powers[base] = out
    return out[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """For both lanes n + 1 prefix sums of table[byte] * base**i."""
    out = np.zeros((2, len(data) + 1), np.uint64)
    for lane in range(2):
        power, carry = powers(_BASES[lane], len(data)), np.uint64(0)
        for at in range(0, len(data), _STRETCH):
            x = _TABLES[lane][data[at:at + _STRETCH]]
            x *= power[at:at + _STRETCH]
            _reduced(x)
            x[0] += carry
            carry = _reduced(np.cumsum(x, out=out[lane, at + 1:at + 1 + len(x)]))[-1]
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: all bits of the result depend on all bits of x."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _between(prefix: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
    """Both lanes of the hash of data[start:end] as one number; start and end are places or slices of them."""
    backs = [powers(pow(base, -1, int(PRIME)), prefix.shape[1]) for base in _BASES]
    n = start.stop - start.start if isinstance(start, slice) else len(start)
    out = np.empty(max(n, 0), np.uint64)
    cut = lambda x, a: slice(x.start + a, min(x.start + a + _STRETCH, x.stop)) if isinstance(x, slice) else x[a:a + _STRETCH]
    for at in range(0, n, _STRETCH):
        s, e = cut(start, at), cut(end, at)
        part = []
        for lane in range(2):
            x = prefix[lane][e] + (PRIME - prefix[lane][s])
            np.minimum(x, x - PRIME, out=x)
            x *= backs[lane][s]
            part.append(_reduced(x))
        np.bitwise_or(part[0] << np.uint64(31), part[1], out=out[at:at + _STRETCH])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end]; equal strings have equal hashes wherever they stand."""
    return mixed(_between(prefix, start, end) + (end - start).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def sliding_hash(prefix: np.ndarray, start: int, end: int, width: int) -> np.ndarray:
    """Hashes of all strings of ``width`` bytes in data[start:end]."""
    return mixed(_between(prefix, slice(start, end + 1 - width), slice(start + width, end + 1)))


__all__ = ["QUERIES", "SQL", "query", "table", "shared_folder", "written", "text_bytes", "lower_ascii", "words", "prefix_hash",
           "range_hash", "sliding_hash", "mixed", "powers"]


def whole_groups(batches, keys: tuple[str, ...]):
    """From batches sorted by ``keys``: tables of whole groups and the edges between them.  Only the group that is open at
    the end of a batch is carried on."""
    open_ = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        open_ = pa.concat_tables([open_, rows]) if open_ is not None else rows
        if not len(open_):
            continue
        columns = [open_[k].to_numpy() for k in keys]
        change = np.zeros(len(open_), bool)
        change[0] = True
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        edge = np.flatnonzero(change)
        if edge[-1]:
            yield open_.slice(0, edge[-1]), edge
        open_ = open_.slice(edge[-1])
    if open_ is not None and len(open_):
        yield open_, np.array([0, len(open_)])
