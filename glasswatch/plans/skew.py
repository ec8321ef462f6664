"""Ordered work per key that survives one key holding most of the rows.

A plain ``Window.partitionBy(key)`` sends a whole key to one task.  Here order
numbers come from fixed-width blocks: rows are counted per (key, block), only
the small block counts are summed per key, and windows run per (key, block of
ranks) with the few rows before the block copied in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def running_sum(df: DataFrame, key: str, order: str, value: Column, into: str, block: int = BLOCK) -> DataFrame:
    """Add ``into``: sum of ``value`` over the key's rows up to and including this
    one.  ``order`` is an integer, unique within its key."""
    b = "__block"
    work = df.withColumn("__v", value).withColumn(b, F.floor(F.col(order) / block).cast("long"))
    inner = Window.partitionBy(key, b).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    work = work.withColumn("__in", F.sum("__v").over(inner))
    totals = df.select(key, F.floor(F.col(order) / block).cast("long").alias(b), value.alias("__v")) \
        .groupBy(key, b).agg(F.sum("__v").alias("__t"))
    before = Window.partitionBy(key).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col(key).alias("__k"), F.col(b).alias("__b"),
                            F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__before"))
    # Null-safe, so rows without a key keep their place.
    joined = work.join(offsets, work[key].eqNullSafe(offsets["__k"]) & work[b].eqNullSafe(offsets["__b"]), "inner")
    return joined.withColumn(into, F.col("__in") + F.col("__before")).drop("__v", "__in", "__before", "__k", "__b", b)


def trailing_rows(df: DataFrame, key: str, rank: str, size: int, columns: dict[str, Column],
                  block: int = BLOCK) -> DataFrame:
    """Add window aggregates over the last ``size`` rows (this one included).

    ``rank`` is 1, 2, 3 ... within the key.  ``columns`` maps a new name to an
    aggregate Column such as ``F.collect_list('x')``."""
    if size < 1:
        raise ValueError("size must be positive")
    block = max(block, size)
    at = F.floor((F.col(rank) - 1) / block).cast("long")
    tail = (F.col(rank) - 1) % block >= block - (size - 1)
    # Rows near the end of a block are context for the next one too.
    homes = F.when(tail, F.array(at, at + 1)).otherwise(F.array(at))
    work = df.select("*", at.alias("__own"), F.explode(homes).alias("__block"))
    w = Window.partitionBy(key, "__block").orderBy(rank).rowsBetween(-(size - 1), 0)
    for name, agg in columns.items():
        work = work.withColumn(name, agg.over(w))
    return work.where(F.col("__own") == F.col("__block")).drop("__own", "__block")


def newest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int,
                   salts: int = 16, salt_on: Sequence[str] | None = None) -> DataFrame:
    """Top ``limit`` rows per key: first within salted parts of the key, then overall.

    The first pass leaves at most ``limit * salts`` rows of any key."""
    salt = F.pmod(F.xxhash64(*(salt_on or df.columns)), F.lit(salts))
    part = df.withColumn("__salt", salt)
    first = part.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys, "__salt").orderBy(*order))) \
        .where(F.col("__rn") <= limit).drop("__rn", "__salt")
    return first.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))) \
        .where(F.col("position") <= limit)


def salted_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", salts: int = 16,
                salt_on: Sequence[str] | None = None) -> DataFrame:
    """Equi-join a big, possibly skewed left side to a dimension of unproven size:
    left keys are spread over ``salts`` parts, each dimension row is repeated per part.  Without ``salt_on`` all columns
    that can be hashed (not maps) pick the part."""
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError("the repeated side must not be preserved")
    hashable = [f.name for f in left.schema if "map<" not in f.dataType.simpleString()]
    l = left.withColumn("__salt", F.pmod(F.xxhash64(*(salt_on or hashable)), F.lit(salts)).cast("int"))
    r = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return l.join(r, [*on, "__salt"], how).drop("__salt")
