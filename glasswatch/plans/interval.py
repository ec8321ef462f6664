"""Pairs of rows of one key whose times lie within a bound of each other.

A stream joins a stream: both sides carry a watermark and the bound is part of the condition, so a row leaves the state as soon
as no later row can match it, and the state holds about ``within`` plus the watermark of each side, whatever the streams' age.
Tables join by range buckets: times are dealt to buckets as wide as the bound, a left row looks into its own bucket and the one before,
and the bound decides inside.  A hot key is so spread over time instead of being paired with itself.

Both forms give the same pairs: left time - ``within`` <= right time <= left time, both ends included; rows without a key or a time pair with
nothing; repeated rows pair each.  A stream leaves out rows that come later than its watermark allows; whatever the two sides
name alike is prefixed on the right.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interval_join(left: DataFrame, right: DataFrame, on: str, within_seconds: int, ts: str = "ts", right_ts: str = "ts",
                  prefix: str = "prior_", watermark: str = "10 minutes") -> DataFrame:
    """Each left row with every right row of its key at most ``within_seconds`` before it: the left columns, and the right ones
    but the key under ``prefix``."""
    if left.isStreaming != right.isStreaming:
        raise ValueError("both sides must be streams, or both tables")
    if within_seconds <= 0:
        raise ValueError("the bound must be positive")
    names = [c for c in right.columns if c != on]
    others = right.select(F.col(on).alias("__on"), *(F.col(c).alias(prefix + c) for c in names))
    there = prefix + right_ts
    near = F.expr(f"`{there}` <= `{ts}` AND `{there}` >= `{ts}` - INTERVAL {int(within_seconds)} SECONDS")
    if left.isStreaming:
        timed, prior = left.withWatermark(ts, watermark), others.withWatermark(there, watermark)
        return timed.join(prior, (F.col(on) == F.col("__on")) & near).drop("__on")
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (within_seconds * 1_000_000)).cast("long")
    looks = left.withColumn("__at", F.explode(F.array(bucket(ts), bucket(ts) - 1)))
    held = others.withColumn("__bucket", bucket(there))
    return looks.join(held, (F.col(on) == F.col("__on")) & (F.col("__at") == F.col("__bucket")) & near).drop("__on", "__at", "__bucket")
