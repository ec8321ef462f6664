"""Latest version at or before an event, per key, without pairing rows.

Events and versions are merged per (key, time bucket) and the last version seen
is carried forward; what was valid when a bucket opens comes from one row per
bucket.  A hot key is spread over its buckets and no side is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(events: DataFrame, versions: DataFrame, on: str, ts: str = "ts", valid_from: str = "valid_from",
              value: str = "policy", bucket_seconds: int = 3600) -> DataFrame:
    """Add ``value`` of the version with the greatest ``valid_from <= ts``; null when there is none."""
    bucket = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / (bucket_seconds * 1_000_000)).cast("long")
    vs = versions.select(F.col(on).alias("__k"), bucket(F.col(valid_from)).alias("__b"), F.col(valid_from).alias("__t"),
                         F.struct(F.col(value).alias("v")).alias("__v"))
    ev = events.select(F.col(on).alias("__k"), bucket(F.col(ts)).alias("__b"), F.col(ts).alias("__t"),
                       F.struct(*events.columns).alias("__e"))
    # One row per key and bucket: the version a bucket leaves behind.
    slots = (ev.groupBy("__k", "__b").agg(F.lit(None).cast(vs.schema["__v"].dataType).alias("__v"))
             .unionByName(vs.groupBy("__k", "__b").agg(F.max_by("__v", "__t").alias("__v")))
             .groupBy("__k", "__b").agg(F.first("__v", ignorenulls=True).alias("__v")))
    before = Window.partitionBy("__k").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carry = slots.select(F.col("__k").alias("__ck"), F.col("__b").alias("__cb"),
                         F.last("__v", ignorenulls=True).over(before).alias("__carry"))
    merged = ev.unionByName(vs, allowMissingColumns=True)
    run = Window.partitionBy("__k", "__b").orderBy("__t", F.col("__e").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    seen = merged.withColumn("__now", F.last("__v", ignorenulls=True).over(run)).where(F.col("__e").isNotNull())
    joined = seen.join(carry, seen["__k"].eqNullSafe(carry["__ck"]) & seen["__b"].eqNullSafe(carry["__cb"]), "left")
    return joined.select("__e.*", F.coalesce("__now", "__carry")["v"].alias(value))
