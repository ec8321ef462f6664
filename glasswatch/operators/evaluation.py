"""Rule evaluation: corpus cases and precision/recall against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glasswatch.operators.scan import scan
from glasswatch.operators.sessions import scan_turn_arrays
from glasswatch.rules.catalog import THREATS
from glasswatch.rules.detectors import DETECTORS

CASE_TYPE = "id string, text string, turns array<string>, stage string, expect int, none boolean"


def evaluate_cases(cases: DataFrame, *, detectors=DETECTORS, threats=THREATS) -> DataFrame:
    """Add ``found`` threat ids, ``ok`` and ``why``.  A case has text (stage
    defaults to prompt) or turns; it expects one threat or nothing at all."""
    work = scan(cases, "text", F.coalesce(F.col("stage"), F.lit("prompt")), detectors=detectors, threats=threats,
                into="__single")
    work = scan_turn_arrays(work, "turns", detectors=detectors, threats=threats).withColumnRenamed("findings", "__multi")
    picked = F.when(F.col("turns").isNotNull(), F.col("__multi")).otherwise(F.col("__single"))
    work = work.withColumn("found", F.transform(picked, lambda f: f["threat_id"]))
    ok = F.when(F.coalesce("none", F.lit(False)), F.size("found") == 0).otherwise(F.array_contains("found", F.col("expect")))
    got = F.coalesce(F.nullif(F.array_join("found", ","), F.lit("")), F.lit("none"))
    why = F.when(F.coalesce("none", F.lit(False)), F.concat(F.lit("expected no findings, got "), got)).otherwise(
        F.concat(F.lit("expected threat "), F.col("expect").cast("string"), F.lit(", got "), got))
    return work.withColumn("ok", F.coalesce(ok, F.lit(False))).withColumn(
        "why", F.when(~F.col("ok"), why)).drop("__single", "__multi")


def score(evaluated: DataFrame) -> DataFrame:
    return evaluated.agg(F.count_if("ok").alias("passed"), F.count(F.lit(1)).alias("total"),
                         F.array_sort(F.collect_set(F.when(~F.col("ok"), F.col("id")))).alias("failed"))


def confusion(predicted: DataFrame, rule: str, hit: str, truth: str) -> DataFrame:
    """Per rule: confusion counts, precision and recall."""
    y, t = F.col(hit), F.col(truth)
    out = predicted.groupBy(rule).agg(
        F.count_if(y & t).alias("tp"), F.count_if(y & ~t).alias("fp"),
        F.count_if(~y & t).alias("fn"), F.count_if(~y & ~t).alias("tn"))
    return out.withColumn("precision", F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp")))) \
        .withColumn("recall", F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))))
