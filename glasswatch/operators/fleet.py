"""Fleet views over alerts, prompt events and audit entries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glasswatch.plans.skew import newest_per_key
from glasswatch.rules.detectors import DETECTORS

AUDIT_ACTIONS = ("blocked", "alert", "notify", "justify", "redacted", "override")


def risk_rollup(alerts: DataFrame, dims: Sequence[str] = ("category", "risk_level")) -> DataFrame:
    return alerts.rollup(*dims).agg(F.count(F.lit(1)).alias("alerts"), F.grouping_id().cast("int").alias("level"))


def risk_cube(alerts: DataFrame, dims: Sequence[str]) -> DataFrame:
    return alerts.cube(*dims).agg(F.count(F.lit(1)).alias("alerts"), F.grouping_id().cast("int").alias("level"))


def risk_sets(alerts: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """Explicit grouping sets, e.g. by threat, by category, by user."""
    dims = list(dict.fromkeys(c for s in sets for c in s))
    return alerts.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in dims]).agg(
        F.count(F.lit(1)).alias("alerts"), F.grouping_id().cast("int").alias("level"))


def risk_trend(alerts: DataFrame, width: str = "1 day", dims: Sequence[str] = ("risk_level",)) -> DataFrame:
    return alerts.groupBy(F.window("ts", width).alias("w"), *dims).agg(F.count(F.lit(1)).alias("alerts")) \
        .select(F.col("w.start").alias("window_start"), *dims, "alerts")


def prompt_outcomes(events: DataFrame, by: Sequence[str], width: str = "1 day") -> DataFrame:
    """Sent and blocked prompts, and findings per prompt, per window."""
    out = events.groupBy(*by, F.window("ts", width).alias("w")).agg(
        F.count_if(F.col("outcome") == "sent").alias("sent"), F.count_if(F.col("outcome") == "blocked").alias("blocked"),
        F.sum("findings").alias("findings"), F.count(F.lit(1)).alias("prompts"))
    return out.select(*by, F.col("w.start").alias("window_start"), "sent", "blocked", "findings", "prompts")


def detection_log(audit: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int = 100) -> DataFrame:
    """Newest entries per device that carry a threat or are overrides."""
    kept = audit.where(F.col("threat_id").isNotNull() | (F.col("action") == "override"))
    return newest_per_key(kept, keys, order, limit)


def audit_action_counts(audit: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts per action and the share of overridden notices."""
    out = audit.groupBy(*by).agg(*[F.count_if(F.col("action") == a).alias(a) for a in AUDIT_ACTIONS])
    shown = F.col("override") + F.col("blocked")
    return out.withColumn("override_rate", F.when(shown > 0, F.col("override") / shown))


def detectability_coverage(threats: DataFrame) -> DataFrame:
    """Threats and threats with an executed detector, per detectability class."""
    covered = sorted({d.threat_id for d in DETECTORS})
    return threats.groupBy("detect_class").agg(
        F.count(F.lit(1)).alias("threats"), F.count_if(F.col("threat_id").isin(*covered)).alias("with_detector"))


