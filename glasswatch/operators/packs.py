"""Organisation rule packs: data only, validated as a DataFrame, then compiled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glasswatch.functions.regex_dialect import Pattern, PatternError
from glasswatch.functions.text import js_number
from glasswatch.plans.skew import salted_join
from glasswatch.rules.detectors import DETECTORS
from glasswatch.rules.model import Detector

PACK_TYPE = ("pack_no int, pack_id string, detectors array<struct<detectorId:string,threatId:string,stage:string,"
             "mode:string,hint:string,patterns:array<string>,flags:string>>")
# Limits, guards and defaults are fixed values.
MAX_PATTERN = 400
MAX_ID = 40
MAX_HINT = 160
DEFAULT_HINT = "Custom (org policy) pattern matched"
NESTED_QUANTIFIER = r"\([^)]*[+*][^)]*\)\s*[+*]"
ADJACENT_QUANTIFIER = r"[+*}]\s*[+*]"


def slug(value: Column, fallback: str) -> Column:
    kept = F.substring(F.regexp_replace(F.coalesce(F.nullif(value, F.lit("")), F.lit(fallback)), r"[^A-Za-z0-9_-]", ""), 1, MAX_ID)
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit(fallback))


def pattern_problem(pattern: Column) -> Column:
    """Why a pattern string is refused before compilation, or null."""
    return (F.when(pattern.isNull() | (pattern == ""), "empty")
            .when(F.length(pattern) > MAX_PATTERN, "too long")
            .when(pattern.rlike(NESTED_QUANTIFIER), "nested quantifier")
            .when(pattern.rlike(ADJACENT_QUANTIFIER), "adjacent quantifier"))


def validate_packs(packs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per pack pattern with ``keys``, its normalised detector fields and ``problem`` (null = accepted)."""
    rules = packs.select(*keys, "pack_no", F.col("pack_id"), F.posexplode("detectors").alias("rule_no", "d"))
    rows = rules.select(*keys, "pack_no", "pack_id", "rule_no", "d", F.posexplode_outer("d.patterns").alias("pattern_no", "pattern"))
    number = js_number(F.col("d.threatId"))
    whole = number.isNotNull() & (number == F.floor(number))
    return rows.select(
        *keys, "pack_no", "rule_no", F.coalesce("pattern_no", F.lit(0)).alias("pattern_no"),
        F.concat(F.lit("pack:"), slug(F.col("pack_id"), "pack"), F.lit(":"), slug(F.col("d.detectorId"), "rule")).alias("detector_id"),
        F.when(whole, number.cast("int")).alias("threat_id"),
        F.when(F.col("d.stage") == "output", "output").otherwise("prompt").alias("stage"),
        F.when(F.col("d.mode") == "coach", "coach").otherwise("warn").alias("mode"),
        F.substring(F.coalesce(F.nullif(F.col("d.hint"), F.lit("")), F.lit(DEFAULT_HINT)), 1, MAX_HINT).alias("hint"),
        F.regexp_replace(F.coalesce(F.col("d.flags"), F.lit("")), "[^gimsuy]", "").alias("flags"),
        "pattern",
        F.when(~whole | number.isNull(), "threat is not an integer").otherwise(pattern_problem(F.col("pattern"))).alias("problem"))


def _pattern(source: str, flags: str) -> Pattern | None:
    """The compiled pattern, or None for one that the regex dialect refuses."""
    if len(set(flags)) != len(flags):
        return None
    pattern = Pattern(source, flags)
    try:
        pattern.java()
    except PatternError:
        return None
    return pattern


def compile_packs(packs: DataFrame, max_patterns: int = 20000) -> list[Detector]:
    """Accepted patterns as detectors, in pack order.  Rules are plan-time data:
    more than ``max_patterns`` raises rather than being cut."""
    good = validate_packs(packs).where(F.col("problem").isNull()).orderBy("pack_no", "rule_no", "pattern_no")
    rows = good.limit(max_patterns + 1).collect()
    if len(rows) > max_patterns:
        raise ValueError(f"more than {max_patterns} pack patterns")
    grouped: dict[tuple, tuple] = {}
    for r in rows:
        pattern = _pattern(r.pattern, r.flags)
        if pattern is not None:
            grouped.setdefault((r.pack_no, r.rule_no), (r, []))[1].append(pattern)
    return [Detector(r.detector_id, r.threat_id, tuple(ps), stage=r.stage, mode=r.mode, hint=r.hint)
            for r, ps in grouped.values()]


def compile_tenant_packs(packs: DataFrame, tenant: str = "tenant", max_patterns: int = 20000) -> tuple[list[Detector], DataFrame]:
    """Packs of many tenants as one rule list, and who uses which of them.

    A rule that several tenants have at the same place with the same content is one detector with one ``scope``.  The
    list keeps every tenant's own order of packs and rules, so it can be scanned once for all.  The second result is
    (tenant, scopes), one row per tenant with an accepted rule.  Only distinct rules are plan-time data: more than
    ``max_patterns`` patterns in them raise.  A pack without a tenant belongs to nobody."""
    fields = ["pack_no", "rule_no", "detector_id", "threat_id", "stage", "mode", "hint", "flags"]
    good = validate_packs(packs.where(F.col(tenant).isNotNull()), [tenant]).where(F.col("problem").isNull())
    rules = good.groupBy(tenant, *fields).agg(F.array_sort(F.collect_set(F.struct("pattern_no", "pattern"))).alias("p")) \
        .withColumn("sources", F.col("p.pattern")).drop("p")
    keyed = rules.withColumn("rule_key", F.sha2(F.to_json(F.struct(*fields, "sources")), 256))
    distinct = keyed.select("rule_key", *fields, "sources").dropDuplicates(["rule_key"])
    if (distinct.agg(F.sum(F.size("sources"))).first()[0] or 0) > max_patterns:
        raise ValueError(f"more than {max_patterns} pack patterns")
    detectors, numbers = [], []
    for scope, r in enumerate(distinct.orderBy("pack_no", "rule_no", "rule_key").collect()):
        patterns = tuple(p for s in r.sources if (p := _pattern(s, r.flags)) is not None)
        if patterns:
            detectors.append(Detector(r.detector_id, r.threat_id, patterns, stage=r.stage, mode=r.mode, hint=r.hint, scope=scope))
            numbers.append((r.rule_key, scope))
    known = packs.sparkSession.createDataFrame(numbers, "rule_key string, scope int")
    owners = keyed.select(tenant, "rule_key").join(known, "rule_key").groupBy(tenant).agg(F.array_sort(F.collect_set("scope")).alias("scopes"))
    return detectors, owners


def with_scopes(df: DataFrame, owners: DataFrame, tenant: str = "tenant", salt_on: Sequence[str] | None = None) -> DataFrame:
    """Add ``scopes``, the pack rules of the row's tenant (null: none).  A tenant with most of the rows is spread."""
    return salted_join(df, owners.select(tenant, "scopes"), [tenant], salt_on=salt_on)


def apply_packs(compiled: Sequence[Detector], base: Sequence[Detector] = DETECTORS) -> tuple[Detector, ...]:
    """Base detectors, then the packs.  Always starts from the base, so packs replace and never pile up."""
    return (*base, *compiled)
