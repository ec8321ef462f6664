"""Weighted signals: score, band, adjudicate, merge, intervene."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glasswatch.functions.regex_dialect import Pattern
from glasswatch.operators.policy import threat_lookup
from glasswatch.operators.scan import Prefilter, sql_literal, all_matches, literal_array, sealed
from glasswatch.plans.skew import salted_join
from glasswatch.rules.weighted import (CODE_PATTERNS, ENTITY_PATTERNS, RULE_VERSION, SHORTENER_HOSTS, WEIGHTED,
                                       Signal, WeightedDetector)

_DEC = "decimal(4,2)"
_LINK = Pattern(r"https?:\/\/[^\s)<>\"']+", "i")
_ANCHOR = r"(?i)<a\s[^>]*href\s*=\s*[\"']([^\"']*)[\"'][^>]*>([^<]*)</a>"
_HOST = r"(?i)^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:\s]+)"
_SHOWN_HOST = r"(?i)^\s*(?:https?://)?((?:[a-z0-9-]+\.)+[a-z]{2,})(?:[/?#:].*)?\s*$"


def url_host(url: Column) -> Column:
    """Lower-case host, '' when the url has none."""
    return F.lower(F.regexp_extract(url, _HOST, 1))


def anchors(html: Column) -> Column:
    """ARRAY<STRUCT<href, shown, href_host, shown_host>> of the links in markup."""
    hrefs = F.regexp_extract_all(html, F.lit(_ANCHOR), F.lit(1))
    shown = F.regexp_extract_all(html, F.lit(_ANCHOR), F.lit(2))
    return F.transform(F.arrays_zip(hrefs.alias("h"), shown.alias("s")), lambda z: F.struct(
        z["h"].alias("href"), z["s"].alias("shown"), url_host(z["h"]).alias("href_host"),
        F.lower(F.regexp_extract(z["s"], _SHOWN_HOST, 1)).alias("shown_host")))


def _bare(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def mismatched(anchor: Column) -> Column:
    """The text shows one host, the link goes to another."""
    return (anchor["href_host"] != "") & (anchor["shown_host"] != "") & (_bare(anchor["href_host"]) != _bare(anchor["shown_host"]))


def shortened(text: Column) -> Column:
    return F.exists(all_matches(text, _LINK), lambda u: _bare(url_host(u)).isin(*SHORTENER_HOSTS))


def _signal_patterns(s: Signal) -> list[Pattern]:
    """Patterns any of which fires the signal; card numbers need a further test."""
    if s.kind == "entity":
        if s.name == "ANY_PII":
            return [p for n, ps in ENTITY_PATTERNS.items() if n != "CREDIT_CARD" for p in ps]
        return [] if s.name == "CREDIT_CARD" else list(ENTITY_PATTERNS[s.name])
    if s.kind == "code":
        return list(CODE_PATTERNS[s.name])
    return list(s.patterns)


_CARD = ENTITY_PATTERNS["CREDIT_CARD"][0]


def _special_signals(have: set[str], text: Column, matched: Column, card: int, approved_tools) -> Column:
    """Names of the fired signals that are more than a pattern."""
    valid = F.exists(all_matches(text, _CARD), lambda m: F.call_function("luhn_check", F.regexp_replace(m, r"\D", "")))
    is_card = F.array_contains(matched, F.lit(card)) & valid
    named = {"CREDIT_CARD": is_card, "ANY_PII": is_card, "SHORTENER": shortened(text),
             "DISPLAY_HREF_MISMATCH": F.exists(anchors(F.col("html") if "html" in have else text), mismatched)}
    if "unresolvable" in have:
        named["UNRESOLVABLE"] = F.col("unresolvable")
    if "unapproved_tool" in have:
        named["AI_TOOL"] = F.col("unapproved_tool")
    elif approved_tools is not None and "tool" in have:
        named["AI_TOOL"] = ~F.array_contains(literal_array(approved_tools, "string"), F.col("tool"))
    if "foreign_tag" in have:
        named["FOREIGN_CONTEXT_TAG"] = F.col("foreign_tag")
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in named.items()]))


_DETECTOR_TYPE = ("struct<detector_id:string,threat_id:int,applies:array<string>,combine:string,fire:decimal(4,2),"
                  "escalate:decimal(4,2),signals:array<struct<weight:decimal(4,2),words:array<int>,names:array<int>,special:string>>>")


def score_events(events: DataFrame, *, key: str = "event_id", detectors: Sequence[WeightedDetector] = WEIGHTED,
                 approved_tools: Sequence[str] | None = None) -> DataFrame:
    """One row per event and applicable detector: ``confidence`` as DECIMAL(4,2).

    ``events``: key, ``type``, ``text`` and, where present, ``filename``, ``tool``,
    ``html``, ``foreign_tag``, ``unapproved_tool``, ``unresolvable``.  A signal
    whose column is missing scores 0.  ``approved_tools`` may be given as a list,
    or the caller joins a large allow-list and passes ``unapproved_tool``.

    Detectors are data: a constant array folded over the numbers of the matching
    patterns, each of which was run once per text."""
    have = set(events.columns)
    used = [s for d in detectors for s in d.signals]
    text_pre = Prefilter([p for s in used if s.scope != "filename" for p in _signal_patterns(s)] + [_CARD])
    name_pre = Prefilter([p for s in used if s.scope == "filename" for p in _signal_patterns(s)])
    work = events.withColumn("__c", text_pre.column(F.col("text")))
    work = sealed(work, "__words", text_pre.matched(F.col("text"), F.col("__c"))).drop("__c")
    if "filename" in have and name_pre.patterns:
        work = work.withColumn("__c", name_pre.column(F.col("filename")))
        work = sealed(work, "__names", name_pre.matched(F.col("filename"), F.col("__c"))).drop("__c")
    else:
        work = work.withColumn("__names", F.array().cast("array<int>"))
    work = sealed(work, "__special", _special_signals(
        have, F.col("text"), F.col("__words"), text_pre.number[_CARD], approved_tools))

    def signal(s: Signal) -> str:
        named = s.scope == "filename"
        pre = name_pre if named else text_pre
        numbers = [pre.number[p] for p in _signal_patterns(s)]
        return (f"named_struct('weight', {s.weight}, 'words', {sql_literal([] if named else numbers)}, "
                f"'names', {sql_literal(numbers if named else [])}, 'special', {sql_literal(s.name)})")

    rows_sql = ", ".join(
        f"named_struct('detector_id', {sql_literal(d.detector_id)}, 'threat_id', {d.threat_id}, 'applies', {sql_literal(d.applies_to)}, "
        f"'combine', {sql_literal(d.combine)}, 'fire', {d.fire}, 'escalate', {d.escalate}, "
        f"'signals', array({', '.join(map(signal, d.signals))}))" for d in detectors)
    table = F.expr(f"CAST(array({rows_sql}) AS array<{_DETECTOR_TYPE}>)")
    zero = F.lit(Decimal("0.00")).cast(_DEC)

    def points(s):
        hit = (F.arrays_overlap(s["words"], F.col("__words")) | F.arrays_overlap(s["names"], F.col("__names"))
               | F.array_contains("__special", s["special"]))
        return F.when(F.coalesce(hit, F.lit(False)), s["weight"]).otherwise(zero)

    applicable = F.transform(F.filter(table, lambda d: F.array_contains(d["applies"], F.col("type"))), lambda d: F.struct(
        d["detector_id"].alias("detector_id"), d["threat_id"].alias("threat_id"),
        combine_scores(d["combine"], F.transform(d["signals"], points)).alias("confidence"),
        d["fire"].alias("fire"), d["escalate"].alias("escalate")))
    keep = [c for c in events.columns if c not in ("text", "html")]
    rows = work.select(*keep, F.explode_outer(applicable).alias("d")).where(F.col("d").isNotNull())
    return rows.select(*keep, "d.detector_id", "d.threat_id", "d.confidence", "d.fire", "d.escalate",
                       F.lit(RULE_VERSION).alias("rule_version"))


def combine_scores(how: Column, scores: Column) -> Column:
    """weighted_sum: sum capped at 1; any: the best; all: the sum when every signal fired."""
    zero = F.lit(Decimal("0.00")).cast("decimal(14,2)")
    total = F.least(F.lit(Decimal("1.00")), F.aggregate(scores, zero, lambda a, x: (a + x).cast("decimal(14,2)")))
    return (F.when(how == "any", F.array_max(scores))
            .when(how == "all", F.when(F.forall(scores, lambda x: x > 0), total).otherwise(F.lit(Decimal("0.00"))))
            .otherwise(total)).cast(_DEC)


def with_band(scored: DataFrame, critical_escalate: Decimal | None = None) -> DataFrame:
    """confirmed / ambiguous / suppressed.  ``critical_escalate`` lowers the floor for Critical threats."""
    level = threat_lookup("risk_level", "string")(F.col("threat_id"))
    floor = F.col("escalate")
    if critical_escalate is not None:
        floor = F.when(level == "Critical", F.least(floor, F.lit(critical_escalate))).otherwise(floor)
    # An escalate threshold of 0 still needs some evidence.
    return scored.withColumn("risk_level", level).withColumn("band", F.when(
        F.col("confidence") >= F.col("fire"), "confirmed").when(
        (F.col("confidence") >= floor) & (F.col("confidence") > 0), "ambiguous").otherwise("suppressed"))


def override_thresholds(scored: DataFrame, overrides: DataFrame) -> DataFrame:
    """``overrides(detector_id, fire, escalate)`` from policy replace the built-in thresholds."""
    o = overrides.select("detector_id", F.col("fire").cast(_DEC).alias("__f"), F.col("escalate").cast(_DEC).alias("__e"))
    return (salted_join(scored, o, ["detector_id"])
            .withColumn("fire", F.coalesce("__f", "fire")).withColumn("escalate", F.coalesce("__e", "escalate"))
            .drop("__f", "__e"))


def adjudicate(banded: DataFrame, verdicts: DataFrame, *, key: str = "event_id", tier3: bool = False) -> tuple[DataFrame, DataFrame]:
    """(findings, escalation queue).  Confirmed bands stand.  Ambiguous ones follow
    the verdict: confirmed keeps, rejected or none drops, uncertain keeps
    Critical/High - or queues them when ``tier3`` is allowed."""
    v = verdicts.select(key, "threat_id", F.col("verdict").alias("verdict"))
    joined = banded.where(F.col("band") != "suppressed").join(v, [key, "threat_id"], "left")
    grave = F.col("risk_level").isin("Critical", "High")
    unsure = (F.col("band") == "ambiguous") & (F.col("verdict") == "uncertain") & grave
    keep = (F.col("band") == "confirmed") | ((F.col("band") == "ambiguous") & (F.col("verdict") == "confirmed"))
    queue = joined.where(unsure) if tier3 else joined.where(F.lit(False))
    return joined.where(keep if tier3 else keep | unsure), queue


def merge_findings(found: DataFrame, key: str = "event_id") -> DataFrame:
    """Per event and threat the most confident detector; equal confidence goes to the smaller id."""
    order = F.min(F.struct((-F.col("confidence")).alias("c"), F.col("detector_id").alias("d"), F.col("band").alias("b")))
    merged = found.groupBy(key, "threat_id").agg(order.alias("m"))
    return merged.select(key, "threat_id", F.col("m.d").alias("detector_id"),
                         (-F.col("m.c")).cast(_DEC).alias("confidence"), F.col("m.b").alias("band"))


def with_intervention(found: DataFrame) -> DataFrame:
    """Critical/High ask for acknowledgement, Medium nudges; the copy is the threat's response."""
    level = threat_lookup("risk_level", "string")(F.col("threat_id"))
    return (found.withColumn("risk_level", level)
            .withColumn("intervention", F.when(level.isin("Critical", "High"), "acknowledge").when(level == "Medium", "nudge"))
            .withColumn("copy", threat_lookup("response", "string")(F.col("threat_id"))))


def suppress_exceptions(found: DataFrame, exceptions: DataFrame, *, by: str = "session_id") -> DataFrame:
    """Drop findings someone declared fine: same session (or tenant), detector and content hash."""
    return salted_join(found, exceptions.select(by, "detector_id", "content_hash").distinct(),
                       [by, "detector_id", "content_hash"], "left_anti")


def unapproved_tool_events(events: DataFrame, approved: DataFrame) -> DataFrame:
    """``tool.open`` events of tools outside the allow-list table."""
    return salted_join(events.where(F.col("type") == "tool.open"), approved.select("tool").distinct(), ["tool"], "left_anti")

