"""Masking: detector spans, literal spans, and the can-it-be-salvaged test."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glasswatch.functions import refine as refiners
from glasswatch.functions.regex_dialect import Pattern
from glasswatch.operators.scan import Prefilter, literal_array, review, sealed, select
from glasswatch.rules.content import CONTENT_RULES
from glasswatch.rules.detectors import DETECTORS
from glasswatch.rules.model import Detector

MASK = "[REDACTED]"


def tag(threat_id: int) -> str:
    return f"[REDACTED:#{threat_id}]"


def _tag_independent(p: Pattern) -> bool:
    """Can absence of the pattern's evidence in the original text rule it out later on?

    A pattern that takes no bracket matches wholly inside a tag or wholly in
    original text; one too wide or with too many digits for a tag's inside is
    left with the latter.  Otherwise no anchor may arise from tag characters."""
    inside = len("REDACTED:#") + 4
    if not p.can_hold("[]") and (p.min_width > inside or p.min_digits > 4 or (p.min_digits > 2 and not p.can_hold(":#D"))):
        return bool(p.anchors()) or p.min_digits > 0
    return bool(p.anchors()) and not any(
        "[" in a.literal or "]" in a.literal or a.literal in "[redacted:#" or a.literal.isdigit()
        for a in p.anchors())


def _replace_refined(text: Column, regex: Column, replacement: Column, accept) -> Column:
    """Replace only the occurrences that pass ``accept``: pieces and matches interleaved again."""
    pieces = F.split(text, regex, -1)
    kept = F.transform(F.regexp_extract_all(text, regex, F.lit(0)),
                       lambda m: F.when(accept(m), replacement).otherwise(m))
    joined = F.transform(pieces, lambda piece, i: F.concat(piece, F.coalesce(F.get(kept, i), F.lit(""))))
    return F.array_join(joined, "")


def redact(df: DataFrame, text: str = "text", stage: str = "prompt", *,
           detectors: Sequence[Detector] = DETECTORS, into: str = "redacted") -> DataFrame:
    """Replace every match of every non-coach detector by its threat tag, detector
    by detector, each seeing the text left by the ones before.

    Rows without a candidate pattern cannot change and are passed through.  In
    the others only candidate patterns run, as a fold over a short array."""
    steps = [(p, d) for d in select(detectors, stage) if d.mode != "coach" for p in d.patterns]
    if not steps:
        return df.withColumn(into, F.col(text))
    can = f"__{into}_can"
    # Word edges may appear when a neighbour is masked, so only literals count here.
    pre = Prefilter((p for p, _ in steps), edges=False)
    always = [not _tag_independent(p) for p, _ in steps]
    plan = F.arrays_zip(
        literal_array([pre.number[p] for p, _ in steps], "int").alias("n"), literal_array(always, "boolean").alias("free"),
        literal_array([p.java() for p, _ in steps], "string").alias("rx"),
        literal_array([tag(d.threat_id) for _, d in steps], "string").alias("tag"),
        literal_array([d.refine or "" for _, d in steps], "string").alias("refine"))
    names = sorted({d.refine for _, d in steps if d.refine})
    candidates = F.col(can)

    def apply(acc, step):
        out = F.regexp_replace(acc, step["rx"], step["tag"])
        for name in names:
            accept = refiners.predicate(name)
            out = F.when(step["refine"] == name,
                         _replace_refined(acc, step["rx"], step["tag"], accept)).otherwise(out)
        return out

    active = F.filter(plan, lambda s: s["free"] | F.array_contains(candidates, s["n"]))
    work = sealed(df, can, pre.column(F.col(text)))
    return sealed(work, into, F.when(
        F.size(candidates) > 0, F.aggregate(active, F.col(text), apply)).otherwise(F.col(text))).drop(can)


def redact_literal(text: Column, spans: Column, mask: str = MASK) -> Column:
    """Replace literal spans, longest first (ties in given order)."""
    ordered = F.array_sort(F.transform(
        F.filter(spans, lambda s: F.coalesce(s, F.lit("")) != ""),
        lambda s, i: F.struct((-F.length(s)).alias("o"), i.alias("i"), s.alias("s"))))
    return F.aggregate(ordered, text, lambda acc, k: F.replace(acc, k["s"], F.lit(mask)))


def gated_spans(findings: Column, content: Column, threat_action, content_action) -> Column:
    """Clipped spans of findings whose action holds the text back (content first)."""
    held = lambda a: a.isin("block", "justify")
    return F.concat(
        F.transform(F.filter(content, lambda c: F.coalesce(held(content_action(c)), F.lit(False))), lambda c: c["match"]),
        F.transform(F.filter(findings, lambda f: held(threat_action(f))), lambda f: f["match"]))


def salvageable(df: DataFrame, text: str, threat_action, content_action, *,
                detectors: Sequence[Detector] = DETECTORS, content_rules=CONTENT_RULES) -> DataFrame:
    """Add ``salvaged``: the text with held spans masked, when that differs and a
    second review finds nothing to hold; otherwise null.

    ``threat_action(finding)`` / ``content_action(hit)`` give the policy action as a Column."""
    work = review(df, text, "prompt", detectors=detectors, rules=content_rules)
    spans = gated_spans(F.col("findings"), F.col("content_hits"), threat_action, content_action)
    work = work.select(*df.columns, spans.alias("__spans"))
    # Rows with nothing to hold need no second pass.
    work = sealed(work, "__try", F.when(F.size("__spans") > 0, redact_literal(F.col(text), F.col("__spans")))).drop("__spans")
    work = review(work, "__try", "prompt", detectors=detectors, rules=content_rules)
    left = gated_spans(F.col("findings"), F.col("content_hits"), threat_action, content_action)
    return work.withColumn("salvaged", F.when(
        (F.col("__try") != F.col(text)) & (F.size(left) == 0), F.col("__try"))).select(*df.columns, "salvaged")
