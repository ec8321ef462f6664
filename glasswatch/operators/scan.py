"""Detection: ordered detectors over a text column, one ranked finding per threat.

Everything happens inside the row, without an exchange, so cost grows with the
text read and key skew has no effect:

1. one Arrow pass names the patterns that can match a text at all;
2. only those regexes run, in the JVM, as a fold over a short array of pattern
   numbers - the plan stays small however many rules there are;
3. the hits are deduped by threat and ranked as array expressions.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glasswatch.functions import refine as refiners
from glasswatch.functions.regex_dialect import Pattern
from glasswatch.functions.text import clip, is_blank
from glasswatch.rules.catalog import THREATS
from glasswatch.rules.content import CONTENT_RULES
from glasswatch.rules.detectors import DETECTORS
from glasswatch.rules.model import LEVEL_RANK, STAGES, ContentRule, Detector, Threat, wanted_stages

FINDINGS_TYPE = ("array<struct<threat_id:int,detector_id:string,mode:string,hint:string,match:string,"
                 "risk_level:string,risk_score:int,category:string>>")


# -- one pattern / one detector ------------------------------------------------

def sql_literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, (list, tuple)):
        return "array(" + ",".join(map(sql_literal, value)) + ")"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_array(values, sql_type: str) -> Column:
    """A constant array, sent to the JVM as one expression (a call per element is slow)."""
    return F.expr(f"CAST({sql_literal(list(values))} AS array<{sql_type}>)")


def sealed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``withColumn`` whose expression is evaluated once per row.

    A filter on a derived column is pushed down by copying its expression, which
    would run a text pass twice.  Producing the column by a one-row generator
    stops such copies, while filters on the input columns still reach the source."""
    tmp = f"{name}__"
    return df.withColumn(tmp, value).select("*", F.inline(F.array(F.struct(F.col(tmp).alias(name))))).drop(tmp)


class Prefilter:
    """Which patterns can match a row at all, decided in one pass over the text.

    An Arrow batch of texts goes through one Aho-Corasick automaton holding the
    anchors of every pattern; the row gets the numbers of the patterns whose
    anchor (or digit count) is present, in order.  A pattern with neither kind
    of evidence is always listed.  The regexes themselves stay in the JVM.
    """

    def __init__(self, patterns: Iterable[Pattern], edges: bool = True):
        self.patterns = list(dict.fromkeys(patterns))
        self.number = {p: i for i, p in enumerate(self.patterns)}
        self.owners: dict[tuple, list[int]] = {}
        self.digits: list[tuple[int, int]] = []
        self.always: list[int] = []
        for i, p in enumerate(self.patterns):
            for a in p.anchors() or ():
                self.owners.setdefault(tuple(a) if edges else (a.literal, False, False), []).append(i)
            if not p.anchors():
                if p.min_digits:
                    self.digits.append((p.min_digits, i))
                else:
                    self.always.append(i)

    def column(self, text: Column) -> Column:
        """ARRAY<INT> of candidate pattern numbers, ascending; empty for empty text."""
        return _candidate_udf(self.owners, sorted(self.digits), self.always)(text)

    def regexes(self) -> Column:
        return literal_array([p.java() for p in self.patterns], "string")

    def matched(self, text: Column, candidates: Column) -> Column:
        """ARRAY<INT> of the candidate patterns that really match."""
        table = self.regexes()
        return F.filter(candidates, lambda n: F.regexp_like(text, F.get(table, n)))

    def numbers(self, patterns: Iterable[Pattern]) -> Column:
        return literal_array([self.number[p] for p in patterns], "int")


# Bytes of text that a worker turns into Python strings at once.
SLICE_BYTES = 1 << 20
# Bytes of one Arrow batch on its way to a worker (Spark's default is 64 MB for each core).
BATCH_BYTES = "4194304"


def _slices(texts: pa.Array, most: int = SLICE_BYTES):
    """Runs of neighbouring texts of at most ``most`` bytes together, or one text."""
    sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    first, used = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if k > first and used + n > most:
            yield texts.slice(first, k - first)
            first, used = k, 0
        used += n
    yield texts.slice(first)


def _digit_counts(texts: pa.Array) -> np.ndarray:
    """ASCII digits per text, over the batch's UTF-8 buffer at once."""
    if len(texts) == 0:
        return np.zeros(0, np.int64)
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    window = raw[ends[0]:ends[-1]]
    places = np.flatnonzero((window >= 48) & (window <= 57))
    return np.diff(np.searchsorted(places, ends - ends[0]))


def _candidate_udf(owners: dict[tuple, list[int]], digits: list[tuple[int, int]], always: list[int]):
    by_literal: dict[str, list] = {}
    for (literal, left, right), ids in owners.items():
        by_literal.setdefault(literal, []).append((left, right, ids))
    entries = [(literal, tuple(rules)) for literal, rules in by_literal.items()]
    built: list = []  # one automaton per Python worker

    def automaton():
        if not built:
            import ahocorasick

            machine = ahocorasick.Automaton()
            for literal, rules in entries:
                machine.add_word(literal, (len(literal), rules))
            machine.make_automaton()
            built.append(machine)
        return built[0]

    def word(c: str) -> bool:
        return c.isascii() and (c.isalnum() or c == "_")

    def candidates(text: str | None, n_digits: int, machine) -> list[int]:
        if not text:
            return []
        # U+212A lower-cases to an ASCII letter but is no word character.
        low = text.replace("\u212a", "\u00e9").lower()
        found = set(always)
        found.update(i for need, i in digits if n_digits >= need)
        for end, (size, rules) in machine.iter(low) if entries else ():
            for left, right, ids in rules:
                start = end - size
                if left and start >= 0 and word(low[start]):
                    continue
                if right and end + 1 < len(low) and word(low[end + 1]):
                    continue
                found.update(ids)
        return sorted(found)

    @F.arrow_udf("array<int>")
    def pick(texts: pa.Array) -> pa.Array:
        machine = automaton() if entries else None
        # Slice by slice, so that memory follows neither the batch nor the table.
        return pa.array((candidates(t.as_py(), n, machine) for part in _slices(texts)
                         for t, n in zip(part, _digit_counts(part).tolist())), pa.list_(pa.int32()))

    return pick


def pattern_match(text: Column, p: Pattern) -> Column:
    """Leftmost match, null when there is none."""
    found = F.regexp_extract(text, p.java(), 0)
    return F.when(text.rlike(p.java()), found) if p.can_be_empty else F.nullif(found, F.lit(""))


def all_matches(text: Column, p: Pattern) -> Column:
    return F.regexp_extract_all(text, F.lit(p.java()), F.lit(0))


class Matcher:
    """First matches of ordered rules, each with ordered patterns, over candidate numbers.

    A rule's first pattern in list order that matches decides; an empty match
    ends the search without a hit.  A rule with a refinement takes the first
    occurrence that passes, pattern by pattern."""

    def __init__(self, rules: Sequence):
        slots = [(i, p, getattr(r, "refine", None)) for i, r in enumerate(rules) for p in r.patterns]
        self.pre = Prefilter(p for _, p, _ in slots)
        # A pattern may serve several rules: number -> slots.
        self.slot_rule = [i for i, _, _ in slots]
        self.slot_pattern = [self.pre.number[p] for _, p, _ in slots]
        self.slot_refine = [r or "" for _, _, r in slots]
        self.slots_of = [[s for s, n in enumerate(self.slot_pattern) if n == i] for i in range(len(self.pre.patterns))]
        self.may_be_empty = any(p.can_be_empty for _, p, _ in slots)

    def _match(self, text: Column, regex: Column, refine: Column) -> Column:
        found = F.call_function("regexp_extract", text, regex, F.lit(0))
        if self.may_be_empty:
            found = F.when(F.regexp_like(text, regex), found)
        for name in sorted(set(self.slot_refine) - {""}):
            accept = refiners.predicate(name)
            passing = F.filter(F.regexp_extract_all(text, regex, F.lit(0)), lambda m: accept(m))
            found = F.when(refine == name, F.try_element_at(passing, F.lit(1))).otherwise(found)
        return found

    def tried(self, text: Column, candidates: Column, keep=None) -> Column:
        """ARRAY<STRUCT<s, r, m>>: slots that matched, in slot order (``m`` may be '')."""
        slots_of = literal_array(self.slots_of, "array<int>")
        rule, refine = literal_array(self.slot_rule, "int"), literal_array(self.slot_refine, "string")
        pattern, table = literal_array(self.slot_pattern, "int"), self.pre.regexes()
        slots = F.array_sort(F.flatten(F.transform(candidates, lambda n: F.get(slots_of, n))))
        if keep is not None:
            slots = F.filter(slots, lambda s: keep(F.get(rule, s)))
        out = F.transform(slots, lambda s: F.struct(
            s.alias("s"), F.get(rule, s).alias("r"),
            self._match(text, F.get(table, F.get(pattern, s)), F.get(refine, s)).alias("m")))
        # Without empty-matching patterns an empty extract means no match.
        return F.filter(out, lambda x: x["m"].isNotNull() if self.may_be_empty else F.coalesce(x["m"], F.lit("")) != "")

    @staticmethod
    def first_per_rule(tried: Column) -> Column:
        """Keep each rule's first matching slot, dropping empty matches.  ``tried`` is a plain column."""
        return F.filter(tried, lambda x: (x["m"] != "") & ~F.exists(
            tried, lambda y: (y["r"] == x["r"]) & (y["s"] < x["s"])))


def match_rules(df: DataFrame, text: str, rules: Sequence, into: str, keep=None, skip_blank: bool = False) -> DataFrame:
    """Add ``into``: ARRAY<STRUCT<s, r, m>>, one entry per matching rule, in rule order.  ``skip_blank``: white space
    alone matches nothing."""
    can, tried = f"__{into}_can", f"__{into}_try"
    matcher = Matcher(rules)
    source = F.when(~is_blank(F.col(text)), F.col(text)) if skip_blank else F.col(text)
    work = df.withColumn(can, matcher.pre.column(source))
    work = sealed(work, tried, matcher.tried(source, F.col(can), keep)).drop(can)
    return work.withColumn(into, Matcher.first_per_rule(F.col(tried))).drop(tried)


def first_match(df: DataFrame, text: str, patterns: Sequence[Pattern], into: str) -> DataFrame:
    """Add ``into``: the first pattern's match in list order, null without one."""
    rule = Detector("single", 0, tuple(patterns))
    return detector_match(df, text, rule, into)


def detector_match(df: DataFrame, text: str, rule: Detector, into: str) -> DataFrame:
    """Add ``into``: the match of one detector, refinement included."""
    work = match_rules(df, text, [rule], f"__{into}")
    return work.withColumn(into, F.get(f"__{into}", F.lit(0))["m"]).drop(f"__{into}")


# -- rule selection --------------------------------------------------------------

def in_stage(d: Detector, stage: str) -> bool:
    return any(s in wanted_stages(stage) for s in d.where)


def select(detectors: Sequence[Detector], stage: str | None) -> list[Detector]:
    return [d for d in detectors if stage is None or in_stage(d, stage)]


def _row_filter(detectors: Sequence[Detector], stage: str | Column, scopes: str | None):
    """Rule number -> does it run in this row, by the row's stage and by the scopes it lists?  None: every rule runs."""
    tests = []
    if not isinstance(stage, str):
        places = literal_array([[s for s in STAGES if in_stage(d, s)] for d in detectors], "array<string>")
        tests.append(lambda rule: F.array_contains(F.get(places, rule), stage))
    if any(d.scope is not None for d in detectors):
        if scopes is None:
            raise ValueError("rules with a scope need a column of scopes")
        scope_of = literal_array([d.scope for d in detectors], "int")
        listed = F.coalesce(F.col(scopes), F.array().cast("array<int>"))
        tests.append(lambda rule: F.get(scope_of, rule).isNull() | F.array_contains(listed, F.get(scope_of, rule)))
    if not tests:
        return None
    return lambda rule: reduce(lambda a, b: a & b, [test(rule) for test in tests])


# -- array reduction ---------------------------------------------------------------

def reduce_hits(hits: Column, detectors: Sequence[Detector], threats: Sequence[Threat], max_match: int = 48) -> Column:
    """Hits (``i``, ``t``, ``w``, ``m``) -> findings: last warn else first coach per
    threat, ordered by level, score, then where the threat was first seen.

    ``hits`` must be a plain column, it is read several times."""
    by_id = {t.threat_id: t for t in threats}
    rank = [LEVEL_RANK[by_id[d.threat_id].risk_level] for d in detectors]
    score = [by_id[d.threat_id].risk_score for d in detectors]
    order = literal_array([-(r * 1000 + s) for r, s in zip(rank, score)], "int")

    def wins(h):
        same = lambda g: g["t"] == h["t"]
        later_warn = F.exists(hits, lambda g: same(g) & g["w"] & (g["i"] > h["i"]))
        other = F.exists(hits, lambda g: same(g) & (g["w"] | (g["i"] < h["i"])))
        return F.when(h["w"], ~later_warn).otherwise(~other)

    def first_seen(h):
        return F.array_min(F.transform(F.filter(hits, lambda g: g["t"] == h["t"]), lambda g: g["i"]))

    keyed = F.transform(F.filter(hits, wins), lambda h: F.struct(
        F.get(order, h["i"]).alias("o"), first_seen(h).alias("f"), h["i"].alias("i"), h["t"].alias("t"),
        h["w"].alias("w"), h["m"].alias("m")))
    ids = literal_array([d.detector_id for d in detectors], "string")
    hints = literal_array([d.hint for d in detectors], "string")
    levels = literal_array([by_id[d.threat_id].risk_level for d in detectors], "string")
    scores = literal_array(score, "int")
    categories = literal_array([by_id[d.threat_id].category for d in detectors], "string")
    return F.transform(F.array_sort(keyed), lambda k: F.struct(
        k["t"].alias("threat_id"), F.get(ids, k["i"]).alias("detector_id"),
        F.when(k["w"], F.lit("warn")).otherwise(F.lit("coach")).alias("mode"),
        F.get(hints, k["i"]).alias("hint"), clip(k["m"], max_match).alias("match"),
        F.get(levels, k["i"]).alias("risk_level"), F.get(scores, k["i"]).alias("risk_score"),
        F.get(categories, k["i"]).alias("category")))


def as_hits(matches: Column, detectors: Sequence[Detector]) -> Column:
    """Rule matches (``r``, ``m``) -> hits with threat and mode attached."""
    tids = literal_array([d.threat_id for d in detectors], "int")
    warn = literal_array([d.mode == "warn" for d in detectors], "boolean")
    return F.transform(matches, lambda x: F.struct(
        x["r"].alias("i"), F.get(tids, x["r"]).alias("t"), F.get(warn, x["r"]).alias("w"), x["m"].alias("m")))


def known(detectors: Sequence[Detector], threats: Sequence[Threat]) -> list[Detector]:
    """Detectors of an unknown threat never produce a finding."""
    ids = {t.threat_id for t in threats}
    return [d for d in detectors if d.threat_id in ids]


# -- operators -----------------------------------------------------------------------

def findings_of(matches: str, detectors: Sequence[Detector], threats: Sequence[Threat], df: DataFrame, into: str) -> DataFrame:
    """Matches column -> ranked findings column ``into``; ``matches`` is dropped."""
    hit = f"__{into}_hits"
    work = df.withColumn(hit, as_hits(F.col(matches), detectors)).drop(matches)
    found = F.when(F.size(hit) > 0, reduce_hits(F.col(hit), detectors, threats))
    return work.withColumn(into, F.coalesce(found, F.array().cast(FINDINGS_TYPE)).cast(FINDINGS_TYPE)).drop(hit)


def scan(df: DataFrame, text: str = "text", stage: str | Column = "prompt", *,
         detectors: Sequence[Detector] = DETECTORS, threats: Sequence[Threat] = THREATS,
         into: str = "findings", scopes: str | None = None) -> DataFrame:
    """Add ``into``: the ranked findings of each row's text.  ``scopes`` names the column (ARRAY<INT>) of the scoped rules
    that apply to a row; those of other rows are left out before any regex runs."""
    constant = isinstance(stage, str)
    rules = known(select(detectors, stage if constant else None), threats)
    if not rules:
        return df.withColumn(into, F.array().cast(FINDINGS_TYPE))
    raw = f"__{into}_raw"
    work = match_rules(df, text, rules, raw, _row_filter(rules, stage, scopes), skip_blank=True)
    return findings_of(raw, rules, threats, work, into)


def review(df: DataFrame, text: str = "text", stage: str | Column = "prompt", *,
           detectors: Sequence[Detector] = DETECTORS, threats: Sequence[Threat] = THREATS,
           rules: Sequence[ContentRule] = CONTENT_RULES, scopes: str | None = None) -> DataFrame:
    """Threat findings and content hits from a single pass over the text."""
    constant = isinstance(stage, str)
    dets = known(select(detectors, stage if constant else None), threats)
    both, n = [*dets, *rules], len(dets)
    applies = _row_filter(dets, stage, scopes)
    keep = None if applies is None else lambda r: (r >= n) | applies(r)
    work = match_rules(df, text, both, "__both", keep, skip_blank=True)
    work = work.withColumn("__det", F.filter("__both", lambda x: x["r"] < n)) \
        .withColumn("__con", F.filter("__both", lambda x: x["r"] >= n)).drop("__both")
    work = findings_of("__det", dets, threats, work, "findings")
    return work.withColumn("content_hits", content_hits(F.col("__con"), rules, n)).drop("__con")


def explode_findings(df: DataFrame, keys: Sequence[str], findings: str = "findings") -> DataFrame:
    """One row per finding with its 1-based rank (the table-function shape)."""
    # The outer form keeps the optimizer from copying the whole scan into a pushed-down filter.
    return (df.select(*keys, F.posexplode_outer(findings).alias("rank", "f")).where(F.col("rank").isNotNull())
              .select(*keys, (F.col("rank") + 1).alias("rank"), "f.*"))


def scan_rows(df: DataFrame, keys: Sequence[str], text: str = "text", stage: str | Column = "prompt", **kw) -> DataFrame:
    return explode_findings(scan(df.select(*keys, *([text] if text not in keys else [])), text, stage, **kw), keys)


def scan_for_index(df: DataFrame, text: str = "text", **kw) -> tuple[DataFrame, DataFrame]:
    """Review before indexing: (clean rows, quarantined rows with findings)."""
    done = scan(df, text, "index", **kw)
    return done.where(F.size("findings") == 0).drop("findings"), done.where(F.size("findings") > 0)


CONTENT_TYPE = "array<struct<rule_id:string,label:string,severity:string,match:string>>"


def content_hits(matches: Column, rules: Sequence[ContentRule], offset: int = 0) -> Column:
    ids, labels, sevs = (literal_array([getattr(r, a) for r in rules], "string") for a in ("rule_id", "label", "severity"))
    out = F.transform(matches, lambda x: F.struct(
        F.get(ids, x["r"] - offset).alias("rule_id"), F.get(labels, x["r"] - offset).alias("label"),
        F.get(sevs, x["r"] - offset).alias("severity"), clip(x["m"]).alias("match")))
    return F.coalesce(out, F.array().cast(CONTENT_TYPE)).cast(CONTENT_TYPE)


def scan_content(df: DataFrame, text: str = "text", categories: Sequence[str] | None = None, *,
                 rules: Sequence[ContentRule] = CONTENT_RULES, into: str = "content_hits") -> DataFrame:
    """Add ``into``: one hit per matching content rule in rule order, optionally an allow-set only."""
    chosen = [r for r in rules if categories is None or r.rule_id in set(categories)]
    if not chosen:
        return df.withColumn(into, F.array().cast(CONTENT_TYPE))
    raw = f"__{into}_raw"
    work = match_rules(df, text, chosen, raw, skip_blank=True)
    return work.withColumn(into, content_hits(F.col(raw), chosen)).drop(raw)
