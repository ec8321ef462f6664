"""Multi-turn injection review over the last turns of a conversation."""

from __future__ import annotations

from collections.abc import Sequence
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glasswatch.functions.text import is_blank
from glasswatch.operators.scan import FINDINGS_TYPE, Prefilter, as_hits, known, match_rules, reduce_hits
from glasswatch.plans.skew import running_sum, salted_join, trailing_rows
from glasswatch.rules.catalog import THREATS
from glasswatch.rules.detectors import DETECTORS, INJECTION_PREFIX, PERSISTENCE_DETECTOR, PERSISTENCE_THREAT
from glasswatch.rules.model import Detector, Threat

WINDOW = 6


def injection_detectors(detectors: Sequence[Detector]) -> list[Detector]:
    return [d for d in detectors if d.stage == "prompt" and d.detector_id.startswith(INJECTION_PREFIX)]


def session_detectors(detectors: Sequence[Detector]) -> list[Detector]:
    return [d for d in detectors if d.stage == "session" or
            (d.stage == "prompt" and d.detector_id.startswith(INJECTION_PREFIX))]


def turn_flag(df: DataFrame, text: str, into: str, detectors: Sequence[Detector] = DETECTORS) -> DataFrame:
    """1 where a single turn already matches an injection detector, else 0."""
    work = match_rules(df, text, injection_detectors(detectors), "__inj")
    return work.withColumn(into, F.coalesce((F.size("__inj") > 0).cast("int"), F.lit(0))).drop("__inj")


def scan_joined(df: DataFrame, joined: str, flagged: str, n_turns: str, *, into: str = "findings",
                detectors: Sequence[Detector] = DETECTORS, threats: Sequence[Threat] = THREATS) -> DataFrame:
    """Findings of a joined window: plain first matches (no refinement), then the
    persistence finding, which as a late warn represents its threat."""
    rules = known(session_detectors(detectors), threats)
    persistent = Detector(PERSISTENCE_DETECTOR, PERSISTENCE_THREAT, (), hint="")
    all_rules = known([*rules, persistent], threats)
    count = F.col(flagged).cast("string")
    work = match_rules(df, joined, rules, "__raw")
    matches = F.col("__raw")
    if len(all_rules) > len(rules):
        last = F.struct(F.lit(1 << 20).alias("s"), F.lit(len(rules)).alias("r"), F.concat(count, F.lit(" turns")).alias("m"))
        matches = F.concat(matches, F.when(F.col(flagged) >= 2, F.array(last)).otherwise(
            F.array().cast("array<struct<s:int,r:int,m:string>>")))
    work = work.withColumn("__hits", as_hits(matches, all_rules)).drop("__raw")
    found = F.when((F.col(n_turns) >= 2) & (F.size("__hits") > 0), reduce_hits(F.col("__hits"), all_rules, threats))
    work = work.withColumn("__found", F.coalesce(found, F.array()).cast(FINDINGS_TYPE)).drop("__hits")
    hint = F.concat(F.lit("Injection attempts repeat in "), count, F.lit(" turns."))
    return work.withColumn(into, F.transform("__found", lambda f: F.when(
        f["detector_id"] == PERSISTENCE_DETECTOR, f.withField("hint", hint)).otherwise(f))).drop("__found")


def scan_session(df: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text", *,
                 window: int = WINDOW, mode: str = "every", detectors: Sequence[Detector] = DETECTORS,
                 threats: Sequence[Threat] = THREATS, block: int = 4096) -> DataFrame:
    """Review each turn together with the turns before it.

    Blank turns are dropped first, then the last ``window`` remaining turns are
    joined by newlines; fewer than two give no findings.  ``mode='every'``
    returns one row per non-blank turn, ``'last'`` the state at the end of each
    conversation.  Long conversations are split into blocks, so no task holds one."""
    work = df.where(~is_blank(F.col(text)))
    work = turn_flag(work, text, "__flag", detectors)
    work = running_sum(work, conv, turn, F.lit(1).cast("long"), "turn_no", block)
    if mode == "last":
        # Only the closing window of a conversation is needed.
        total = work.groupBy(conv).agg(F.max("turn_no").alias("__n"))
        work = salted_join(work, total, [conv], "inner", salt_on=[conv, turn]).where(F.col("turn_no") > F.col("__n") - window)
        texts = F.array_sort(F.collect_list(F.struct("turn_no", turn, text)))
        last = work.groupBy(conv).agg(texts.alias("__w"), F.sum("__flag").alias("flagged_turns"))
        last = last.select(conv, F.element_at("__w", -1)[turn].alias(turn), F.size("__w").alias("n_turns"), "flagged_turns",
                           F.array_join(F.transform("__w", lambda x: x[text]), "\n").alias("__joined"))
    else:
        last = trailing_rows(work, conv, "turn_no", window, {
            "__texts": F.collect_list(text), "flagged_turns": F.sum("__flag")}, block)
        last = last.select(conv, turn, F.size("__texts").alias("n_turns"), "flagged_turns",
                           F.array_join("__texts", "\n").alias("__joined"))
    out = scan_joined(last, "__joined", "flagged_turns", "n_turns", detectors=detectors, threats=threats)
    return out.drop("__joined").withColumn("multi_turn", F.lit(True))


def scan_turn_arrays(df: DataFrame, turns: str = "turns", *, window: int = WINDOW,
                     detectors: Sequence[Detector] = DETECTORS, threats: Sequence[Threat] = THREATS) -> DataFrame:
    """Row form: an ARRAY<STRING> of turns, oldest first (short, already assembled sessions)."""
    kept = F.filter(F.coalesce(F.col(turns), F.array().cast("array<string>")), lambda t: ~is_blank(t))
    size = F.size(kept)
    recent = F.slice(kept, F.greatest(size - window + 1, F.lit(1)), F.lit(window))
    table = Prefilter(p for d in injection_detectors(detectors) for p in d.patterns).regexes()
    flagged = lambda t: F.exists(table, lambda rx: F.regexp_like(t, rx))

    work = df.withColumn("__recent", recent)
    work = work.withColumn("__n", F.size("__recent")).withColumn("__joined", F.array_join("__recent", "\n")) \
        .withColumn("__flagged", F.size(F.filter("__recent", flagged)))
    return scan_joined(work, "__joined", "__flagged", "__n", detectors=detectors, threats=threats).drop(
        "__recent", "__n", "__joined", "__flagged")


def foreign_context(df: DataFrame, session: str, order: str, tag: str) -> DataFrame:
    """Flag rows whose tag differs from the session's tag, i.e. the first tag seen in it.

    The first tag is an aggregate (combined map-side), not a window; of tags that
    come first together it is the smallest."""
    first = df.where(F.col(tag).isNotNull()).groupBy(session).agg(F.min_by(tag, F.struct(order, tag)).alias("session_tag"))
    return salted_join(df, first, [session], salt_on=[session, order]).withColumn(
        "foreign_tag", F.coalesce(F.col(tag) != F.col("session_tag"), F.lit(False)))
