"""Policy: which action a threat gets, and the decision a text gets.

A policy travels as a STRUCT column (one row per tenant, joined on).  Missing
keys fall back to defaults; a missing policy allows and reports nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glasswatch.operators.redact import redact
from glasswatch.operators.scan import literal_array, review, scan, sealed
from glasswatch.plans.skew import salted_join
from glasswatch.rules.catalog import APPROVAL_THREATS, DATA_TIERS, SOURCE_URLS, THREATS
from glasswatch.rules.content import CONTENT_RULES
from glasswatch.rules.detectors import DETECTORS
from glasswatch.rules.model import Detector

POLICY_TYPE = ("struct<threat_policy:map<int,string>,tier_policy:map<string,string>,"
               "content_policy:map<string,string>,mcp_allow:array<string>,allowed_tools:array<string>,"
               "output_review:boolean,output_redaction:boolean>")


def _given(value: Column) -> Column:
    """An empty action counts as absent."""
    return F.when(value != "", value)


def tier_of(threat_id: Column) -> Column:
    out = F.lit(None).cast("string")
    for tier, ids in DATA_TIERS.items():
        out = F.when(threat_id.isin(*ids), F.lit(tier)).otherwise(out)
    return out


def resolve_action(threat_id: Column, policy: Column, mode: str = "full") -> Column:
    """Per-threat action, else the data tier's, else ``justify`` for approval
    threats, else ``notify``.  ``mode='explicit'`` stops after the first."""
    explicit = _given(F.try_element_at(policy["threat_policy"], threat_id))
    if mode == "explicit":
        return F.coalesce(explicit, F.lit("notify"))
    if mode != "full":
        raise ValueError(f"unknown mode {mode!r}")
    return F.coalesce(explicit, _given(F.try_element_at(policy["tier_policy"], tier_of(threat_id))),
                      F.when(threat_id.isin(*APPROVAL_THREATS), F.lit("justify")), F.lit("notify"))


def content_action(rule_id: Column, policy: Column) -> Column:
    return F.coalesce(_given(F.try_element_at(policy["content_policy"], rule_id)), F.lit("disabled"))


def _rank(action: Column) -> Column:
    return F.when(action == "block", 3).when(action == "justify", 2).otherwise(1)


def _decision(rank: Column) -> Column:
    return F.when(rank == 3, F.lit("deny")).when(rank == 2, F.lit("ask")).otherwise(F.lit("allow"))


def decide(df: DataFrame, text: str = "text", stage: str | Column = "prompt", policy: str = "policy", *,
           detectors: Sequence[Detector] = DETECTORS, threats=THREATS, content_rules=CONTENT_RULES,
           scopes: str | None = None) -> DataFrame:
    """Add ``decision`` (allow, ask, deny), ``reasons`` and ``reported`` findings.

    Threat findings: block denies, justify asks, disabled is dropped.  Content
    hits: the same, absent from the policy means disabled, and an ask gives no
    reason.  Null policy or blank text -> allow."""
    work = review(df, text, stage, detectors=detectors, threats=threats, rules=content_rules, scopes=scopes)
    return decide_reviewed(work, policy, df.columns)


def decide_reviewed(work: DataFrame, policy: str = "policy", keep: Sequence[str] | None = None) -> DataFrame:
    """The decision for rows that already carry ``findings`` and ``content_hits``."""
    pol = F.col(policy)
    keep = keep if keep is not None else [c for c in work.columns if c not in ("findings", "content_hits")]
    work = work.withColumn("__t", F.filter(F.transform("findings", lambda f: F.struct(
        f["threat_id"].alias("threat_id"), f["category"].alias("category"), f["risk_level"].alias("risk_level"),
        f["match"].alias("match"), resolve_action(f["threat_id"], pol).alias("action"))),
        lambda x: x["action"] != "disabled"))
    work = work.withColumn("__c", F.filter(F.transform("content_hits", lambda c: F.struct(
        F.lit(0).alias("threat_id"), F.concat(F.lit("Content: "), c["label"]).alias("category"),
        F.when(content_action(c["rule_id"], pol) == "block", F.lit("Blocked")).otherwise(F.lit("High")).alias("risk_level"),
        c["match"].alias("match"), content_action(c["rule_id"], pol).alias("action"), c["label"].alias("label"))),
        lambda x: x["action"] != "disabled"))
    ranks = F.concat(F.transform("__t", lambda x: _rank(x["action"])), F.transform("__c", lambda x: _rank(x["action"])))
    reason_t = F.transform(F.filter("__t", lambda x: x["action"].isin("block", "justify")), lambda x: F.concat(
        F.lit("#"), x["threat_id"].cast("string"), F.lit(" "), x["category"],
        F.when(x["action"] == "justify", F.lit(" (needs sign-off)")).otherwise(F.lit(""))))
    reason_c = F.transform(F.filter("__c", lambda x: x["action"] == "block"),
                           lambda x: F.concat(F.lit("content: "), x["label"]))
    active = pol.isNotNull()
    shape = "array<struct<threat_id:int,category:string,risk_level:string,match:string,action:string>>"
    plain = F.transform("__c", lambda x: x.dropFields("label"))
    return work.select(
        *keep,
        F.when(active, _decision(F.coalesce(F.array_max(ranks), F.lit(1)))).otherwise(F.lit("allow")).alias("decision"),
        F.when(active, F.concat(reason_t, reason_c)).otherwise(F.array().cast("array<string>")).alias("reasons"),
        F.when(active, F.concat(F.col("__t").cast(shape), plain.cast(shape))).otherwise(F.array().cast(shape)).alias("reported"))


def guard_verdict(df: DataFrame, text: str = "text", policy: str = "policy", *,
                  detectors: Sequence[Detector] = DETECTORS) -> DataFrame:
    """One-shot prompt review with explicit actions only: ``verdict`` clean,
    review or blocked, ``n_reported`` / ``n_visible`` counts, and ``redacted`` text
    for prompts that are not clean."""
    pol = F.col(policy)
    work = review(df, text, "prompt", detectors=detectors)
    work = work.withColumn("__a", F.filter(F.transform(
        "findings", lambda f: resolve_action(f["threat_id"], pol, "explicit")), lambda a: a != "disabled"))
    work = work.withColumn("__b", F.filter(F.transform(
        "content_hits", lambda c: content_action(c["rule_id"], pol)), lambda a: a != "disabled"))
    work = work.withColumn("__all", F.concat("__a", "__b"))
    visible = F.filter("__all", lambda a: a != "alert")
    blocked = F.exists("__all", lambda a: a == "block")
    work = work.select(*df.columns, F.size("__all").alias("n_reported"), F.size(visible).alias("n_visible"),
                       F.when(blocked, "blocked").when(F.size(visible) > 0, "review").otherwise("clean").alias("verdict"))
    # A clean prompt goes out as it is; only the others are offered masked.
    work = sealed(work, "__in", F.when(F.col("verdict") != "clean", F.col(text)))
    return redact(work, "__in", "prompt", detectors=detectors).drop("__in")


def review_output(df: DataFrame, text: str = "text", policy: str = "policy", *,
                  detectors: Sequence[Detector] = DETECTORS) -> DataFrame:
    """AI answer review: ``flagged`` threat ids, ``masked`` and ``delivered`` text.

    Masks when the policy always masks or a finding is block/justify; a policy
    with ``output_review`` false passes the answer through unread."""
    pol = F.col(policy)
    skip = F.coalesce(pol["output_review"] == False, F.lit(False))  # noqa: E712
    work = scan(sealed(df, "__seen", F.when(~skip, F.col(text))), "__seen", "output", detectors=detectors)
    work = work.withColumn("__acts", F.filter(F.transform("findings", lambda f: F.struct(
        f["threat_id"].alias("t"), resolve_action(f["threat_id"], pol, "explicit").alias("a"))),
        lambda x: x["a"] != "disabled"))
    mask = ~skip & (F.coalesce(pol["output_redaction"], F.lit(False))
                    | F.exists("__acts", lambda x: x["a"].isin("block", "justify")))
    work = sealed(work, "masked", mask)
    work = sealed(work, "__in", F.when(F.col("masked"), F.col(text)))
    work = redact(work, "__in", "output", detectors=detectors, into="__out")
    return work.select(*df.columns, F.transform("__acts", lambda x: x["t"]).alias("flagged"), "masked",
                       F.when(F.col("masked"), F.col("__out")).otherwise(F.col(text)).alias("delivered"))


def decide_mcp_server(server: Column, allow: Column) -> Column:
    """No or empty allow-list allows; otherwise membership decides."""
    return F.when(allow.isNull() | (F.size(allow) <= 0) | F.array_contains(allow, server), F.lit("allow")).otherwise(F.lit("deny"))


def allowed_tool(tool: Column, provisioned: Column, reachable: Column, current: Column, cached: Column,
                 always: Sequence[str] = ("claude",)) -> Column:
    """May an agent start?  Some are always allowed, as is everything on an
    unprovisioned install; a reachable policy decides (no list = all), else the
    cached list does, else no."""
    return (F.when(tool.isin(*always) | ~provisioned, True)
            .when(reachable, F.coalesce(F.array_contains(current, tool), F.lit(True)))
            .otherwise(F.coalesce(F.array_contains(cached, tool), F.lit(False))))


def allowlist_violations(events: DataFrame, allow: DataFrame, on: str) -> DataFrame:
    """Events whose ``on`` value is not listed."""
    return salted_join(events, allow.select(on).distinct(), [on], "left_anti")


def source_links(sources: Column, urls: dict[str, str] = SOURCE_URLS) -> Column:
    """Source keys -> {key, url}; keys without a url are dropped."""
    table = F.create_map(*[F.lit(x) for kv in urls.items() for x in kv])
    linked = F.transform(sources, lambda k: F.struct(k.alias("key"), F.try_element_at(table, k).alias("url")))
    return F.filter(linked, lambda x: x["url"].isNotNull())


def threat_table(spark) -> DataFrame:
    rows = [(t.threat_id, t.threat, t.category, t.severity, t.likelihood, t.risk_score, t.risk_level, t.response,
             list(t.sources), t.tier, t.needs_approval, t.detect_class) for t in THREATS]
    return spark.createDataFrame(rows, "threat_id int, threat string, category string, severity int, likelihood int, "
                                       "risk_score int, risk_level string, response string, sources array<string>, "
                                       "tier string, needs_approval boolean, detect_class string")


def threat_lookup(field: str, sql_type: str):
    """``threat_id`` -> catalogue field, as an expression (the catalogue is fixed and small)."""
    values = {t.threat_id: getattr(t, field) for t in THREATS}
    slots = [values.get(i) for i in range(max(values) + 1)]
    table = literal_array(slots, sql_type)
    return lambda threat_id: F.get(table, threat_id)
