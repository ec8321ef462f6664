"""Packs of many tenants in one pass."""

import pytest

from glasswatch.operators import packs as PK
from glasswatch.operators import policy as P
from glasswatch.operators import scan as S
from glasswatch.rules.detectors import DETECTORS

TYPE = "tenant int, " + PK.PACK_TYPE
WORD = ("word", "39", None, None, None, [r"\bzephyr\b"], "i")
COACH = ("soft", "15", None, "coach", None, [r"\bquartz\b"], "")
PACKS = [(1, 0, "a", [WORD]), (2, 0, "a", [WORD, COACH]), (3, 0, "a", [("word", "39", None, None, None, [r"\bquartz\b"], "i")]),
         (4, 0, "a", [("bad", "15", None, None, None, [r"(a+)+", "("], "")]), (5, 0, "a", []), (6, 0, "a", None), (None, 0, "a", [WORD])]
TEXT = "Zephyr and quartz"


def compiled(spark, packs=PACKS):
    return PK.compile_tenant_packs(spark.createDataFrame(packs, TYPE))


def ids(row, field="findings"):
    return [f.detector_id for f in row[field]]


def test_tenants_see_their_own_rules(spark):
    rules, owners = compiled(spark)
    # The first two tenants share one rule; refused patterns and packs without rules leave nothing.
    assert sorted((d.detector_id, d.patterns[0].source) for d in rules) == [
        ("pack:a:soft", r"\bquartz\b"), ("pack:a:word", r"\bquartz\b"), ("pack:a:word", r"\bzephyr\b")]
    assert {r.tenant: len(r.scopes) for r in owners.collect()} == {1: 1, 2: 2, 3: 1}
    rows = spark.createDataFrame([(k, TEXT) for k in (1, 2, 3, 4, 9, None)], "tenant int, text string")
    found = S.scan(PK.with_scopes(rows, owners), detectors=PK.apply_packs(rules), scopes="scopes").collect()
    assert {r.tenant: ids(r) for r in found} == {1: ["pack:a:word"], 2: ["pack:a:word", "pack:a:soft"], 3: ["pack:a:word"], 4: [], 9: [], None: []}
    assert {r.tenant: r.findings[0].match for r in found if r.findings} == {1: "Zephyr", 2: "Zephyr", 3: "quartz"}


@pytest.mark.parametrize("tenant", [1, 2, 3, 4])
def test_equal_to_one_tenant_compiled_alone(spark, tenant):
    rules, owners = compiled(spark)
    texts = [(tenant, t) for t in (TEXT, "write to a@b.example.org, zephyr", "QUARTZ", "", None)]
    rows = spark.createDataFrame(texts, "tenant int, text string")
    alone = PK.compile_packs(spark.createDataFrame([p[1:] for p in PACKS if p[0] == tenant], PK.PACK_TYPE))
    want = S.scan(rows, detectors=PK.apply_packs(alone)).select("text", "findings").collect()
    got = S.scan(PK.with_scopes(rows, owners), detectors=PK.apply_packs(rules), scopes="scopes").select("text", "findings").collect()
    key = lambda r: (r.text is None, r.text or "")
    assert sorted(want, key=key) == sorted(got, key=key)


def test_a_tenants_own_order_decides(spark):
    # Two warnings of one threat: the last in the tenant's order wins, whatever other tenants have.
    rule = lambda name: (name, "15", None, None, None, [r"\bquartz\b"], "")
    packs = [(1, 0, "p", [rule("x"), rule("y")]), (2, 0, "p", [rule("y"), rule("x")]), (2, 0, "p", [rule("y"), rule("x")])]
    rules, owners = compiled(spark, packs)
    rows = spark.createDataFrame([(1, TEXT), (2, TEXT)], "tenant int, text string")
    found = S.scan(PK.with_scopes(rows, owners), detectors=rules, scopes="scopes").collect()
    assert {r.tenant: ids(r) for r in found} == {1: ["pack:p:y"], 2: ["pack:p:x"]}


def test_decisions_and_stages(spark):
    output = ("late", "39", "output", None, None, [r"\bquartz\b"], "")
    rules, owners = compiled(spark, [(1, 0, "a", [WORD]), (2, 0, "a", [output])])
    policy = ({39: "block"}, None, None, None, None, None, None)
    rows = spark.createDataFrame([(t, s, TEXT, policy) for t in (1, 2) for s in ("prompt", "output")],
                                 f"tenant int, place string, text string, policy {P.POLICY_TYPE}")
    scoped = PK.with_scopes(rows, owners)
    done = P.decide(scoped, stage=scoped["place"], detectors=PK.apply_packs(rules), scopes="scopes").collect()
    assert {(r.tenant, r.place): r.decision for r in done} == {
        (1, "prompt"): "deny", (1, "output"): "allow", (2, "prompt"): "allow", (2, "output"): "deny"}


def test_one_text_pass_and_bounds(spark):
    rules, owners = compiled(spark)
    rows = PK.with_scopes(spark.createDataFrame([(1, TEXT)], "tenant int, text string"), owners)
    plan = S.scan(rows, detectors=(*DETECTORS, *rules), scopes="scopes")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    with pytest.raises(ValueError):
        S.scan(rows, detectors=rules)
    with pytest.raises(ValueError):
        PK.compile_tenant_packs(spark.createDataFrame(PACKS, TYPE), max_patterns=2)
    none, owners = compiled(spark, PACKS[4:6])
    assert none == [] and owners.count() == 0
