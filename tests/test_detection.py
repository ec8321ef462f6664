import random

import pytest
from pyspark.sql import functions as F

from glasswatch.functions.regex_dialect import Pattern, PatternError
from glasswatch.functions.text import client_id, clip, content_hash, entropy, is_blank, strip_ansi, version_outdated
from glasswatch.operators import scan as S
from glasswatch.operators.evaluation import CASE_TYPE, evaluate_cases, score
from glasswatch.operators.redact import redact, redact_literal, salvageable
from glasswatch.queries.samples import PHRASES
from glasswatch.rules.content import CONTENT_RULES
from glasswatch.rules.detectors import DETECTORS
from glasswatch.rules.model import Detector, ci, cs
from tests import model
from tests.corpus import CASES

FILLER = ["the river runs ", "42 ", "a.b ", "NDA ", "é ", "\n", "  ", "user@x.io ", "“quote” ", "K9 ", "555-867-5309 "]


def texts(n=300, seed=5):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        parts = [rng.choice(PHRASES) if rng.random() < 0.4 else rng.choice(FILLER) for _ in range(rng.randint(0, 6))]
        out.append("".join(parts))
    return out + ["", "   ", None, *PHRASES]


@pytest.fixture(scope="module")
def sample(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "id int, text string").cache()


@pytest.mark.parametrize("stage", ["prompt", "file", "output", "session"])
def test_scan_equals_model(spark, sample, stage):
    got = {r.id: [(f.threat_id, f.detector_id, f.match) for f in r.findings] for r in S.scan(sample, stage=stage).collect()}
    for i, t in enumerate(texts()):
        assert got[i] == model.scan(t, stage), (i, t)


def test_stage_column_equals_constant_stage(spark, sample):
    mixed = sample.withColumn("stage", F.element_at(F.array(*map(F.lit, ("prompt", "output", "index"))), F.col("id") % 3 + 1))
    for r in S.scan(mixed, stage=F.col("stage")).collect():
        assert [(f.threat_id, f.detector_id, f.match) for f in r.findings] == model.scan(r.text, r.stage)


def test_redact_equals_model(spark, sample):
    for stage in ("prompt", "output"):
        for r in redact(sample, stage=stage).collect():
            assert r.redacted == (r.text if r.text is None else model.redact(r.text, stage)), r


def test_redact_after_neighbour_is_masked(spark):
    # Masking the number makes the word that followed it stand alone.
    df = spark.createDataFrame([("123456789DAN",)], "text string")
    assert redact(df).first().redacted == model.redact("123456789DAN", "prompt") == "[REDACTED:#15][REDACTED:#3]"


def test_redact_is_stable_on_samples(spark, sample):
    once = redact(sample).select(F.col("redacted").alias("text")).where("text IS NOT NULL")
    twice = redact(once)
    assert twice.where(F.col("text") != F.col("redacted")).count() == 0


def test_corpus(spark):
    rows = [(i, None if isinstance(t, list) else t, t if isinstance(t, list) else None, s, e, e is None) for i, t, s, e in CASES]
    out = evaluate_cases(spark.createDataFrame(rows, CASE_TYPE))
    result = score(out).first()
    assert result.failed == [] and result.passed == result.total == len(CASES), out.where("NOT ok").select("id", "why").collect()


def test_dedupe_and_rank_equal_fold(spark):
    rng = random.Random(1)
    dets = [Detector(f"d{i}", rng.choice([1, 9, 15, 16, 26, 39, 41]), cs(f"w{i}x"), mode=rng.choice(["warn", "coach"])) for i in range(14)]
    rows = [(i, " ".join(f"w{k}x" for k in range(14) if rng.random() < 0.5)) for i in range(200)]
    got = S.scan(spark.createDataFrame(rows, "id int, text string"), detectors=dets).collect()
    for r in got:
        want = model.reduce([(d, d.patterns[0].source) for d in dets if d.patterns[0].source in r.text.split()])
        assert [(f.threat_id, f.detector_id, f.match) for f in r.findings] == want


def test_unknown_threat_and_empty_match(spark):
    dets = [Detector("gone", 999, cs("abc")), Detector("zero", 15, (*cs("x*"), *cs("abc"))), Detector("ok", 39, cs("b"))]
    df = spark.createDataFrame([("abc",)], "text string")
    # The empty match of the first pattern ends that detector's search without a hit.
    assert [f.detector_id for f in S.scan(df, detectors=dets).first().findings] == ["ok"]


def test_content_rules(spark, sample):
    for r in S.scan_content(sample).collect():
        want = [(c.rule_id, model.clip(m)) for c in CONTENT_RULES if r.text and (m := model.first(r.text, c.patterns))]
        assert [(c.rule_id, c.match) for c in r.content_hits] == want
    only = S.scan_content(sample, categories=["drugs"])
    assert {c.rule_id for r in only.collect() for c in r.content_hits} == {"drugs"}


def test_review_equals_separate_scans(spark, sample):
    both = {r.id: (r.findings, r.content_hits) for r in S.review(sample).collect()}
    one = {r.id: r.findings for r in S.scan(sample).collect()}
    two = {r.id: r.content_hits for r in S.scan_content(sample).collect()}
    assert both == {i: (one[i], two[i]) for i in one}


def test_index_split(spark, sample):
    clean, held = S.scan_for_index(sample)
    assert clean.count() + held.count() == sample.count() and clean.count() > 0 < held.count()


def test_no_shuffle_single_python_pass_and_pushdown(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).selectExpr("id", "'a@b.co' AS text", "'z' AS unused").write.parquet(path)
    df = S.scan(spark.read.parquet(path).select("id", "text", "unused")).where((F.size("findings") > 0) & (F.col("id") > 1)).select("id", "findings")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan
    assert "GreaterThan(id,1)" in plan and "unused" not in plan.split("ReadSchema")[1]
    assert df.count() == 3


# -- dialect --------------------------------------------------------------------------

@pytest.mark.parametrize("source,flags,text,want", [
    (r"\bNDA\b", "", "éNDA", "NDA"),            # word edges are ASCII
    (r"été", "i", "ÉTÉ", "ÉTÉ"),                # accents fold
    (r"a\s+b", "", "a b", "a b"),     # no-break space is white space
    (r"x$", "", "x\n", None),                   # end means end
    (r"a.b", "", "a\u0085b", "a\u0085b"),       # next-line is no line end
    (r"a.b", "", "a b", None),
    (r"[[a&&b]+", "", "x[a&&b", "[a&&b"),       # brackets and && are literal in a class
    (r"k", "i", "K", None),                # the Kelvin sign is no k
    (r"talimatları", "i", "TALIMATLARI", None),
    (r"\/x", "", "/x", "/x"),
])
def test_dialect(spark, source, flags, text, want):
    df = spark.createDataFrame([(text,)], "text string")
    assert S.first_match(df, "text", [Pattern(source, flags)], "m").first().m == want


def test_dialect_refuses():
    for bad in (r"(", r"\p{L}", r"(?<name>a)", "[z-a]", "a*+"):
        with pytest.raises(PatternError):
            Pattern(bad).java()


def test_anchors_are_necessary():
    """Whatever a pattern matches holds one of its anchors and its digits."""
    for t in [x for x in texts(600, 9) if x]:
        for d in (*DETECTORS, *CONTENT_RULES):
            for p in d.patterns:
                m = model.compiled(p).search(t)
                if m:
                    low = m.group(0).lower()
                    assert p.anchors() is None or any(a.literal in low for a in p.anchors())
                    assert sum(c in "0123456789" for c in low) >= p.min_digits


# -- scalar functions ----------------------------------------------------------------------

def test_text_functions(spark):
    def djb(s):
        h = 5381
        raw = s.encode("utf-16-be")
        for i in range(0, len(raw), 2):
            h = (h * 33 + int.from_bytes(raw[i:i + 2], "big")) % 2**32
        return h
    words = ["", "a", "héllo", "😀 x", "longer text with spaces", "אב"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for r in df.select("w", content_hash(F.col("w")).alias("h"), client_id(F.col("w")).alias("c"), entropy(F.col("w")).alias("e")).collect():
        h = djb(r.w)
        assert r.h == f"h{h:x}"
        assert r.c == f"c-{abs(h - 2**32 if h >= 2**31 else h):x}"
    assert df.select(content_hash(F.lit(""))).first()[0] == "h1505"
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(clip(F.lit("  a \n\t b  "))) == "a b"
    assert one(clip(F.lit("x" * 60))) == "x" * 48 + "…"
    assert one(is_blank(F.lit(" \n"))) is True
    assert one(strip_ansi(F.lit("\u001b[31mred\u001b[0m"))) == "red"
    assert abs(one(entropy(F.lit("aabb"))) - 1.0) < 1e-9
    for cur, new, want in (("1.2.3", "1.2.4", True), ("1.10", "1.9.9", False), ("1.x", "1.0.1", True), ("2", "", False), ("2", "2.0.0", False)):
        assert one(version_outdated(F.lit(cur), F.lit(new))) is want


def test_redact_literal_longest_first(spark):
    df = spark.createDataFrame([("key 12345 and 123", ["123", "12345", None, ""])], "t string, s array<string>")
    assert df.select(redact_literal(F.col("t"), F.col("s"))).first()[0] == "key [REDACTED] and [REDACTED]"


def test_salvage(spark):
    rows = [("short a@b.co here",), ("clean",), ("mail " + "y" * 60 + "@example.org end",)]
    out = salvageable(spark.createDataFrame(rows, "text string"), "text",
                      lambda f: F.when(f["threat_id"] == 15, "block").otherwise("notify"), lambda c: F.lit("disabled"))
    got = {r.text: r.salvaged for r in out.collect()}
    # A clipped span is not found in the text, so that prompt cannot be salvaged.
    assert list(got.values()) == ["short [REDACTED] here", None, None]


def test_refine_from_python(spark):
    from glasswatch.functions.refine import first_passing
    df = spark.createDataFrame([(["a1", "b22", "c333"],), ([],), (None,)], "c array<string>")
    assert [r[0] for r in df.select(first_passing(F.col("c"), lambda s: len(s) > 2)).collect()] == ["b22", None, None]


def test_luhn_refinement(spark):
    rule = Detector("card", 1, cs(r"\b(?:\d[ -]?){13,16}\b"), refine="luhn")
    df = spark.createDataFrame([("4111 1111 1111 1112 then 4111 1111 1111 1111",)], "text string")
    assert S.detector_match(df, "text", rule, "m").first().m.strip() == "4111 1111 1111 1111"


def test_patterns_with_case_flag(spark):
    df = spark.createDataFrame([("PIP",), ("pip",)], "text string")
    got = {r.text: {f.threat_id for f in r.findings} for r in S.scan(df).collect()}
    assert got == {"PIP": {42}, "pip": set()}
    assert ci("a")[0].ignore_case and not cs("a")[0].ignore_case
