"""Detection, content, redaction and reporting over documents, pages and turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from glasswatch.functions import refine as refiners
from glasswatch.functions.text import clip, content_hash
from glasswatch.operators import alerts as A
from glasswatch.operators import packs as PK
from glasswatch.operators import redact as R
from glasswatch.operators import scan as S
from glasswatch.operators.evaluation import confusion
from glasswatch.queries import query, sqlgen as G, table, texts
from glasswatch.queries.samples import PHRASES
from glasswatch.rules.catalog import THREATS
from glasswatch.rules.content import CONTENT_RULES
from glasswatch.rules.detectors import DETECTORS
from glasswatch.rules.model import Detector, cs

_FIELDS = ["rank", "threat_id", "detector_id", "mode", "match", "risk_level", "risk_score", "category"]


def seeded(spark, sf):
    """Documents, each ending in one of the example phrases."""
    phrases = S.literal_array(PHRASES, "string")
    return texts(spark, sf, "documents").select(
        "doc_id", "lang", "source", F.concat("text", F.lit("\n"), F.get(phrases, (F.col("doc_id") % len(PHRASES)).cast("int"))).alias("text"))


SEEDED = ("seeded AS (SELECT doc_id, lang, source, text || chr(10) || (["
          + ", ".join(G.q(p) for p in PHRASES) + f"])[doc_id % {len(PHRASES)} + 1] AS text FROM documents)")


@query("scan_documents_findings", G.scan_sql("documents", "doc_id"))
def scan_documents(spark, sf):
    return S.scan_rows(texts(spark, sf, "documents"), ["doc_id"]).select("doc_id", *_FIELDS)


@query("scan_seeded_prompts", G.scan_sql("seeded", "doc_id", with_sql=SEEDED + ", "))
def scan_seeded(spark, sf):
    return S.scan_rows(seeded(spark, sf), ["doc_id"]).select("doc_id", *_FIELDS)


@query("scan_seeded_output", G.scan_sql("seeded", "doc_id", stage="output", with_sql=SEEDED + ", "))
def scan_seeded_output(spark, sf):
    return S.scan_rows(seeded(spark, sf), ["doc_id"], stage="output").select("doc_id", *_FIELDS)


_SEEDED_TURNS = ("seeded_turns AS (SELECT conv_id, turn, role, text || chr(10) || ([" + ", ".join(G.q(p) for p in PHRASES)
                 + f"])[(conv_id * 7 + turn) % {len(PHRASES)} + 1] AS text FROM conversations)")
_TURN_STAGES = {"user": "prompt", "assistant": "output", "system": "file"}


@query("scan_turns_by_stage",
       "WITH " + _SEEDED_TURNS + ", " + ", ".join(
           G.hits_cte(f"(SELECT * FROM seeded_turns WHERE role = '{role}')", "conv_id, turn", stage=stage, name=f"h_{stage}") + ", "
           + G.findings_cte("conv_id, turn", f"h_{stage}", f"f_{stage}") for role, stage in _TURN_STAGES.items())
       + " " + " UNION ALL ".join(
           f"SELECT conv_id, turn, '{s}' AS stage, rank, threat_id, detector_id, mode, match, risk_level, risk_score, category FROM f_{s}"
           for s in _TURN_STAGES.values()))
def scan_turns(spark, sf):
    role = F.col("role")
    stage = F.when(role == "user", "prompt").when(role == "assistant", "output").otherwise("file")
    phrase = F.get(S.literal_array(PHRASES, "string"), ((F.col("conv_id") * 7 + F.col("turn")) % len(PHRASES)).cast("int"))
    df = texts(spark, sf, "conversations").withColumn("stage", stage).withColumn("text", F.concat("text", F.lit("\n"), phrase))
    return S.scan_rows(df, ["conv_id", "turn", "stage"], stage=F.col("stage")).select("conv_id", "turn", "stage", *_FIELDS)


@query("index_quarantine_pages",
       f"WITH {G.hits_cte('pages', 'page_id', 'html', 'index')}, {G.findings_cte('page_id')} "
       "SELECT p.page_id, p.url, CAST(count(f.threat_id) AS INTEGER) AS n_findings, count(f.threat_id) > 0 AS quarantined, "
       "max(CASE WHEN f.rank = 1 THEN f.detector_id END) AS top_detector FROM pages p LEFT JOIN findings f ON p.page_id = f.page_id "
       "GROUP BY p.page_id, p.url")
def index_quarantine(spark, sf):
    # One pass; scan_for_index splits the same result in two tables.
    done = S.scan(texts(spark, sf, "pages"), "html", "index")
    return done.select("page_id", "url", F.size("findings").alias("n_findings"), (F.size("findings") > 0).alias("quarantined"),
                       F.get("findings", F.lit(0))["detector_id"].alias("top_detector"))


@query("content_hits_seeded",
       f"WITH {SEEDED}, {G.content_cte('seeded', 'doc_id')} SELECT doc_id, rule_id, label, severity, match FROM chits")
def content_hits(spark, sf):
    done = S.scan_content(seeded(spark, sf))
    return done.select("doc_id", F.explode("content_hits").alias("c")).select("doc_id", "c.*")


_ALLOWED = ("drugs", "harassment")


@query("content_hits_allow_set",
       f"WITH {SEEDED}, {G.content_cte('seeded', 'doc_id', rules=[r for r in CONTENT_RULES if r.rule_id in _ALLOWED])} "
       "SELECT source, rule_id, count(*) AS hits FROM (SELECT c.*, s.source FROM chits c JOIN seeded s USING (doc_id)) GROUP BY source, rule_id")
def content_allow_set(spark, sf):
    done = S.scan_content(seeded(spark, sf), categories=_ALLOWED)
    return done.select("source", F.explode("content_hits.rule_id").alias("rule_id")).groupBy("source", "rule_id").agg(
        F.count(F.lit(1)).alias("hits"))


# -- organisation packs --------------------------------------------------------------

_INSULTS = r"\b(trash|scum|idiot|clown|worthless|moron|pathetic|loser)\b"
_ORG_PACKS = [(0, "house rules", [
    ("insult!", "16", "prompt", "coach", "Insulting wording.", [_INSULTS], "i"),
    ("token", "39", "prompt", "warn", None, [r"\btoken\s*=\s*\"[0-9a-f]{40}\"", r"(a+)+b"], None),
    ("maillike", "15", "prompt", "coach", "Mail address again.", [r"[\w.+-]+@[\w.-]+"], "g")])]


def org_packs(spark):
    return PK.compile_packs(spark.createDataFrame(_ORG_PACKS, PK.PACK_TYPE))


_PACK_RULES = (Detector("pack:houserules:insult", 16, tuple(p.__class__(p.source, "i") for p in cs(_INSULTS)), mode="coach"),
               Detector("pack:houserules:token", 39, cs(r"\btoken\s*=\s*\"[0-9a-f]{40}\"")),
               Detector("pack:houserules:maillike", 15, cs(r"[\w.+-]+@[\w.-]+"), mode="coach"))


@query("org_pack_findings", G.scan_sql("documents", "doc_id", detectors=(*DETECTORS, *_PACK_RULES)))
def org_pack_findings(spark, sf):
    rules = PK.apply_packs(org_packs(spark))
    return S.scan_rows(texts(spark, sf, "documents"), ["doc_id"], detectors=rules).select("doc_id", *_FIELDS)


# Packs derived from parts: ids, threats and patterns of varying quality.
_PART_PATTERNS = ("p_brand || '-' || p_size", "'(' || p_name || '+)+'", "p_name || '+*'", "''", "repeat(p_name, 60)",
                  "'\\b' || p_name || '\\b'")
_PACK_SQL = (
    "WITH p AS (SELECT p_partkey, p_name, CASE p_size % 6 " + " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(_PART_PATTERNS))
    + " END AS pattern, CASE p_partkey % 5 WHEN 0 THEN '39' WHEN 1 THEN '1.5' WHEN 2 THEN 'x' WHEN 3 THEN ' 15 ' ELSE '40.0' END AS threat, "
      "CASE p_partkey % 3 WHEN 0 THEN 'output' WHEN 1 THEN 'prompt' ELSE 'else' END AS stage, "
      "CASE p_partkey % 4 WHEN 0 THEN 'coach' ELSE 'loud' END AS mode, p_type FROM part), "
      "n AS (SELECT *, TRY_CAST(trim(threat) AS DOUBLE) AS num FROM p) "
      "SELECT p_partkey AS pack_no, 'pack:' || COALESCE(NULLIF(substr(regexp_replace(p_name, '[^A-Za-z0-9_-]', '', 'g'), 1, 40), ''), 'pack') "
      "|| ':' || COALESCE(NULLIF(substr(regexp_replace(p_type, '[^A-Za-z0-9_-]', '', 'g'), 1, 40), ''), 'rule') AS detector_id, "
      "CASE WHEN num = floor(num) THEN CAST(num AS INTEGER) END AS threat_id, "
      "CASE WHEN stage = 'output' THEN 'output' ELSE 'prompt' END AS stage, CASE WHEN mode = 'coach' THEN 'coach' ELSE 'warn' END AS mode, "
      "CASE WHEN num IS NULL OR num <> floor(num) THEN 'threat is not an integer' WHEN pattern = '' THEN 'empty' "
      "WHEN length(pattern) > 400 THEN 'too long' WHEN regexp_matches(pattern, '\\([^)]*[+*][^)]*\\)\\s*[+*]') THEN 'nested quantifier' "
      "WHEN regexp_matches(pattern, '[+*}]\\s*[+*]') THEN 'adjacent quantifier' END AS problem FROM n")


@query("pack_validation", _PACK_SQL)
def pack_validation(spark, sf):
    p = table(spark, sf, "part")
    pattern = F.expr("CASE p_size % 6 " + " ".join(
        f"WHEN {i} THEN {e}" for i, e in enumerate(x.replace("'\\b'", "r'\\b'") for x in _PART_PATTERNS)) + " END")
    threat = F.expr("CASE p_partkey % 5 WHEN 0 THEN '39' WHEN 1 THEN '1.5' WHEN 2 THEN 'x' WHEN 3 THEN ' 15 ' ELSE '40.0' END")
    stage = F.expr("CASE p_partkey % 3 WHEN 0 THEN 'output' WHEN 1 THEN 'prompt' ELSE 'else' END")
    mode = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'coach' ELSE 'loud' END")
    packs = p.select(F.col("p_partkey").alias("pack_no"), F.col("p_name").alias("pack_id"), F.array(F.struct(
        F.col("p_type").alias("detectorId"), threat.alias("threatId"), stage.alias("stage"), mode.alias("mode"),
        F.lit(None).cast("string").alias("hint"), F.array(pattern).alias("patterns"), F.lit("i").alias("flags"))).alias("detectors"))
    return PK.validate_packs(packs).select("pack_no", "detector_id", "threat_id", "stage", "mode", "problem")


# -- single matches -----------------------------------------------------------------------

_CONTACT = ("dlp-phone", "dlp-email", "dlp-national-id")
_CONTACT_PATTERNS = [p for name in _CONTACT for d in DETECTORS if d.detector_id == name for p in d.patterns]


@query("first_match_contact",
       "SELECT doc_id, m AS first_contact FROM (SELECT doc_id, COALESCE("
       + ", ".join(G.first("text", p) for p in _CONTACT_PATTERNS) + ") AS m FROM documents) WHERE m IS NOT NULL")
def first_match_contact(spark, sf):
    docs = texts(spark, sf, "documents").select("doc_id", "text")
    return S.first_match(docs, "text", _CONTACT_PATTERNS, "first_contact").select("doc_id", "first_contact") \
        .where(F.col("first_contact").isNotNull())


_TOKEN_RULE = Detector("token", 39, next(d for d in DETECTORS if d.detector_id == "secret-assignment").patterns,
                       refine="strong_secret_or_sha")


@query("refined_tokens",
       f"WITH {SEEDED} SELECT doc_id, m AS secret_hash, e AS bits FROM (SELECT doc_id, {G.djb2('v')} AS m, "
       f"round({G.entropy('v')}, 6) AS e FROM (SELECT doc_id, regexp_extract(x, '[\"'']([^\"'']+)[\"'']\\z', 1) AS v FROM "
       f"(SELECT doc_id, {G.detector('text', _TOKEN_RULE)} AS x FROM seeded) WHERE x IS NOT NULL))")
def refined_tokens(spark, sf):
    found = S.detector_match(seeded(spark, sf), "text", _TOKEN_RULE, "x").select("doc_id", "x").where("x IS NOT NULL")
    value = found.select("doc_id", refiners.secret_value(F.col("x")).alias("v"))
    return value.select("doc_id", content_hash(F.col("v")).alias("secret_hash"),
                        F.round(refiners.entropy(F.col("v")), 6).alias("bits"))


@query("clip_and_hash",
       f"SELECT doc_id, c AS clipped, {G.djb2('c')} AS tag FROM (SELECT doc_id, {G.clip('text')} AS c FROM documents)")
def clip_and_hash(spark, sf):
    cut = texts(spark, sf, "documents").select("doc_id", clip(F.col("text")).alias("clipped"))
    return cut.select("doc_id", "clipped", content_hash(F.col("clipped")).alias("tag"))


# -- redaction ----------------------------------------------------------------------------------

def _redact_query(stage: str) -> str:
    ctes, last = G.redact_sql("text", stage, src="seeded")
    return f"WITH {SEEDED}, {ctes} SELECT doc_id, md5(text) AS masked_md5, CAST(length(text) AS INTEGER) AS masked_length FROM {last}"


@query("redact_prompts", _redact_query("prompt"))
def redact_prompts(spark, sf):
    done = R.redact(seeded(spark, sf), "text", "prompt")
    return done.select("doc_id", F.md5("redacted").alias("masked_md5"), F.length("redacted").alias("masked_length"))


@query("redact_output", _redact_query("output"))
def redact_output(spark, sf):
    done = R.redact(seeded(spark, sf), "text", "output")
    return done.select("doc_id", F.md5("redacted").alias("masked_md5"), F.length("redacted").alias("masked_length"))


_MAIL, _PHONE = _CONTACT_PATTERNS[1], _CONTACT_PATTERNS[0]


@query("redact_literal_spans",
       f"WITH {SEEDED}, s AS (SELECT doc_id, text, {G.first('text', _MAIL)} AS a, {G.first('text', _PHONE)} AS b FROM seeded) "
       "SELECT doc_id, md5(CASE WHEN a IS NULL AND b IS NULL THEN text WHEN a IS NULL THEN replace(text, b, '[REDACTED]') "
       "WHEN b IS NULL THEN replace(text, a, '[REDACTED]') WHEN length(a) >= length(b) THEN replace(replace(text, a, '[REDACTED]'), b, '[REDACTED]') "
       "ELSE replace(replace(text, b, '[REDACTED]'), a, '[REDACTED]') END) AS masked_md5 FROM s")
def redact_literal_spans(spark, sf):
    work = S.first_match(S.first_match(seeded(spark, sf), "text", [_MAIL], "a"), "text", [_PHONE], "b")
    spans = work.select("doc_id", "text", F.array("a", "b").alias("spans"))
    return spans.select("doc_id", F.md5(R.redact_literal(F.col("text"), F.col("spans"))).alias("masked_md5"))


# Personal data is blocked, payment context asked about; two content rules hold text back.
_HOLD = {15: "block", 11: "justify"}
_HOLD_CONTENT = {"harassment": "block", "drugs": "justify"}


def _spans_cte(src: str, name: str) -> str:
    held_rules = ", ".join(G.q(r) for r in _HOLD_CONTENT)
    return (f"{G.hits_cte(src, 'doc_id', name=f'h{name}')}, {G.findings_cte('doc_id', f'h{name}', f'f{name}')}, "
            f"{G.content_cte(src, 'doc_id', name=f'c{name}')}, "
            f"s{name} AS (SELECT doc_id, list(match ORDER BY length(match) DESC, kind, pos) AS spans FROM ("
            f"SELECT doc_id, match, 0 AS kind, ord AS pos FROM c{name} WHERE rule_id IN ({held_rules}) UNION ALL "
            f"SELECT doc_id, match, 1, rank FROM f{name} WHERE threat_id IN ({', '.join(map(str, _HOLD))})) GROUP BY doc_id)")


@query("salvage_prompts",
       f"WITH {SEEDED}, {_spans_cte('seeded', '1')}, t2 AS (SELECT s.doc_id, s.text AS old, list_reduce(list_prepend(s.text, x.spans), "
       "lambda a, m: replace(a, m, '[REDACTED]')) AS text FROM seeded s JOIN s1 x USING (doc_id)), "
       f"{_spans_cte('t2', '2')} SELECT t2.doc_id, md5(t2.text) AS salvaged_md5 FROM t2 LEFT JOIN s2 USING (doc_id) "
       "WHERE s2.doc_id IS NULL AND t2.text <> t2.old")
def salvage_prompts(spark, sf):
    threat = lambda f: F.when(f["threat_id"] == 15, "block").when(f["threat_id"] == 11, "justify").otherwise("notify")
    content = lambda c: F.when(c["rule_id"] == "harassment", "block").when(c["rule_id"] == "drugs", "justify").otherwise("disabled")
    done = R.salvageable(seeded(spark, sf), "text", threat, content)
    return done.where(F.col("salvaged").isNotNull()).select("doc_id", F.md5("salvaged").alias("salvaged_md5"))


# -- reporting ----------------------------------------------------------------------------------------

@query("upload_events_pages",
       "SELECT page_id, 'upload' AS stage, 18 AS threat_id, GREATEST(1, CAST(floor(length(html) / 1024.0 + 0.5) AS BIGINT)) AS size_kb, "
       f"{G.djb2('url')} AS content_hash FROM pages")
def upload_events_pages(spark, sf):
    files = texts(spark, sf, "pages").select(F.col("page_id").cast("string").alias("device"), F.col("url").alias("name"),
                                            F.length("html").alias("size"), F.lit("text/html").alias("mime"))
    return A.upload_events(files).select(F.col("device").cast("long").alias("page_id"), "stage", "threat_id", "size_kb", "content_hash")


_LINKS = {t.threat_id: len(t.sources) for t in THREATS}


@query("source_links_by_threat",
       f"WITH {SEEDED}, {G.hits_cte('seeded', 'doc_id')}, {G.findings_cte('doc_id')} "
       "SELECT threat_id, CAST(CASE threat_id " + " ".join(f"WHEN {k} THEN {v}" for k, v in _LINKS.items())
       + " END AS INTEGER) AS links, count(*) AS findings FROM findings GROUP BY threat_id")
def source_links_by_threat(spark, sf):
    from glasswatch.operators.policy import source_links, threat_lookup
    rows = S.scan_rows(seeded(spark, sf), ["doc_id"]).groupBy("threat_id").agg(F.count(F.lit(1)).alias("findings"))
    return rows.select("threat_id", F.size(source_links(threat_lookup("sources", "array<string>")(F.col("threat_id")))).alias("links"), "findings")


@query("detectability_coverage",
       f"WITH {SEEDED}, {G.hits_cte('seeded', 'doc_id')}, {G.findings_cte('doc_id')}, c(threat_id, detect_class) AS (VALUES "
       + ", ".join(f"({t.threat_id}, '{t.detect_class}')" for t in THREATS)
       + f"), d AS (SELECT *, threat_id IN ({', '.join(str(i) for i in sorted({d.threat_id for d in DETECTORS}))}) AS covered FROM c) "
       "SELECT detect_class, count(DISTINCT d.threat_id) AS threats, count(DISTINCT CASE WHEN covered THEN d.threat_id END) AS with_detector, "
       "count(f.doc_id) AS findings FROM d LEFT JOIN findings f ON f.threat_id = d.threat_id GROUP BY detect_class")
def detectability_coverage(spark, sf):
    from glasswatch.operators.fleet import detectability_coverage as coverage
    from glasswatch.operators.policy import threat_lookup, threat_table
    rows = S.scan_rows(seeded(spark, sf), ["doc_id"]).groupBy(
        threat_lookup("detect_class", "string")(F.col("threat_id")).alias("detect_class")).agg(F.count(F.lit(1)).alias("n"))
    return coverage(threat_table(spark)).join(rows, "detect_class", "left").select(
        "detect_class", "threats", "with_detector", F.coalesce("n", F.lit(0)).cast("long").alias("findings"))


# -- evaluation -------------------------------------------------------------------------------------------

@query("precision_recall_toxic",
       f"WITH p AS (SELECT l.doc_id, l.toxic = 1 AS t, regexp_matches(d.text, '(?i){_INSULTS}') AS y FROM labels l JOIN documents d USING (doc_id)), "
       "c AS (SELECT 'pack:houserules:insult' AS rule, count(*) FILTER (y AND t) AS tp, count(*) FILTER (y AND NOT t) AS fp, "
       "count(*) FILTER (NOT y AND t) AS fn, count(*) FILTER (NOT y AND NOT t) AS tn FROM p) "
       "SELECT *, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp)::DOUBLE, 6) END AS precision, "
       "CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn)::DOUBLE, 6) END AS recall FROM c")
def precision_recall_toxic(spark, sf):
    docs = texts(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id")
    hits = S.scan(docs, detectors=org_packs(spark)[:1])
    pred = hits.select(F.lit("pack:houserules:insult").alias("rule"), (F.size("findings") > 0).alias("y"), (F.col("toxic") == 1).alias("t"))
    return confusion(pred, "rule", "y", "t").withColumn("precision", F.round("precision", 6)).withColumn("recall", F.round("recall", 6))


# Threat each example phrase must raise as a prompt; null where it must raise none of its own.
_EXPECT = (None, 3, 3, 3, 3, 3, 3, 40, 40, 40, 41, 45, 45, 45, 42, 15, 15, 1, 1, 39, 39, 39, 39, 39, None, 39, 39, 39, 15, 9, 3, 2, 11,
           43, 43, 44, 15, 1, 46, 47, 48, 49, None, None, None, None, 43, None)
_EXPECT_SQL = "([" + ", ".join("NULL" if e is None else str(e) for e in _EXPECT) + f"])[doc_id % {len(PHRASES)} + 1]"


@query("redteam_eval",
       f"WITH {SEEDED}, {G.hits_cte('seeded', 'doc_id')}, {G.findings_cte('doc_id')}, c AS (SELECT s.doc_id, {_EXPECT_SQL} AS expect, "
       f"list(f.threat_id) FILTER (f.threat_id IS NOT NULL) AS ids FROM seeded s LEFT JOIN findings f USING (doc_id) GROUP BY s.doc_id) "
       "SELECT expect, count(*) FILTER (CASE WHEN expect IS NULL THEN ids IS NULL ELSE COALESCE(list_contains(ids, expect), false) END) AS passed, count(*) AS total FROM c GROUP BY expect")
def redteam_eval(spark, sf):
    from glasswatch.operators.evaluation import evaluate_cases
    expect = F.get(S.literal_array(_EXPECT, "int"), (F.col("doc_id") % len(PHRASES)).cast("int"))
    cases = seeded(spark, sf).select(
        F.col("doc_id").cast("string").alias("id"), "text", F.lit(None).cast("array<string>").alias("turns"),
        F.lit(None).cast("string").alias("stage"), expect.alias("expect"), expect.isNull().alias("none"))
    return evaluate_cases(cases).groupBy("expect").agg(F.count_if("ok").alias("passed"), F.count(F.lit(1)).alias("total"))
