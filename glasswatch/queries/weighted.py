"""Weighted signals over events derived from documents."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from glasswatch.operators import weighted as W
from glasswatch.operators.redact import redact
from glasswatch.functions.text import content_hash
from glasswatch.queries import query, sqlgen as G, table, texts
from glasswatch.queries.detection import SEEDED, seeded
from glasswatch.rules.catalog import THREATS
from glasswatch.rules.weighted import CODE_PATTERNS, ENTITY_PATTERNS, EVENT_TYPES, SHORTENER_HOSTS, WEIGHTED

_TYPE = "CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(EVENT_TYPES)) + " END"
_FILE = "CASE doc_id % 4 WHEN 0 THEN 'salary_' || source || '.xlsx' WHEN 1 THEN 'notes.txt' WHEN 2 THEN 'Contract-' || lang || '.pdf' ELSE source END"
_APPROVED = ("src0", "src3", "src7", "src9", "src12")


def events(spark, sf):
    return seeded(spark, sf).select(
        F.col("doc_id").alias("event_id"), F.expr(_TYPE).alias("type"), "text", F.expr(_FILE).alias("filename"),
        F.col("source").alias("tool"), (F.col("lang") == "de").alias("foreign_tag"), (F.col("doc_id") % 11 == 0).alias("unresolvable"))


_EVENTS = (f"{SEEDED}, ev AS (SELECT doc_id AS event_id, {_TYPE} AS type, text, {_FILE} AS filename, source AS tool, lang = 'de' AS foreign_tag, "
           "doc_id % 11 = 0 AS unresolvable FROM seeded)")

_LINK_RE = "(?i)https?://[^\\s\\x0b\\x{a0}\\x{feff}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000})<>\"'']+"
_HOST_RE = "(?i)^\\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:\\s]+)"
_SHOWN_RE = "(?i)^\\s*(?:https?://)?((?:[a-z0-9-]+\\.)+[a-z]{2,})(?:[/?#:].*)?\\s*$"
_A_RE = "(?i)<a\\s[^>]*href\\s*=\\s*[\"'']([^\"'']*)[\"''][^>]*>([^<]*)</a>"
_BARE = lambda h: f"regexp_replace({h}, '^www\\.', '')"


def _host(u: str) -> str:
    return f"lower(regexp_extract({u}, '{_HOST_RE}', 1))"


_LUHN = lambda m: (
    f"(list_sum([CASE WHEN (length(d) - i) % 2 = 0 THEN CAST(d[i] AS INT) ELSE (CAST(d[i] AS INT) * 2) // 10 + (CAST(d[i] AS INT) * 2) % 10 END "
    f"FOR i IN range(1, length(d) + 1)]) % 10 = 0)").replace("d[", "({0})[").replace("length(d)", "length({0})").replace(
        "{0}", f"regexp_replace({m}, '[^0-9]', '', 'g')")


def _entity(kind: str) -> str:
    if kind == "ANY_PII":
        return "(" + " OR ".join(_entity(k) for k in ENTITY_PATTERNS) + ")"
    p = ENTITY_PATTERNS[kind][0]
    if kind == "CREDIT_CARD":
        return f"(len(list_filter(regexp_extract_all(text, {G.q(p.re2())}, 0), lambda m: {_LUHN('m')})) > 0)"
    return G.present("text", p)


def _fired(s) -> str:
    if s.kind == "entity":
        return _entity(s.name)
    if s.kind == "code":
        return "(" + " OR ".join(G.present("text", p) for p in CODE_PATTERNS[s.name]) + ")"
    if s.kind == "url":
        hosts = ", ".join(G.q(h) for h in SHORTENER_HOSTS)
        if s.name == "SHORTENER":
            return f"(len(list_filter(regexp_extract_all(text, '{_LINK_RE}', 0), lambda u: {_BARE(_host('u'))} IN ({hosts}))) > 0)"
        if s.name == "DISPLAY_HREF_MISMATCH":
            return "false"
        return "unresolvable"
    if s.kind == "allowlist":
        return "tool NOT IN (" + ", ".join(G.q(t) for t in _APPROVED) + ")"
    if s.kind == "heuristic":
        return "foreign_tag"
    col = "filename" if s.scope == "filename" else "text"
    return "(" + " OR ".join(G.present(col, p) for p in s.patterns) + ")"


def _scored() -> str:
    rows = []
    for d in WEIGHTED:
        cells = [f"CASE WHEN {_fired(s)} THEN {s.weight} ELSE 0.00 END" for s in d.signals]
        value = f"greatest({', '.join(cells)}, 0.00)" if d.combine == "any" else f"least(1.00, {' + '.join(cells)})"
        kinds = ", ".join(G.q(t) for t in d.applies_to)
        rows.append(f"SELECT event_id, {G.q(d.detector_id)} AS detector_id, {d.threat_id} AS threat_id, CAST({value} AS DECIMAL(4,2)) AS confidence, "
                    f"CAST({d.fire} AS DECIMAL(4,2)) AS fire, CAST({d.escalate} AS DECIMAL(4,2)) AS escalate FROM ev WHERE type IN ({kinds})")
    return "scored AS (" + " UNION ALL ".join(rows) + ")"


_LEVEL = "CASE threat_id " + " ".join(f"WHEN {t.threat_id} THEN '{t.risk_level}'" for t in THREATS) + " END"


def _banded(critical: str | None = None, src: str = "scored") -> str:
    floor = f"CASE WHEN risk_level = 'Critical' THEN least(escalate, {critical}) ELSE escalate END" if critical else "escalate"
    return (f"banded AS (SELECT *, CASE WHEN confidence >= fire THEN 'confirmed' WHEN confidence >= {floor} AND confidence > 0 THEN 'ambiguous' "
            f"ELSE 'suppressed' END AS band FROM (SELECT *, {_LEVEL} AS risk_level FROM {src}))")


def scored(spark, sf):
    return W.score_events(events(spark, sf), approved_tools=_APPROVED)


def _num(df):
    return df.withColumn("confidence", F.col("confidence").cast("double"))


@query("weighted_bands",
       f"WITH {_EVENTS}, {_scored()}, {_banded()} SELECT event_id, detector_id, threat_id, CAST(confidence AS DOUBLE) AS confidence, risk_level, band FROM banded")
def weighted_bands(spark, sf):
    return _num(W.with_band(scored(spark, sf)).select("event_id", "detector_id", "threat_id", "confidence", "risk_level", "band"))


@query("weighted_critical_floor",
       f"WITH {_EVENTS}, {_scored()}, {_banded('0.15')} SELECT detector_id, band, count(*) AS events FROM banded GROUP BY ALL")
def weighted_critical_floor(spark, sf):
    return W.with_band(scored(spark, sf), Decimal("0.15")).groupBy("detector_id", "band").agg(F.count(F.lit(1)).alias("events"))


# Tenant thresholds: one row per region lowers the detectors listed here.
_OVERRIDES = {"dlp.pii.hr_sensitive": (0.2, 0.1), "output.fabricated_source": (0.4, 0.3), "ip.source_or_strategy": (0.9, 0.5)}


@query("weighted_threshold_override",
       f"WITH {_EVENTS}, {_scored()}, o(detector_id, f, e) AS (VALUES " + ", ".join(f"('{k}', {f}, {e})" for k, (f, e) in _OVERRIDES.items())
       + f"), s2 AS (SELECT event_id, s.detector_id, threat_id, confidence, COALESCE(f, fire) AS fire, COALESCE(e, escalate) AS escalate FROM scored s LEFT JOIN o USING (detector_id)), "
       + _banded(src="s2") + " SELECT detector_id, band, count(*) AS events FROM banded GROUP BY ALL")
def weighted_threshold_override(spark, sf):
    o = spark.createDataFrame([(k, *v) for k, v in _OVERRIDES.items()], "detector_id string, fire double, escalate double")
    return W.with_band(W.override_thresholds(scored(spark, sf), o)).groupBy("detector_id", "band").agg(F.count(F.lit(1)).alias("events"))


_VERDICT = "CASE event_id % 3 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'uncertain' ELSE 'rejected' END"
_MERGED = ("merged AS (SELECT event_id, threat_id, detector_id, confidence, band FROM (SELECT *, row_number() OVER (PARTITION BY event_id, threat_id "
           "ORDER BY confidence DESC, detector_id) AS rn FROM banded WHERE band <> 'suppressed') WHERE rn = 1)")


@query("merged_findings",
       f"WITH {_EVENTS}, {_scored()}, {_banded()}, {_MERGED} SELECT event_id, threat_id, detector_id, CAST(confidence AS DOUBLE) AS confidence, band FROM merged")
def merged_findings(spark, sf):
    return _num(W.merge_findings(W.with_band(scored(spark, sf)).where("band <> 'suppressed'")))


@query("adjudicated_findings",
       f"WITH {_EVENTS}, {_scored()}, {_banded()}, a AS (SELECT *, {_VERDICT} AS verdict FROM banded WHERE band <> 'suppressed') "
       "SELECT event_id, detector_id, threat_id, CASE WHEN band = 'ambiguous' AND verdict = 'uncertain' THEN 'queue' ELSE 'keep' END AS outcome FROM a "
       "WHERE band = 'confirmed' OR verdict = 'confirmed' OR (verdict = 'uncertain' AND risk_level IN ('Critical', 'High'))")
def adjudicated_findings(spark, sf):
    banded = W.with_band(scored(spark, sf))
    ids = seeded(spark, sf).select(F.col("doc_id").alias("event_id"))
    threats = sorted({d.threat_id for d in WEIGHTED})
    verdicts = ids.select("event_id", F.explode(F.array(*[F.lit(t) for t in threats])).alias("threat_id")).withColumn("verdict", F.expr(_VERDICT))
    kept, queue = W.adjudicate(banded, verdicts, tier3=True)
    cols = ["event_id", "detector_id", "threat_id"]
    return kept.select(*cols, F.lit("keep").alias("outcome")).unionByName(queue.select(*cols, F.lit("queue").alias("outcome")))


_COPY = "CASE threat_id " + " ".join(f"WHEN {t.threat_id} THEN {G.q(t.response)}" for t in THREATS) + " END"


@query("interventions",
       f"WITH {_EVENTS}, {_scored()}, {_banded()}, {_MERGED} SELECT threat_id, CASE WHEN {_LEVEL} IN ('Critical', 'High') THEN 'acknowledge' WHEN {_LEVEL} = 'Medium' THEN 'nudge' END AS intervention, "
       f"{_COPY} AS copy, count(*) AS findings FROM merged GROUP BY ALL")
def interventions(spark, sf):
    merged = W.merge_findings(W.with_band(scored(spark, sf)).where("band <> 'suppressed'"))
    return W.with_intervention(merged).groupBy("threat_id", "intervention", "copy").agg(F.count(F.lit(1)).alias("findings"))


def _evidence_sql() -> str:
    ctes, last = G.redact_sql("text", "prompt", src="x")
    return (f"WITH {SEEDED}, {G.hits_cte('seeded', 'doc_id')}, {G.findings_cte('doc_id')}, "
            f"x AS (SELECT doc_id, threat_id, match AS text FROM findings), {ctes} SELECT doc_id, threat_id, text AS evidence FROM {last}")


@query("redacted_evidence", _evidence_sql())
def redacted_evidence(spark, sf):
    from glasswatch.operators.scan import scan_rows
    rows = scan_rows(seeded(spark, sf), ["doc_id"]).select("doc_id", "threat_id", "match")
    return redact(rows, "match", "prompt", into="evidence").select("doc_id", "threat_id", "evidence")


@query("suppressed_exceptions",
       f"WITH {SEEDED}, {G.hits_cte('seeded', 'doc_id')}, {G.findings_cte('doc_id')}, f AS (SELECT s.source AS session_id, f.detector_id, {G.djb2('f.match')} AS content_hash, "
       "f.doc_id FROM findings f JOIN seeded s USING (doc_id)), e AS (SELECT session_id, detector_id, content_hash FROM f WHERE doc_id % 5 = 0) "
       "SELECT session_id, detector_id, count(*) AS findings FROM f WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.session_id = f.session_id AND "
       "e.detector_id = f.detector_id AND e.content_hash = f.content_hash) GROUP BY ALL")
def suppressed_exceptions(spark, sf):
    from glasswatch.operators.scan import scan_rows
    rows = scan_rows(seeded(spark, sf), ["doc_id", "source"]).select(
        "doc_id", F.col("source").alias("session_id"), "detector_id", content_hash(F.col("match")).alias("content_hash"))
    declared = rows.where(F.col("doc_id") % 5 == 0)   # what users called fine
    kept = W.suppress_exceptions(rows, declared)
    return kept.groupBy("session_id", "detector_id").agg(F.count(F.lit(1)).alias("findings"))


@query("anchor_mismatch",
       f"WITH l AS (SELECT page_id, unnest(list_zip(regexp_extract_all(html, '{_A_RE}', 1), regexp_extract_all(html, '{_A_RE}', 2))) AS z FROM (SELECT page_id, html || "
       "'<a href=\"https://www.' || CASE page_id % 3 WHEN 0 THEN 'example.org' ELSE 'other.test' END || '/x\">example.org/x</a>' AS html FROM pages)), "
       f"h AS (SELECT page_id, z[1] AS href, z[2] AS shown, {_host('z[1]')} AS href_host, lower(regexp_extract(z[2], '{_SHOWN_RE}', 1)) AS shown_host FROM l) "
       f"SELECT page_id, count(*) AS links, count(*) FILTER (href_host <> '') AS external, count(*) FILTER (href_host <> '' AND shown_host <> '' AND {_BARE('href_host')} <> {_BARE('shown_host')}) AS mismatched "
       "FROM h GROUP BY page_id")
def anchor_mismatch(spark, sf):
    extra = F.concat(F.lit('<a href="https://www.'), F.when(F.col("page_id") % 3 == 0, "example.org").otherwise("other.test"),
                     F.lit('/x">example.org/x</a>'))
    pages = texts(spark, sf, "pages").select("page_id", F.concat("html", extra).alias("html"))
    links = pages.select("page_id", F.explode(W.anchors(F.col("html"))).alias("a"))
    return links.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("links"), F.count_if(F.col("a.href_host") != "").alias("external"),
        F.count_if(W.mismatched(F.col("a"))).alias("mismatched"))


@query("shortener_links",
       "WITH t AS (SELECT page_id, url || ' ' || CASE page_id % 4 WHEN 0 THEN 'see http://bit.ly/' || page_id WHEN 1 THEN 'HTTPS://www.T.co/x' ELSE html END AS text FROM pages) "
       f"SELECT page_id, len(list_filter(regexp_extract_all(text, '{_LINK_RE}', 0), lambda u: {_BARE(_host('u'))} IN ({', '.join(G.q(h) for h in SHORTENER_HOSTS)}))) > 0 AS shortened FROM t")
def shortener_links(spark, sf):
    text = F.concat("url", F.lit(" "), F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("see http://bit.ly/"), "page_id"))
                    .when(F.col("page_id") % 4 == 1, "HTTPS://www.T.co/x").otherwise(F.col("html")))
    return texts(spark, sf, "pages").select("page_id", W.shortened(text).alias("shortened"))


@query("unapproved_tool_events",
       f"WITH {_EVENTS} SELECT tool, count(*) AS opens FROM ev WHERE type = 'tool.open' AND tool NOT IN ({', '.join(G.q(t) for t in _APPROVED)}) GROUP BY tool")
def unapproved_tool_events(spark, sf):
    approved = spark.createDataFrame([(t,) for t in _APPROVED], "tool string")
    return W.unapproved_tool_events(events(spark, sf), approved).groupBy("tool").agg(F.count(F.lit(1)).alias("opens"))
