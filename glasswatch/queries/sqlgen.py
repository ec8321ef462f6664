"""SQL twins of the operators for an engine with RE2 regexes.

Only used to check results: the rules are shared data, the evaluation is not.
"""

from __future__ import annotations

from glasswatch.functions.regex_dialect import Pattern
from glasswatch.operators.scan import known, select
from glasswatch.rules.catalog import APPROVAL_THREATS, DATA_TIERS, THREATS
from glasswatch.rules.content import CONTENT_RULES
from glasswatch.rules.detectors import DETECTORS
from glasswatch.rules.model import LEVEL_RANK

_BY_ID = {t.threat_id: t for t in THREATS}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


WS = Pattern(r"\s+").re2()
TRIM = Pattern(r"^\s+|\s+$").re2()
NONBLANK = Pattern(r"\S").re2()


def blank(col: str) -> str:
    return f"({col} IS NULL OR NOT regexp_matches({col}, {q(NONBLANK)}))"


def first(col: str, p: Pattern) -> str:
    return f"NULLIF(regexp_extract({col}, {q(p.re2())}, {p.re2_group()}), '')"


def present(col: str, p: Pattern) -> str:
    return f"regexp_matches({col}, {q(p.re2())})"


def entropy(v: str) -> str:
    return (f"list_sum([-(c / length({v})) * log2(c / length({v})) FOR c IN "
            f"[CAST(length({v}) - length(replace({v}, ch, '')) AS DOUBLE) FOR ch IN list_distinct(string_split({v}, ''))]])")


def strong_secret(m: str, sha_is_harmless: bool = True) -> str:
    v = f"regexp_extract({m}, '[\"'']([^\"'']+)[\"'']\\z', 1)"
    harmless = ["'(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$'",
                "'(?i)^(?:changeme|todo|example|placeholder|your[-_].*|x{4,}|<.*>|\\$\\{.*\\})$'"]
    if sha_is_harmless:
        harmless.append("'(?i)^[0-9a-f]{40}$'")
    tests = " AND ".join(f"NOT regexp_matches({v}, {h})" for h in harmless)
    return f"(length({v}) >= 20 AND {tests} AND {entropy(v)} >= 3.5)"


def detector(col: str, d) -> str:
    if d.refine in ("strong_secret", "strong_secret_or_sha"):
        return "COALESCE(" + ", ".join(
            f"list_filter(regexp_extract_all({col}, {q(p.re2())}, 0), lambda m: {strong_secret('m', d.refine == 'strong_secret')})[1]"
            for p in d.patterns) + ")"
    return "COALESCE(" + ", ".join(first(col, p) for p in d.patterns) + ")"


def clip(m: str) -> str:
    flat = f"regexp_replace(regexp_replace({m}, {q(WS)}, ' ', 'g'), {q(TRIM)}, '', 'g')"
    return f"CASE WHEN length({flat}) > 48 THEN substr({flat}, 1, 48) || '…' ELSE {flat} END"


def djb2(v: str) -> str:
    """For text within the basic plane, where code points equal UTF-16 units."""
    codes = f"[CAST(ascii(c) AS HUGEINT) FOR c IN string_split({v}, '')]"
    codes = f"[CAST(unicode(c) AS HUGEINT) FOR c IN string_split({v}, '')]"
    return (f"CASE WHEN {v} = '' THEN 'h1505' ELSE 'h' || lower(ltrim(to_hex(CAST(list_reduce(list_prepend(CAST(5381 AS HUGEINT), {codes}), "
            f"lambda h, c: (h * 33 + c) % 4294967296) AS BIGINT)), '0')) END")


def hits_cte(src: str, keys: str, text: str = "text", stage: str = "prompt", detectors=DETECTORS, name: str = "hits", only=None) -> str:
    """``only``: detector -> condition on the rows it applies to."""
    rows = []
    for i, d in enumerate(known(select(detectors, stage), THREATS)):
        t = _BY_ID[d.threat_id]
        rows.append(f"SELECT {keys}, {i} AS ord, {d.threat_id} AS threat_id, {q(d.detector_id)} AS detector_id, {q(d.mode)} AS mode, "
                    f"{q(t.risk_level)} AS risk_level, {LEVEL_RANK[t.risk_level]} AS lvl, {t.risk_score} AS risk_score, "
                    f"{q(t.category)} AS category, {detector(text, d)} AS m FROM {src}"
                    + (f" WHERE {only[d]}" if only and d in only else ""))
    return f"{name}_raw AS (" + " UNION ALL ".join(rows) + f"), {name} AS (SELECT * FROM {name}_raw WHERE m IS NOT NULL AND m <> '')"


def findings_cte(keys: str, hits: str = "hits", name: str = "findings") -> str:
    """One row per key and threat, ranked from 1."""
    return (f"{name}_w AS (SELECT *, max(CASE WHEN mode = 'warn' THEN ord END) OVER (PARTITION BY {keys}, threat_id) AS lw, "
            f"min(ord) OVER (PARTITION BY {keys}, threat_id) AS fo FROM {hits}), "
            f"{name} AS (SELECT {keys}, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY lvl DESC, risk_score DESC, fo) AS INTEGER) AS rank, "
            f"threat_id, detector_id, mode, {clip('m')} AS match, risk_level, risk_score, category FROM {name}_w "
            f"WHERE ord = COALESCE(lw, fo))")


def scan_sql(src: str, keys: str, text: str = "text", stage: str = "prompt", detectors=DETECTORS, with_sql: str = "") -> str:
    return (f"WITH {with_sql}{hits_cte(src, keys, text, stage, detectors)}, {findings_cte(keys)} "
            f"SELECT {keys}, rank, threat_id, detector_id, mode, match, risk_level, risk_score, category FROM findings")


def content_cte(src: str, keys: str, text: str = "text", rules=CONTENT_RULES, name: str = "chits") -> str:
    rows = [f"SELECT {keys}, {i} AS ord, {q(r.rule_id)} AS rule_id, {q(r.label)} AS label, {q(r.severity)} AS severity, "
            f"COALESCE({', '.join(first(text, p) for p in r.patterns)}) AS m FROM {src}" for i, r in enumerate(rules)]
    return (f"{name} AS (SELECT {keys}, ord, rule_id, label, severity, {clip('m')} AS match FROM ("
            + " UNION ALL ".join(rows) + ") WHERE m IS NOT NULL)")


def tier_case(col: str = "threat_id") -> str:
    return "CASE " + " ".join(f"WHEN {col} IN ({', '.join(map(str, ids))}) THEN {q(t)}" for t, ids in DATA_TIERS.items()) + " END"


def approval(col: str = "threat_id") -> str:
    return f"{col} IN ({', '.join(map(str, APPROVAL_THREATS))})"


def redact_sql(text: str, stage: str = "prompt", detectors=DETECTORS, src: str = "t", keys: str = "doc_id") -> str:
    """CTE chain: one step per detector, so the SQL stays shallow."""
    steps, prev = [], src
    n = 0
    for d in select(detectors, stage):
        if d.mode == "coach":
            continue
        for p in d.patterns:
            tag = f"[REDACTED:#{d.threat_id}]"
            if d.refine:
                keep = strong_secret("m", d.refine == "strong_secret")
                expr = (f"list_reduce(list_prepend({text}, list_filter(regexp_extract_all({text}, {q(p.re2())}, 0), lambda m: {keep})), "
                        f"lambda a, m: replace(a, m, {q(tag)}))")
            elif p.re2_group():
                body = p.re2().replace("(?:^|", "(^|", 1)
                last = body.rindex(r"(?:\z|")
                body = body[:last] + r"(\z|" + body[last + len(r"(?:\z|"):]
                # A guard character may be shared by neighbours: the second pass takes those.
                one = f"regexp_replace({text}, {q(body)}, {q(chr(92) + '1' + tag + chr(92) + '3')}, 'g')"
                expr = f"regexp_replace({one}, {q(body)}, {q(chr(92) + '1' + tag + chr(92) + '3')}, 'g')"
            else:
                expr = f"regexp_replace({text}, {q(p.re2())}, {q(tag)}, 'g')"
            steps.append(f"r{n} AS (SELECT * REPLACE ({expr} AS {text}) FROM {prev})")
            prev, n = f"r{n}", n + 1
    return ", ".join(steps), prev
