"""Decisions under per-tenant policies derived from the nation table."""

from __future__ import annotations

from pyspark.sql import functions as F

from glasswatch.operators import alerts as A
from glasswatch.operators import packs as PK
from glasswatch.operators import policy as P
from glasswatch.operators import scan as S
from glasswatch.operators import toolcalls as TC
from glasswatch.plans.asof import asof_join
from glasswatch.plans.skew import salted_join
from glasswatch.queries import query, sqlgen as G, table, texts
from glasswatch.queries.detection import SEEDED, seeded
from glasswatch.rules.detectors import DETECTORS
from glasswatch.rules.model import Detector, ci



# tenant = nation key.  What a tenant sets follows from its region and key.
_POLICY_SQL = """policies AS (SELECT n_nationkey AS tenant, n_regionkey AS region,
 CASE n_regionkey WHEN 0 THEN 'block' WHEN 1 THEN 'justify' WHEN 2 THEN 'alert' WHEN 3 THEN '' END AS t39,
 CASE n_nationkey % 3 WHEN 0 THEN 'block' WHEN 1 THEN 'disabled' END AS t15,
 CASE n_nationkey % 2 WHEN 0 THEN 'notify' END AS t43,
 CASE n_regionkey WHEN 1 THEN 'justify' WHEN 3 THEN 'block' END AS secret, CASE n_nationkey % 4 WHEN 2 THEN 'justify' END AS pii,
 CASE n_nationkey % 5 WHEN 0 THEN 'block' WHEN 1 THEN 'justify' WHEN 2 THEN 'disabled' WHEN 3 THEN 'notify' END AS c_drugs,
 CASE n_nationkey % 3 WHEN 1 THEN 'block' WHEN 2 THEN 'alert' END AS c_harassment,
 n_regionkey <> 4 AS out_review, n_nationkey % 7 = 0 AS out_redact FROM nation)"""


def policies(spark, sf):
    """(tenant, policy): one row per nation."""
    e = F.expr
    some = lambda *kv: F.map_filter(F.create_map(*kv), lambda k, v: v.isNotNull())
    n = table(spark, sf, "nation")
    tp = some(F.lit(39), e("CASE n_regionkey WHEN 0 THEN 'block' WHEN 1 THEN 'justify' WHEN 2 THEN 'alert' WHEN 3 THEN '' END"),
              F.lit(15), e("CASE n_nationkey % 3 WHEN 0 THEN 'block' WHEN 1 THEN 'disabled' END"),
              F.lit(43), e("CASE n_nationkey % 2 WHEN 0 THEN 'notify' END"))
    tier = some(F.lit("secret"), e("CASE n_regionkey WHEN 1 THEN 'justify' WHEN 3 THEN 'block' END"),
                F.lit("pii"), e("CASE n_nationkey % 4 WHEN 2 THEN 'justify' END"))
    content = some(F.lit("drugs"), e("CASE n_nationkey % 5 WHEN 0 THEN 'block' WHEN 1 THEN 'justify' WHEN 2 THEN 'disabled' WHEN 3 THEN 'notify' END"),
                   F.lit("harassment"), e("CASE n_nationkey % 3 WHEN 1 THEN 'block' WHEN 2 THEN 'alert' END"))
    mcp = F.when(F.col("n_regionkey") == 0, F.array(F.lit("view"), F.lit("click"))).when(
        F.col("n_regionkey") == 1, F.array().cast("array<string>")).when(F.col("n_regionkey") == 2, F.array(F.lit("error")))
    tools = F.when(F.col("n_nationkey") % 3 == 0, F.array(F.lit("view"), F.lit("purchase"))).when(
        F.col("n_nationkey") % 3 == 1, F.array(F.lit("click")))
    return n.select(F.col("n_nationkey").alias("tenant"), F.struct(
        tp.alias("threat_policy"), tier.alias("tier_policy"), content.alias("content_policy"), mcp.alias("mcp_allow"),
        tools.alias("allowed_tools"), (F.col("n_regionkey") != 4).alias("output_review"),
        (F.col("n_nationkey") % 7 == 0).alias("output_redaction")).cast(P.POLICY_TYPE).alias("policy"))


def prompts(spark, sf):
    """Seeded documents with their tenant and its policy; one tenant in 27 has none."""
    docs = seeded(spark, sf).withColumn("tenant", (F.col("doc_id") % 27).cast("int"))
    return salted_join(docs, policies(spark, sf), ["tenant"], salt_on=["doc_id"])


_PROMPTS_SQL = (f"{SEEDED}, {_POLICY_SQL}, prompts AS (SELECT s.doc_id, s.text, CAST(s.doc_id % 27 AS INTEGER) AS tenant, p.* EXCLUDE (tenant), "
                "p.tenant IS NOT NULL AS active FROM seeded s LEFT JOIN policies p ON p.tenant = s.doc_id % 27)")
_EXPLICIT = "NULLIF(CASE threat_id WHEN 39 THEN t39 WHEN 15 THEN t15 WHEN 43 THEN t43 END, '')"
_FULL = (f"COALESCE({_EXPLICIT}, CASE {G.tier_case()} WHEN 'secret' THEN secret WHEN 'pii' THEN pii END, "
         f"CASE WHEN {G.approval()} THEN 'justify' END, 'notify')")
_CONTENT = "COALESCE(CASE rule_id WHEN 'drugs' THEN c_drugs WHEN 'harassment' THEN c_harassment END, 'disabled')"


def _acts(explicit: bool = False, stage: str = "prompt", src: str = "prompts", key: str = "doc_id", **rules) -> str:
    """CTEs ``ta`` (threat findings with action) and ``ca`` (content hits with action), disabled dropped."""
    chain = f"COALESCE({_EXPLICIT}, 'notify')" if explicit else _FULL
    return (f"{G.hits_cte(src, key, stage=stage, **rules)}, {G.findings_cte(key)}, {G.content_cte(src, key)}, "
            f"ta AS (SELECT * FROM (SELECT f.*, p.active, {chain} AS action FROM findings f JOIN {src} p USING ({key})) WHERE action <> 'disabled'), "
            f"ca AS (SELECT * FROM (SELECT c.*, p.active, {_CONTENT} AS action FROM chits c JOIN {src} p USING ({key})) WHERE action <> 'disabled')")


@query("action_by_threat",
       f"WITH {_PROMPTS_SQL}, {G.hits_cte('prompts', 'doc_id')}, {G.findings_cte('doc_id')} SELECT tenant, threat_id, action, explicit_action, "
       f"count(*) AS findings FROM (SELECT p.tenant, f.threat_id, {_FULL} AS action, COALESCE({_EXPLICIT}, 'notify') AS explicit_action "
       "FROM findings f JOIN prompts p USING (doc_id)) GROUP BY ALL")
def action_by_threat(spark, sf):
    rows = S.scan(prompts(spark, sf)).select("tenant", "policy", F.explode_outer("findings.threat_id").alias("threat_id")).where("threat_id IS NOT NULL")
    t, p = F.col("threat_id"), F.col("policy")
    return rows.groupBy("tenant", "threat_id", P.resolve_action(t, p).alias("action"),
                        P.resolve_action(t, p, "explicit").alias("explicit_action")).agg(F.count(F.lit(1)).alias("findings"))


_DECIDE_BODY = (
    "r AS (SELECT doc_id, max(rk) AS rk, count(*) AS n, string_agg(reason, '; ' ORDER BY kind, pos) AS reasons FROM ("
    "SELECT doc_id, 0 AS kind, rank AS pos, CASE action WHEN 'block' THEN 3 WHEN 'justify' THEN 2 ELSE 1 END AS rk, "
    "CASE action WHEN 'block' THEN '#' || threat_id || ' ' || category WHEN 'justify' THEN '#' || threat_id || ' ' || category || ' (needs sign-off)' END AS reason "
    "FROM ta WHERE active UNION ALL SELECT doc_id, 1, ord, CASE action WHEN 'block' THEN 3 WHEN 'justify' THEN 2 ELSE 1 END, "
    "CASE WHEN action = 'block' THEN 'content: ' || label END FROM ca WHERE active) GROUP BY doc_id)")


@query("decide_prompts",
       f"WITH {_PROMPTS_SQL}, {_acts()}, {_DECIDE_BODY} SELECT p.doc_id, p.tenant, CASE r.rk WHEN 3 THEN 'deny' WHEN 2 THEN 'ask' ELSE 'allow' END AS decision, "
       "COALESCE(r.reasons, '') AS reasons, CAST(COALESCE(r.n, 0) AS INTEGER) AS n_reported FROM prompts p LEFT JOIN r USING (doc_id)")
def decide_prompts(spark, sf):
    done = P.decide(prompts(spark, sf))
    return done.select("doc_id", "tenant", "decision", F.array_join("reasons", "; ").alias("reasons"), F.size("reported").alias("n_reported"))


# -- packs of each tenant ------------------------------------------------------------------

# A code name per nation and a rule per region; those of the last two regions are refused or for answers only.
_CODE_NAMES = ("thtion", "attion", "thble", "ering", "thing", "erble", "eriner", "oning", "nicht", "onble")
_REGION_RULES = (("insult!", "16", "prompt", "warn", r"\b(trash|scum|idiot|clown|worthless|moron|pathetic|loser)\b"),
                 ("maillike", "15", "prompt", "coach", r"[\w.+-]+@[\w.-]+"), ("short number", "15", "prompt", "warn", r"\b\d{3}-\d{4}\b"),
                 ("answers", "15", "output", "warn", r"the"), ("refused", "15", "prompt", "warn", r"(a+)+b"))


def tenant_packs(spark, sf):
    """(tenant, pack_no, pack_id, detectors): one pack per nation."""
    n = table(spark, sf, "nation")
    rule = lambda i, t, stage, mode, p: F.struct(
        *(F.lit(v).alias(k) for k, v in (("detectorId", i), ("threatId", t), ("stage", stage), ("mode", mode), ("hint", None))),
        F.array(p).alias("patterns"), F.lit("i").alias("flags"))
    name = F.get(S.literal_array(_CODE_NAMES, "string"), F.col("n_nationkey") % len(_CODE_NAMES))
    own = rule("code name", "39", "prompt", "warn", F.concat(F.lit(r"\b"), name, F.lit(r"s?\b")))
    region = F.get(F.array(*(rule(i, t, s, m, F.lit(p)) for i, t, s, m, p in _REGION_RULES)), F.col("n_regionkey"))
    return n.select(F.col("n_nationkey").cast("int").alias("tenant"), F.lit(0).alias("pack_no"), F.lit("team rules").alias("pack_id"),
                    F.array(own, region).alias("detectors"))


_IN_REGION = "tenant IN (SELECT n_nationkey FROM nation WHERE n_regionkey = {})"
_TENANT_RULES = {
    **{Detector("pack:teamrules:codename", 39, ci(rf"\b{w}s?\b")): f"tenant IN (SELECT n_nationkey FROM nation WHERE n_nationkey % {len(_CODE_NAMES)} = {k})"
       for k, w in enumerate(_CODE_NAMES)},
    Detector("pack:teamrules:insult", 16, ci(_REGION_RULES[0][4])): _IN_REGION.format(0),
    Detector("pack:teamrules:maillike", 15, ci(_REGION_RULES[1][4]), mode="coach"): _IN_REGION.format(1),
    Detector("pack:teamrules:shortnumber", 15, ci(_REGION_RULES[2][4])): _IN_REGION.format(2)}
_WITH_PACKS = {"detectors": (*DETECTORS, *_TENANT_RULES), "only": _TENANT_RULES}


def packed_prompts(spark, sf):
    """Prompts with the pack rules of their tenant, and all rules."""
    rules, owners = PK.compile_tenant_packs(tenant_packs(spark, sf))
    return PK.with_scopes(prompts(spark, sf), owners, salt_on=["doc_id"]), PK.apply_packs(rules)


@query("tenant_pack_findings",
       f"WITH {_PROMPTS_SQL}, {G.hits_cte('prompts', 'doc_id, tenant', **_WITH_PACKS)}, {G.findings_cte('doc_id, tenant')} "
       "SELECT doc_id, tenant, rank, threat_id, detector_id, mode, match, risk_level, risk_score, category FROM findings")
def tenant_pack_findings(spark, sf):
    rows, rules = packed_prompts(spark, sf)
    return S.explode_findings(S.scan(rows, detectors=rules, scopes="scopes"), ["doc_id", "tenant"]).drop("hint")


@query("tenant_pack_decisions",
       f"WITH {_PROMPTS_SQL}, {_acts(**_WITH_PACKS)}, {_DECIDE_BODY} SELECT p.doc_id, p.tenant, CASE r.rk WHEN 3 THEN 'deny' WHEN 2 THEN 'ask' ELSE 'allow' END AS decision, "
       "COALESCE(r.reasons, '') AS reasons, CAST(COALESCE(r.n, 0) AS INTEGER) AS n_reported FROM prompts p LEFT JOIN r USING (doc_id)")
def tenant_pack_decisions(spark, sf):
    rows, rules = packed_prompts(spark, sf)
    done = P.decide(rows, detectors=rules, scopes="scopes")
    return done.select("doc_id", "tenant", "decision", F.array_join("reasons", "; ").alias("reasons"), F.size("reported").alias("n_reported"))


@query("guard_verdicts",
       f"WITH {_PROMPTS_SQL}, {_acts(explicit=True)}, a AS (SELECT doc_id, action FROM ta UNION ALL SELECT doc_id, action FROM ca), "
       "g AS (SELECT doc_id, count(*) AS n, count(*) FILTER (action <> 'alert') AS v, count(*) FILTER (action = 'block') AS b FROM a GROUP BY doc_id) "
       "SELECT p.doc_id, CASE WHEN g.b > 0 THEN 'blocked' WHEN g.v > 0 THEN 'review' ELSE 'clean' END AS verdict, "
       "CAST(COALESCE(g.n, 0) AS INTEGER) AS n_reported, CAST(COALESCE(g.v, 0) AS INTEGER) AS n_visible FROM prompts p LEFT JOIN g USING (doc_id)")
def guard_verdicts(spark, sf):
    return P.guard_verdict(prompts(spark, sf)).select("doc_id", "verdict", "n_reported", "n_visible")


def answers(spark, sf):
    """Documents as AI answers of their tenant."""
    return prompts(spark, sf)


def _review_sql() -> str:
    ctes, last = G.redact_sql("text", "output", src="held")
    return (f"WITH {_PROMPTS_SQL}, seen AS (SELECT * FROM prompts WHERE NOT COALESCE(NOT out_review, false)), "
            f"{G.hits_cte('seen', 'doc_id', stage='output')}, {G.findings_cte('doc_id')}, "
            f"ta AS (SELECT * FROM (SELECT f.doc_id, f.rank, f.threat_id, COALESCE({_EXPLICIT}, 'notify') AS action FROM findings f JOIN seen USING (doc_id)) "
            "WHERE action <> 'disabled'), "
            "fl AS (SELECT doc_id, string_agg(CAST(threat_id AS VARCHAR), ',' ORDER BY rank) AS flagged, bool_or(action IN ('block', 'justify')) AS hold FROM ta GROUP BY doc_id), "
            "m AS (SELECT p.doc_id, p.text, COALESCE(fl.flagged, '') AS flagged, NOT COALESCE(NOT p.out_review, false) AND "
            "(COALESCE(p.out_redact, false) OR COALESCE(fl.hold, false)) AS masked FROM prompts p LEFT JOIN fl USING (doc_id)), "
            f"held AS (SELECT doc_id, text FROM m WHERE masked), {ctes} "
            f"SELECT m.doc_id, m.flagged, m.masked, md5(COALESCE(x.text, m.text)) AS delivered_md5 FROM m LEFT JOIN {last} x USING (doc_id)")


@query("review_answers", _review_sql())
def review_answers(spark, sf):
    done = P.review_output(answers(spark, sf))
    return done.select("doc_id", F.array_join(F.transform("flagged", lambda x: x.cast("string")), ",").alias("flagged"), "masked",
                       F.md5("delivered").alias("delivered_md5"))


@query("content_free_alerts",
       f"WITH {_PROMPTS_SQL}, {_acts()}, {_DECIDE_BODY}, a AS (SELECT doc_id, threat_id, category, risk_level, match FROM ta WHERE active UNION ALL "
       "SELECT doc_id, 0, 'Content: ' || label, CASE WHEN action = 'block' THEN 'Blocked' ELSE 'High' END, match FROM ca WHERE active) "
       "SELECT p.tenant, a.threat_id, a.category, CASE WHEN r.rk = 3 THEN 'Blocked' ELSE a.risk_level END AS risk_level, "
       f"{G.djb2('a.match')} AS content_hash, count(*) AS alerts FROM a JOIN prompts p USING (doc_id) JOIN r USING (doc_id) GROUP BY ALL")
def content_free_alerts(spark, sf):
    done = P.decide(prompts(spark, sf)).select(F.col("tenant").cast("string").alias("tenant"), F.lit("egress").alias("stage"), "decision", "reported")
    rows = A.content_free_alerts(done)
    return rows.groupBy(F.col("tenant").cast("int").alias("tenant"), "threat_id", "category", "risk_level", "content_hash").agg(
        F.count(F.lit(1)).alias("alerts"))


# -- allow-lists --------------------------------------------------------------------------

def tenant_events(spark, sf):
    ev = table(spark, sf, "events").withColumn("tenant", (F.col("user_id") % 27).cast("int"))
    return salted_join(ev, policies(spark, sf), ["tenant"], salt_on=["event_id"])


@query("mcp_server_decisions",
       "WITH e AS (SELECT e.event_type AS server, e.user_id % 27 AS tenant, n.n_regionkey AS r FROM events e LEFT JOIN nation n ON n.n_nationkey = e.user_id % 27) "
       "SELECT CAST(tenant AS INTEGER) AS tenant, server, CASE WHEN r = 0 AND server NOT IN ('view', 'click') OR r = 2 AND server <> 'error' "
       "THEN 'deny' ELSE 'allow' END AS decision, count(*) AS calls FROM e GROUP BY ALL")
def mcp_server_decisions(spark, sf):
    ev = tenant_events(spark, sf)
    return ev.groupBy("tenant", F.col("event_type").alias("server"),
                      P.decide_mcp_server(F.col("event_type"), F.col("policy.mcp_allow")).alias("decision")).agg(F.count(F.lit(1)).alias("calls"))


@query("allowed_tools",
       "WITH e AS (SELECT e.event_type AS tool, e.user_id, e.value, n.n_nationkey AS k FROM events e LEFT JOIN nation n ON n.n_nationkey = e.user_id % 27), "
       "x AS (SELECT tool, CASE WHEN tool = 'view' OR NOT (user_id % 5 <> 0) THEN true "
       "WHEN value > 5 THEN CASE k % 3 WHEN 0 THEN tool IN ('view', 'purchase') WHEN 1 THEN tool = 'click' ELSE true END "
       "ELSE CASE WHEN user_id % 2 = 0 THEN tool IN ('signup', 'click') ELSE false END END AS allowed FROM e) "
       "SELECT tool, allowed, count(*) AS starts FROM x GROUP BY ALL")
def allowed_tools(spark, sf):
    ev = tenant_events(spark, sf)
    cached = F.when(F.col("user_id") % 2 == 0, F.array(F.lit("signup"), F.lit("click")))
    ok = P.allowed_tool(F.col("event_type"), F.col("user_id") % 5 != 0, F.col("value") > 5, F.col("policy.allowed_tools"), cached, always=("view",))
    return ev.groupBy(F.col("event_type").alias("tool"), ok.alias("allowed")).agg(F.count(F.lit(1)).alias("starts"))


@query("allowlist_violations",
       "SELECT event_id, user_id, event_type FROM events e WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT event_type FROM events "
       "GROUP BY event_type HAVING count(*) >= (SELECT avg(c) FROM (SELECT count(*) AS c FROM events GROUP BY event_type))) a WHERE a.event_type = e.event_type)")
def allowlist_violations(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    counts = ev.groupBy("event_type").agg(F.count(F.lit(1)).alias("c"))
    allow = counts.join(counts.agg(F.avg("c").alias("mean")), F.col("c") >= F.col("mean")).select("event_type")
    return P.allowlist_violations(ev, allow, "event_type").select("event_id", "user_id", "event_type")


# -- tool calls -------------------------------------------------------------------------------

_COMMANDS = ("cat doc{0}.txt", "head -n 5 doc{0}.txt extra.txt", "cat doc{0}.txt | wc", "ls doc{0}.txt",
             " tail  -f doc{0}.txt ", "less doc{0}.txt && rm x")


def _command_expr(key: str) -> str:
    return f"CASE {key} % {len(_COMMANDS)} " + " ".join(
        f"WHEN {i} THEN '" + c.replace("{0}", f"' || {key} || '") + "'" for i, c in enumerate(_COMMANDS)) + " END"


_PATHS_SQL = ("CASE WHEN regexp_matches(c, '[|><`$(){}]|&&|\\|\\|') OR NOT regexp_matches(trim(c), '^(?:cat|head|tail|less|bat|xxd|nl|more)\\s+.') THEN [] "
              "ELSE list_filter(string_split_regex(regexp_replace(trim(c), '^\\w+\\s+', ''), '\\s+'), lambda w: w <> '' AND NOT starts_with(w, '-'))[1:8] END")


@query("read_paths",
       f"WITH c AS (SELECT doc_id, {_command_expr('doc_id')} AS c FROM documents) "
       f"SELECT doc_id, array_to_string({_PATHS_SQL}, ',') AS paths FROM c")
def read_paths(spark, sf):
    cmd = F.expr(_command_expr("doc_id"))
    return texts(spark, sf, "documents").select("doc_id", F.array_join(TC.extract_read_paths(cmd), ",").alias("paths"))


_CALL_KIND = "CASE doc_id % 4 WHEN 0 THEN 'Read' WHEN 1 THEN 'Bash' WHEN 2 THEN 'mcp__' || source || '__run' ELSE 'Edit' END"


def tool_calls(spark, sf):
    """Each document gives one call: reading it, printing it, or passing it to a server."""
    docs = prompts(spark, sf).withColumn("tool_name", F.expr(_CALL_KIND))
    body = (F.when(F.col("doc_id") % 4 == 0, F.to_json(F.struct(F.concat(F.lit("doc"), "doc_id", F.lit(".txt")).alias("file_path"))))
            .when(F.col("doc_id") % 4 == 1, F.to_json(F.struct(F.expr(_command_expr("doc_id")).alias("command"))))
            .otherwise(F.to_json(F.struct(F.col("text").alias("arg")))))
    allow = F.array(F.lit("src1"), F.lit("src2"), F.lit("src3"), F.lit("src6"), F.lit("src10"), F.lit("src18"))
    policy = F.when(F.col("policy").isNotNull(), F.col("policy").withField(
        "mcp_allow", F.when(F.col("policy.output_redaction"), F.lit(None).cast("array<string>")).otherwise(allow)))
    calls = docs.select(F.col("doc_id").alias("call_id"), "tool_name", body.alias("tool_input"), policy.alias("policy"))
    files = seeded(spark, sf).select(F.concat(F.lit("doc"), "doc_id", F.lit(".txt")).alias("path"), F.col("text").alias("content"))
    return calls, files


# A server argument is JSON text; escapes for quotes, backslashes and control characters.
_JSON_TEXT = ("'{\"arg\":\"' || replace(replace(replace(replace(replace(text, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t') || '\"}'")
_CALLS_SQL = (
    f"WITH {_PROMPTS_SQL.replace('SELECT s.doc_id, s.text,', 'SELECT s.doc_id, s.text, s.source,')}, "
    f"k AS (SELECT *, {_CALL_KIND} AS tool_name FROM prompts), c AS (SELECT doc_id, {_command_expr('doc_id')} AS c FROM documents), "
    f"bash AS (SELECT doc_id, len({_PATHS_SQL}) > 0 AS reads FROM c), "
    "dn AS (SELECT doc_id, source FROM k WHERE active AND doc_id % 4 = 2 AND NOT out_redact AND source NOT IN ('src1', 'src2', 'src3', 'src6', 'src10', 'src18')), "
    "files AS (SELECT k.* FROM k LEFT JOIN bash USING (doc_id) WHERE active AND (doc_id % 4 = 0 OR (doc_id % 4 = 1 AND reads))), "
    f"args AS (SELECT * REPLACE ({_JSON_TEXT} AS text) FROM k WHERE active AND doc_id % 4 = 2 AND doc_id NOT IN (SELECT doc_id FROM dn)), "
    "scanned AS (SELECT * FROM files UNION ALL SELECT * FROM args), "
    f"{_acts(src='scanned')}, {_DECIDE_BODY} "
    "SELECT k.doc_id AS call_id, k.tool_name, CASE k.doc_id % 4 WHEN 0 THEN 'read' WHEN 1 THEN 'bash' WHEN 2 THEN 'mcp' ELSE 'other' END AS route, "
    "CASE WHEN dn.doc_id IS NOT NULL THEN 'deny' WHEN r.rk = 3 THEN 'deny' WHEN r.rk = 2 THEN 'ask' ELSE 'allow' END AS decision, "
    "CASE WHEN dn.doc_id IS NOT NULL THEN 'MCP server not on the allow-list: ' || dn.source ELSE COALESCE(r.reasons, '') END AS reasons, "
    "CAST(CASE WHEN dn.doc_id IS NOT NULL THEN 1 ELSE COALESCE(r.n, 0) END AS INTEGER) AS findings "
    "FROM k LEFT JOIN dn USING (doc_id) LEFT JOIN r USING (doc_id)")


@query("tool_call_router", _CALLS_SQL)
def tool_call_router(spark, sf):
    done = TC.review_calls(*tool_calls(spark, sf))
    return done.withColumn("reasons", F.array_join("reasons", "; "))


# -- policy in force ------------------------------------------------------------------------------

@query("asof_policy",
       "WITH v AS (SELECT user_id % 10 AS tenant, ts AS valid_from, event_id AS version FROM events WHERE event_type = 'signup'), "
       "e AS (SELECT event_id, user_id % 10 AS tenant, ts FROM events) "
       "SELECT e.event_id, e.tenant, v.version FROM e ASOF LEFT JOIN v ON e.tenant = v.tenant AND e.ts >= v.valid_from")
def asof_policy(spark, sf):
    ev = table(spark, sf, "events").withColumn("tenant", F.col("user_id") % 10)
    versions = ev.where("event_type = 'signup'").select("tenant", F.col("ts").alias("valid_from"), F.col("event_id").alias("policy"))
    return asof_join(ev.select("event_id", "tenant", "ts"), versions, "tenant", bucket_seconds=86400).select(
        "event_id", "tenant", F.col("policy").alias("version"))
