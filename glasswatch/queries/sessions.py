"""Session review over conversations, with example phrases appended to user turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from glasswatch.operators import scan as S
from glasswatch.operators import sessions as SE
from glasswatch.operators.output_lines import reassemble
from glasswatch.queries import query, sqlgen as G, table, texts
from glasswatch.queries.samples import SESSION_PHRASES
from glasswatch.rules.catalog import THREATS
from glasswatch.rules.detectors import DETECTORS

_N = len(SESSION_PHRASES)


def turns(spark, sf):
    """User turns; every seventh phrase is blank and blanks the turn."""
    phrases = S.literal_array(SESSION_PHRASES, "string")
    phrase = F.get(phrases, ((F.col("conv_id") * 3 + F.col("turn")) % _N).cast("int"))
    return texts(spark, sf, "conversations").where("role = 'user'").select(
        "conv_id", "turn", F.when(phrase == SESSION_PHRASES[5], phrase).otherwise(F.concat(phrase, F.lit(" "), "text")).alias("text"))


_TURNS = ("turns AS (SELECT conv_id, turn, CASE WHEN p = '   ' THEN p ELSE p || ' ' || text END AS text FROM (SELECT *, (["
          + ", ".join(G.q(p) for p in SESSION_PHRASES) + f"])[(conv_id * 3 + turn) % {_N} + 1] AS p FROM conversations WHERE role = 'user'))")
_INJ = SE.injection_detectors(DETECTORS)
_SESSION = SE.session_detectors(DETECTORS)
_FLAG = "(" + " OR ".join(G.present("text", p) for d in _INJ for p in d.patterns) + ")"


def _joined(window: int) -> str:
    w = f"(PARTITION BY conv_id ORDER BY turn ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)"
    return (f"{_TURNS}, nb AS (SELECT *, CAST({_FLAG} AS INTEGER) AS flag FROM turns WHERE NOT {G.blank('text')}), "
            f"win AS (SELECT conv_id, turn, count(*) OVER {w} AS n_turns, sum(flag) OVER {w} AS flagged, "
            f"string_agg(text, chr(10)) OVER {w} AS text FROM nb), w2 AS (SELECT * FROM win WHERE n_turns >= 2)")


def _hits() -> str:
    """Session detectors as if prompt staged, plus persistence as the last warn."""
    as_prompt = [d.__class__(d.detector_id, d.threat_id, d.patterns, mode=d.mode) for d in _SESSION]
    t3 = next(t for t in THREATS if t.threat_id == 3)
    return (G.hits_cte("w2", "conv_id, turn", detectors=as_prompt, name="hd")
            + f", hits AS (SELECT * FROM hd UNION ALL SELECT conv_id, turn, {len(_SESSION)}, 3, 'inj-persistent', 'warn', "
              f"'{t3.risk_level}', 4, {t3.risk_score}, '{t3.category}', CAST(flagged AS VARCHAR) || ' turns' FROM w2 WHERE flagged >= 2)")


def _session_sql(window: int, last: bool = False) -> str:
    only = " JOIN (SELECT conv_id, max(turn) AS turn FROM nb GROUP BY conv_id) z USING (conv_id, turn)" if last else ""
    return (f"WITH {_joined(window)}, {_hits()}, {G.findings_cte('conv_id, turn')} SELECT f.conv_id, f.turn, f.rank, f.threat_id, "
            f"f.detector_id, f.match FROM findings f{only}")


def _rows(df):
    return df.select("conv_id", "turn", F.posexplode_outer("findings").alias("p", "f")).where("p IS NOT NULL").select(
        "conv_id", "turn", (F.col("p") + 1).alias("rank"), "f.threat_id", "f.detector_id", "f.match")


@query("session_window_6", _session_sql(6))
def session_window_6(spark, sf):
    return _rows(SE.scan_session(turns(spark, sf)))


@query("session_window_2", _session_sql(2))
def session_window_2(spark, sf):
    return _rows(SE.scan_session(turns(spark, sf), window=2, block=4))


@query("session_last_state", _session_sql(6, last=True))
def session_last_state(spark, sf):
    return _rows(SE.scan_session(turns(spark, sf), mode="last"))


@query("injection_persistence",
       f"WITH {_joined(6)} SELECT conv_id, turn, CAST(n_turns AS INTEGER) AS n_turns, CAST(flagged AS BIGINT) AS flagged_turns FROM win")
def injection_persistence(spark, sf):
    return SE.scan_session(turns(spark, sf)).select("conv_id", "turn", "n_turns", "flagged_turns")


@query("context_mixing",
       "WITH f AS (SELECT user_id, arg_min(event_type, struct_pack(t := ts, v := event_type)) AS tag FROM events GROUP BY user_id) SELECT e.event_id, e.user_id, f.tag AS session_tag, "
       "e.event_type <> f.tag AS foreign_tag FROM events e JOIN f USING (user_id)")
def context_mixing(spark, sf):
    return SE.foreign_context(table(spark, sf, "events"), "user_id", "ts", "event_type").select(
        "event_id", "user_id", "session_tag", "foreign_tag")


# -- output chunks ----------------------------------------------------------------------------

_WIDTH = 40


def chunks(spark, sf):
    """Assistant text cut into fixed-width chunks, one stream per conversation."""
    t = texts(spark, sf, "conversations").where("role = 'assistant'").withColumn(
        "text", F.concat(F.lit("\u001b[1m"), "text", F.lit("\u001b[0m\n")))
    at = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / _WIDTH).cast("int"))
    return t.select(F.col("conv_id").alias("session_id"), "turn", "text", F.explode(at).alias("i")).select(
        "session_id", (F.col("turn") * 1_000_000_000 + F.col("i")).alias("seq"),
        F.substr("text", F.col("i") * _WIDTH + 1, F.lit(_WIDTH)).alias("chunk"))


_CHUNKS = (
    "c AS (SELECT conv_id AS session_id, turn * 1000000000 + i AS seq, substr(text, i * 40 + 1, 40) AS chunk FROM (SELECT conv_id, turn, text, "
    "unnest(range(0, CAST(floor((length(text) - 1) / 40) AS BIGINT) + 1)) AS i FROM (SELECT conv_id, turn, chr(27) || '[1m' || text || chr(27) || '[0m' || chr(10) AS text "
    "FROM conversations WHERE role = 'assistant')))")


@query("output_lines",
       f"WITH {_CHUNKS}, n AS (SELECT *, contains(chunk, chr(10)) AS nl, sum(CAST(contains(chunk, chr(10)) AS INTEGER)) OVER (PARTITION BY session_id ORDER BY seq) AS k FROM c), "
       "l AS (SELECT *, length(chunk) - strpos(reverse(chunk), chr(10)) AS cut FROM n), "
       "p AS (SELECT session_id, k - 1 AS unit, seq, substr(chunk, 1, cut) AS part, true AS closes FROM l WHERE nl UNION ALL "
       "SELECT session_id, k, seq, substr(chunk, cut + 2), false FROM l WHERE nl UNION ALL SELECT session_id, k, seq, chunk, false FROM l WHERE NOT nl), "
       "u AS (SELECT session_id, unit, regexp_replace(string_agg(part, '' ORDER BY seq), '[\\x{1b}\\x{9b}][\\[\\]()#;?]*(?:[0-9]{1,4}(?:;[0-9]{0,4})*)?[0-9A-ORZcf-nqry=><]', '', 'g') AS text "
       "FROM p GROUP BY session_id, unit HAVING bool_or(closes)) "
       f"SELECT session_id, CAST(unit AS BIGINT) AS unit, md5(text) AS text_md5 FROM u WHERE NOT {G.blank('text')}")
def output_lines(spark, sf):
    return reassemble(chunks(spark, sf)).select("session_id", "unit", F.md5("text").alias("text_md5"))
