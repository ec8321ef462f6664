"""Fleet views over alerts derived from the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from glasswatch.operators import fleet as FL
from glasswatch.operators import posture as PO
from glasswatch.functions.text import version_outdated
from glasswatch.queries import query, table
from glasswatch.streaming import alerts as SA

_THREAT = "CASE event_type WHEN 'error' THEN 39 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 15 WHEN 'click' THEN 3 END"
_CAT = "CASE event_type WHEN 'error' THEN 'Credentials' WHEN 'purchase' THEN 'Data leakage' WHEN 'signup' THEN 'Privacy' ELSE 'Prompt attacks' END"
_RISK = "CASE WHEN value > 50 THEN 'Blocked' WHEN value > 20 THEN 'Critical' WHEN value > 8 THEN 'High' ELSE 'Medium' END"
_ACTION = "CASE event_id % 6 WHEN 0 THEN 'blocked' WHEN 1 THEN 'alert' WHEN 2 THEN 'notify' WHEN 3 THEN 'justify' WHEN 4 THEN 'redacted' ELSE 'override' END"
_ALERTS = (f"al AS (SELECT event_id, ts, user_id AS device, user_id % 7 AS tenant, {_THREAT} AS threat_id, {_CAT} AS category, {_RISK} AS risk_level, "
           f"{_ACTION} AS action, CASE WHEN value > 20 THEN 'blocked' ELSE 'sent' END AS outcome, event_id % 3 AS findings FROM events)")
_TS = "strftime({0}, '%Y-%m-%d %H:%M:%S')"


def alerts(spark, sf):
    e = F.expr
    return table(spark, sf, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("device"), (F.col("user_id") % 7).alias("tenant"),
        e(_THREAT).alias("threat_id"), e(_CAT).alias("category"), e(_RISK).alias("risk_level"), e(_ACTION).alias("action"),
        F.when(F.col("value") > 20, "blocked").otherwise("sent").alias("outcome"), (F.col("event_id") % 3).alias("findings"))


def _stamp(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    return df


@query("fleet_rollup", f"WITH {_ALERTS} SELECT category, risk_level, count(*) AS alerts, CAST(grouping_id(category, risk_level) AS INTEGER) AS level "
                       "FROM al GROUP BY ROLLUP (category, risk_level)")
def fleet_rollup(spark, sf):
    return FL.risk_rollup(alerts(spark, sf))


@query("fleet_cube", f"WITH {_ALERTS} SELECT tenant, risk_level, count(*) AS alerts, CAST(grouping_id(tenant, risk_level) AS INTEGER) AS level "
                     "FROM al GROUP BY CUBE (tenant, risk_level)")
def fleet_cube(spark, sf):
    return FL.risk_cube(alerts(spark, sf), ["tenant", "risk_level"])


@query("fleet_grouping_sets", f"WITH {_ALERTS} SELECT threat_id, category, device, count(*) AS alerts, CAST(grouping_id(threat_id, category, device) AS INTEGER) AS level "
                              "FROM al GROUP BY GROUPING SETS ((threat_id), (category), (device))")
def fleet_grouping_sets(spark, sf):
    return FL.risk_sets(alerts(spark, sf), [["threat_id"], ["category"], ["device"]])


@query("fleet_trend", f"WITH {_ALERTS} SELECT {_TS.format('time_bucket(INTERVAL 1 DAY, ts)')} AS window_start, risk_level, count(*) AS alerts FROM al GROUP BY ALL")
def fleet_trend(spark, sf):
    return _stamp(FL.risk_trend(alerts(spark, sf)), "window_start")


@query("prompt_outcomes", f"WITH {_ALERTS} SELECT tenant, {_TS.format('time_bucket(INTERVAL 1 DAY, ts)')} AS window_start, count(*) FILTER (outcome = 'sent') AS sent, "
                          "count(*) FILTER (outcome = 'blocked') AS blocked, CAST(sum(findings) AS BIGINT) AS findings, count(*) AS prompts FROM al GROUP BY ALL")
def prompt_outcomes(spark, sf):
    return _stamp(FL.prompt_outcomes(alerts(spark, sf), ["tenant"]), "window_start")


@query("detection_log", f"WITH {_ALERTS}, k AS (SELECT event_id, device, action, threat_id, row_number() OVER (PARTITION BY device ORDER BY ts DESC, event_id DESC) AS position "
                        "FROM al WHERE threat_id IS NOT NULL OR action = 'override') SELECT event_id, device, action, threat_id, CAST(position AS INTEGER) AS position FROM k WHERE position <= 20")
def detection_log(spark, sf):
    log = FL.detection_log(alerts(spark, sf), ["device"], [F.col("ts").desc(), F.col("event_id").desc()], 20)
    return log.select("event_id", "device", "action", "threat_id", "position")


@query("audit_action_counts", f"WITH {_ALERTS}, c AS (SELECT tenant, " + ", ".join(f"count(*) FILTER (action = '{a}') AS \"{a}\"" for a in FL.AUDIT_ACTIONS)
       + " FROM al GROUP BY tenant) SELECT *, CASE WHEN \"override\" + blocked > 0 THEN round(\"override\" / CAST(\"override\" + blocked AS DOUBLE), 6) END AS override_rate FROM c")
def audit_action_counts(spark, sf):
    return FL.audit_action_counts(alerts(spark, sf), ["tenant"]).withColumn("override_rate", F.round("override_rate", 6))


@query("alert_windows_tumbling", f"WITH {_ALERTS} SELECT {_TS.format('time_bucket(INTERVAL 1 HOUR, ts)')} AS window_start, {_TS.format('time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR')} AS window_end, "
                                 "risk_level, count(*) AS alerts FROM al GROUP BY ALL")
def alert_windows_tumbling(spark, sf):
    return _stamp(SA.alert_counts(alerts(spark, sf), ["risk_level"]), "window_start", "window_end")


@query("alert_windows_sliding", f"WITH {_ALERTS}, w AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE * i AS s, category FROM al, range(0, 2) r(i)) "
                                f"SELECT {_TS.format('s')} AS window_start, {_TS.format('s + INTERVAL 1 HOUR')} AS window_end, category, count(*) AS alerts FROM w GROUP BY ALL")
def alert_windows_sliding(spark, sf):
    return _stamp(SA.alert_counts(alerts(spark, sf), ["category"], "1 hour", "30 minutes"), "window_start", "window_end")


@query("alert_sessions", f"WITH {_ALERTS}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY device ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM al), "
                         "n AS (SELECT *, sum(fresh) OVER (PARTITION BY device ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) "
                         f"SELECT device, {_TS.format('min(ts)')} AS window_start, {_TS.format('max(ts) + INTERVAL 2 HOUR')} AS window_end, count(*) AS alerts FROM n GROUP BY device, k")
def alert_sessions(spark, sf):
    return _stamp(SA.alert_sessions(alerts(spark, sf), ["device"], "2 hours"), "window_start", "window_end")


@query("alerts_deduplicated", f"WITH {_ALERTS}, d AS (SELECT * FROM al UNION ALL SELECT * FROM al WHERE outcome = 'sent') "
                              "SELECT risk_level, count(*) AS alerts FROM (SELECT DISTINCT device, threat_id, ts, risk_level FROM d) GROUP BY ALL")
def alerts_deduplicated(spark, sf):
    al = alerts(spark, sf)
    again = al.unionByName(al.where("outcome = 'sent'"))
    return SA.deduplicate(again, ["device", "threat_id", "ts", "risk_level"]).groupBy("risk_level").agg(F.count(F.lit(1)).alias("alerts"))


@query("late_alerts", f"WITH {_ALERTS}, f AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, risk_level, count(*) AS n, count(*) FILTER (event_id % 9 <> 0) AS seen FROM al GROUP BY ALL) "
                      f"SELECT {_TS.format('w')} AS window_start, risk_level, n - seen AS late FROM f WHERE n > seen")
def late_alerts(spark, sf):
    al = alerts(spark, sf)
    emitted = SA.alert_counts(al.where("event_id % 9 <> 0"), ["risk_level"])   # a stream that missed some
    return _stamp(SA.late_rows(al, emitted, ["risk_level"]), "window_start")


# -- posture -------------------------------------------------------------------------------------

_REPORT = ("rep AS (SELECT user_id AS device, ts, CASE WHEN event_type = 'view' THEN 'os' || (event_id % 3) END AS os, "
           "CASE WHEN event_type IN ('view', 'click') THEN (event_id % 4) || '.' || (event_id % 11) || CASE WHEN event_id % 5 = 0 THEN '' ELSE '.x' END END AS app_version, "
           "CASE WHEN event_type = 'error' THEN CAST(event_id % 70000 AS INTEGER) * 7 END AS av_state FROM events)")


def reports(spark, sf):
    e = F.expr
    return table(spark, sf, "events").select(
        F.col("user_id").alias("device"), F.col("ts").cast("timestamp").alias("ts"),
        e("CASE WHEN event_type = 'view' THEN concat('os', event_id % 3) END").alias("os"),
        e("CASE WHEN event_type IN ('view', 'click') THEN concat(event_id % 4, '.', event_id % 11, CASE WHEN event_id % 5 = 0 THEN '' ELSE '.x' END) END").alias("app_version"),
        e("CASE WHEN event_type = 'error' THEN CAST(event_id % 70000 AS INT) * 7 END").alias("av_state"))


@query("latest_device_state", f"WITH {_REPORT} SELECT device, {_TS.format('max(ts)')} AS ts, arg_max(os, struct_pack(t := ts, v := os)) FILTER (os IS NOT NULL) AS os, "
                              "arg_max(app_version, struct_pack(t := ts, v := app_version)) FILTER (app_version IS NOT NULL) AS app_version, arg_max(av_state, struct_pack(t := ts, v := av_state)) FILTER (av_state IS NOT NULL) AS av_state FROM rep GROUP BY device")
def latest_device_state(spark, sf):
    return _stamp(PO.latest_device_state(reports(spark, sf)), "ts")


@query("av_flags", f"WITH {_REPORT} SELECT ((av_state >> 8) & 255) IN (16, 17) AS enabled, (av_state & 255) = 0 AS up_to_date, count(*) AS reports FROM rep WHERE av_state IS NOT NULL GROUP BY ALL")
def av_flags(spark, sf):
    r = reports(spark, sf).where("av_state IS NOT NULL").select(PO.av_flags(F.col("av_state")).alias("a")).select("a.*")
    return r.groupBy("enabled", "up_to_date").agg(F.count(F.lit(1)).alias("reports"))


_PART = lambda i: f"COALESCE(TRY_CAST(split_part(app_version, '.', {i}) AS DOUBLE), 0)"


@query("version_outdated", f"WITH {_REPORT} SELECT app_version, ([{_PART(1)}, {_PART(2)}, {_PART(3)}] < [2, 5, 0]) AS outdated, count(*) AS reports "
                           "FROM rep WHERE app_version IS NOT NULL GROUP BY ALL")
def outdated(spark, sf):
    r = reports(spark, sf).where("app_version IS NOT NULL")
    return r.groupBy("app_version", version_outdated(F.col("app_version"), F.lit("2.5")).alias("outdated")).agg(F.count(F.lit(1)).alias("reports"))


_FLAGS = {"firewall_domain": "CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END", "reboot_a": "event_id % 13 = 0", "reboot_b": "CASE WHEN event_id % 2 = 0 THEN event_id % 10 = 0 END",
          "volume_c": "CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 2 END"}


@query("posture_flags", "WITH p AS (SELECT user_id AS device, " + ", ".join(f"{v} AS {k}" for k, v in _FLAGS.items()) + " FROM events) "
       "SELECT device, count(*) FILTER (firewall_domain = 1) AS firewall_on, count(*) FILTER (firewall_domain IS NULL) AS firewall_unknown, "
       "count(*) FILTER (reboot_a OR COALESCE(reboot_b, false)) AS reboot_pending, count(*) FILTER (volume_c = 1) AS encrypted, "
       "count(*) FILTER (volume_c IS NOT NULL AND volume_c <> 1) AS unencrypted FROM p GROUP BY device")
def posture_flags(spark, sf):
    p = table(spark, sf, "events").select(F.col("user_id").alias("device"), *[F.expr(v).alias(k) for k, v in _FLAGS.items()])
    none = F.lit(None).cast("int")
    s = p.select("device", PO.firewall_flags(F.col("firewall_domain"), none, none).alias("fw"),
                 PO.reboot_pending(F.col("reboot_a"), F.col("reboot_b")).alias("reboot"),
                 F.get(PO.volumes_protected(F.array(F.struct(F.lit("C:").alias("drive"), F.col("volume_c").alias("status")))), F.lit(0))["protected"].alias("enc"))
    return s.groupBy("device").agg(
        F.count_if("fw.domain").alias("firewall_on"), F.count_if(F.col("fw.domain").isNull()).alias("firewall_unknown"),
        F.count_if("reboot").alias("reboot_pending"), F.count_if("enc").alias("encrypted"), F.count_if(~F.col("enc")).alias("unencrypted"))


@query("patch_status", "WITH p AS (SELECT o_orderkey AS device, CASE o_orderkey % 4 WHEN 0 THEN 'Software Update Tool' || chr(10) || 'No new software available.' "
       "WHEN 1 THEN '* Label: A' || chr(10) || '    Title: ' || o_orderpriority || ', ' || chr(10) || '  Title: second,' WHEN 2 THEN '* Label: only' || chr(10) || ' * Label: two' ELSE 'nothing' END AS t FROM orders) "
       "SELECT device, (device % 4) IN (0, 3) AS up_to_date, CAST(CASE device % 4 WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE 0 END AS INTEGER) AS count, "
       "CASE WHEN device % 4 = 1 THEN regexp_extract(t, 'Title: ([^,]*),', 1) || '|second' ELSE '' END AS titles FROM p")
def patch_status(spark, sf):
    n = F.lit("\n")
    text = (F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("Software Update Tool"), n, F.lit("No new software available.")))
            .when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("* Label: A"), n, F.lit("    Title: "), "o_orderpriority", F.lit(", "), n, F.lit("  Title: second,")))
            .when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("* Label: only"), n, F.lit(" * Label: two"))).otherwise(F.lit("nothing")))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("device"), PO.patch_status(text).alias("p")).select(
        "device", "p.up_to_date", "p.count", F.array_join("p.titles", "|").alias("titles"))
