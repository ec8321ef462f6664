"""Structured Streaming runs over the tables; each must equal its batch twin."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glasswatch.operators import scan as S
from glasswatch.operators.policy import decide
from glasswatch.plans.interval import interval_join
from glasswatch.queries import SQL, query, table
from glasswatch.queries import detection, fleet, policy, sessions
from glasswatch.queries.samples import PHRASES
from glasswatch.sources import sinks
from glasswatch.streaming import alerts as SA
from glasswatch.streaming import state as ST


def work_folder(spark: SparkSession) -> str:
    """A new folder in the cluster's shared checkpoint space.  Only a local session, whose tasks all run here, may do
    without one; on a cluster executors would write to their own disks."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    if base:
        return f"{base.rstrip('/')}/glasswatch-{uuid.uuid4().hex}"
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("streams need shared storage: set spark.checkpoint.dir")
    return tempfile.mkdtemp(prefix="glasswatch-")


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a table is stored as a folder of files, on any file system that Spark reads.  A missing one raises."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


def source(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as a stream: the files of its folder, or the one file that it is."""
    path = f"{sf.rstrip('/')}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if is_folder(spark, path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def drain(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over what is there now and read back what it wrote."""
    run = stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out") \
        .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


@query("stream_scan_prompts", SQL["scan_seeded_prompts"])
def stream_scan(spark, sf):
    docs = source(spark, sf, "documents")
    text = F.concat("text", F.lit("\n"), F.get(S.literal_array(PHRASES, "string"), (F.col("doc_id") % len(PHRASES)).cast("int")))
    rows = S.scan_rows(docs.select("doc_id", text.alias("text")), ["doc_id"]).select("doc_id", *detection._FIELDS)
    return drain(rows, work_folder(spark))


@query("stream_decisions", SQL["decide_prompts"])
def stream_decisions(spark, sf):
    docs = source(spark, sf, "documents")
    text = F.concat("text", F.lit("\n"), F.get(S.literal_array(PHRASES, "string"), (F.col("doc_id") % len(PHRASES)).cast("int")))
    calls = docs.select("doc_id", text.alias("text"), (F.col("doc_id") % 27).cast("int").alias("tenant"))
    done = decide(calls.join(policy.policies(spark, sf), "tenant", "left"))
    return drain(done.select("doc_id", "tenant", "decision", F.array_join("reasons", "; ").alias("reasons"),
                             F.size("reported").alias("n_reported")), work_folder(spark))


def _turn_stream(spark, sf):
    phrases = S.literal_array(sessions.SESSION_PHRASES, "string")
    n = len(sessions.SESSION_PHRASES)
    phrase = F.get(phrases, ((F.col("conv_id") * 3 + F.col("turn")) % n).cast("int"))
    return source(spark, sf, "conversations").where("role = 'user'").select(
        "conv_id", "turn", F.when(phrase == sessions.SESSION_PHRASES[5], phrase).otherwise(
            F.concat(phrase, F.lit(" "), "text")).alias("text"))


@query("stream_sessions", SQL["session_window_6"])
def stream_sessions(spark, sf):
    return drain(sessions._rows(ST.session_stream(_turn_stream(spark, sf))), work_folder(spark))


@query("stream_output_lines", SQL["output_lines"])
def stream_output_lines(spark, sf):
    w = sessions._WIDTH
    t = source(spark, sf, "conversations").where("role = 'assistant'").withColumn(
        "text", F.concat(F.lit("\u001b[1m"), "text", F.lit("\u001b[0m\n")))
    at = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / w).cast("int"))
    chunks = t.select(F.col("conv_id").alias("session_id"), "turn", "text", F.explode(at).alias("i")).select(
        "session_id", (F.col("turn") * 1_000_000_000 + F.col("i")).alias("seq"), F.substr("text", F.col("i") * w + 1, F.lit(w)).alias("chunk"))
    return drain(ST.line_stream(chunks).select("session_id", "unit", F.md5("text").alias("text_md5")), work_folder(spark))


def _alert_stream(spark, sf):
    e = F.expr
    return source(spark, sf, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("device"),
        e(fleet._THREAT).alias("threat_id"), e(fleet._RISK).alias("risk_level"))


@query("stream_alert_counts", SQL["alert_windows_tumbling"])
def stream_alert_counts(spark, sf):
    """Hourly windows: those that the stream has closed, and what a batch over the same table finds beyond them (windows
    still open at the end, rows that came too late)."""
    closed = drain(SA.alert_counts(_alert_stream(spark, sf), ["risk_level"]), work_folder(spark))
    rest = SA.late_rows(fleet.alerts(spark, sf), closed, ["risk_level"]).select(
        "window_start", (F.col("window_start") + F.expr("INTERVAL 1 HOUR")).alias("window_end"), "risk_level", F.col("late").alias("alerts"))
    whole = closed.unionByName(rest).groupBy("window_start", "window_end", "risk_level").agg(F.sum("alerts").alias("alerts"))
    return fleet._stamp(whole, "window_start", "window_end")


@query("stream_alerts_deduplicated",
       f"WITH {fleet._ALERTS} SELECT risk_level, count(*) AS alerts FROM (SELECT DISTINCT device, threat_id, ts, risk_level FROM al) GROUP BY ALL")
def stream_alerts_deduplicated(spark, sf):
    al = _alert_stream(spark, sf)
    twice = al.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    once = SA.deduplicate(twice, ["device", "threat_id", "ts", "risk_level"])
    return drain(once.select("device", "risk_level"), work_folder(spark)).groupBy("risk_level").agg(F.count(F.lit(1)).alias("alerts"))


_WITHIN = 7200
_PRIOR = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"
_NEAR_SQL = f"""SELECT a.event_id, a.user_id AS device, {fleet._THREAT.replace("event_type", "a.event_type")} AS threat_id, p.event_id AS prior_event_id,
       {_PRIOR.format("a.ts")} AS ts, {_PRIOR.format("p.ts")} AS prior_ts
FROM events a JOIN events p ON a.user_id = p.user_id AND p.ts <= a.ts AND p.ts >= a.ts - INTERVAL {_WITHIN} SECOND
WHERE a.event_type <> 'view' AND p.event_type = 'view'"""


def _near(events):
    """Alerts, and the prompts (events that raise none) of the same device in the two hours before each."""
    timed = events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("device"),
                          F.expr(fleet._THREAT).alias("threat_id"), "event_type")
    found = interval_join(timed.where("event_type <> 'view'").drop("event_type"), timed.where("event_type = 'view'").select("event_id", "ts", "device"),
                          "device", _WITHIN)
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return found.select("event_id", "device", "threat_id", "prior_event_id", stamp("ts"), stamp("prior_ts"))


@query("alerts_after_prompts", _NEAR_SQL)
def alerts_after_prompts(spark, sf):
    return _near(table(spark, sf, "events"))


@query("stream_alerts_after_prompts", _NEAR_SQL)
def stream_alerts_after_prompts(spark, sf):
    return drain(_near(source(spark, sf, "events")), work_folder(spark))


@query("stream_alert_sink", f"WITH {fleet._ALERTS} SELECT event_id, device, threat_id, risk_level, {_PRIOR.format('ts')} AS ts FROM al")
def stream_alert_sink(spark, sf):
    """Alerts written batch by batch, twice: the second run has lost its checkpoint and replays every batch, which adds nothing."""
    al, folder = _alert_stream(spark, sf), work_folder(spark)
    for attempt in ("first", "replay"):
        sinks.stream_once(al, f"{folder}/alerts", f"{folder}/{attempt}").awaitTermination()
    return sinks.read_batches(spark, f"{folder}/alerts", al.schema).select(
        "event_id", "device", "threat_id", "risk_level", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


@query("stream_audit_log", f"SELECT event_id, user_id AS actor, event_type AS action, {_PRIOR.format('ts')} AS at FROM events")
def stream_audit_log(spark, sf):
    """Events as append-only audit lines, read back; a restart from the same checkpoint appends nothing."""
    entries = source(spark, sf, "events").select("event_id", F.col("user_id").alias("actor"), F.col("event_type").alias("action"),
                                                 F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"))
    folder = work_folder(spark)
    for _ in range(2):
        sinks.stream_audit(entries, f"{folder}/audit", f"{folder}/state").awaitTermination()
    return spark.read.schema(entries.schema).json(f"{folder}/audit")
