import pytest
from pyspark.sql import functions as F

from glasswatch.sources import sinks
from glasswatch.streaming import alerts as SA
from glasswatch.streaming import state as ST
from glasswatch.operators import sessions as SE
from tests import model
from tests.test_operators import conversations


def stream(spark, df, path, files=3):
    df.repartition(files).write.mode("overwrite").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(df, tmp_path, name):
    q = df.writeStream.format("parquet").option("path", str(tmp_path / name)).option(
        "checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(str(tmp_path / name))


def test_sessions_over_batches_equal_batch(spark, tmp_path):
    rows = conversations(6)
    df = spark.createDataFrame(rows, "conv_id int, turn int, text string")
    src = str(tmp_path / "turns")
    for k in range(3):   # turns arrive in order, over several files
        df.where((F.col("turn") >= 150 * k) & (F.col("turn") < 150 * (k + 1))).coalesce(1).write.mode("append").parquet(src)
    live = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = run(ST.session_stream(live).select("conv_id", "turn", "n_turns", "findings"), tmp_path, "out")
    show = lambda d: {(r.conv_id, r.turn): (r.n_turns, [(f.threat_id, f.detector_id, f.match) for f in r.findings]) for r in d.collect()}
    assert show(got) == show(SE.scan_session(df))


def test_line_buffer_keeps_state_and_limit(spark, tmp_path):
    chunks = ["a" * 5000, "b" * 5000, "c\nd", "e\n", "tail"]
    df = spark.createDataFrame([("s", i, c) for i, c in enumerate(chunks)], "session_id string, seq int, chunk string")
    src = str(tmp_path / "chunks")
    for i in range(len(chunks)):
        df.where(F.col("seq") == i).coalesce(1).write.mode("append").parquet(src)
    live = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = [r.text for r in run(ST.line_stream(live), tmp_path, "out").orderBy("unit").collect()]
    # A buffer over the limit is reviewed whole before its tail is carried on.
    assert got[0] == chunks[0] + chunks[1] and got[1:] == model.lines(chunks) and len(got[1]) == 4097


def test_alert_windows_late_and_audit(spark, tmp_path):
    ts = F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 600)
    al = spark.range(60).select(ts.alias("ts"), F.lit("d").alias("device"), (F.col("id") % 2).cast("int").alias("threat_id"))
    live = stream(spark, al, str(tmp_path / "al"), 1)
    closed = run(SA.alert_counts(live, ["threat_id"]), tmp_path, "counts")
    full = SA.alert_counts(al, ["threat_id"])
    assert closed.exceptAll(full).count() == 0 and closed.count() > 0
    late = SA.late_rows(al, closed, ["threat_id"])
    assert closed.agg(F.sum("alerts")).first()[0] + late.agg(F.sum("late")).first()[0] == 60
    q = sinks.stream_audit(live, str(tmp_path / "audit"), str(tmp_path / "audit-state"))
    q.awaitTermination()
    assert spark.read.json(str(tmp_path / "audit")).count() == 60
    assert SA.alert_sessions(al, ["device"], "5 minutes").count() == 60 and SA.alert_sessions(al, ["device"], "20 minutes").count() == 1


def test_policy_refresh_keeps_last_good(spark, tmp_path):
    ev = spark.range(4).select(F.lit("t").alias("tenant"), "id")
    live = stream(spark, ev, str(tmp_path / "ev"), 2)
    calls, seen, source = [], [], tmp_path / "policies.json"
    source.write_text('{"tenant": "t", "policy": "block"}')

    def load():
        calls.append(1)
        if len(calls) > 1:
            source.unlink(missing_ok=True)  # gone, also for whoever would read it again
            raise OSError("unreachable")
        return spark.read.schema("tenant string, policy string").json(str(source))

    q = SA.with_policy_refresh(live, load, lambda b, i: seen.extend(r.policy for r in b.collect()), str(tmp_path / "state"))
    q.awaitTermination()
    assert seen == ["block"] * 4 and len(calls) >= 2
    with pytest.raises(Exception):
        SA.with_policy_refresh(live, lambda: 1 / 0, lambda b, i: None, str(tmp_path / "state2")).awaitTermination()
