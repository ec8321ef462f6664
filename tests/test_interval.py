import datetime
import random

import pytest
from pyspark.sql import functions as F

from glasswatch.plans.interval import interval_join
from glasswatch.sources import sinks

START = datetime.datetime(2024, 1, 1)
SCHEMA = "id int, device string, ts timestamp, prior_id string"


def made(n, seed, hot=0.4):
    """Rows in order of time; one device holds a third and more of them, some times repeat or are missing."""
    rng = random.Random(seed)
    out = [(i, None if rng.random() < 0.05 else "hot" if rng.random() < hot else rng.choice("abc"),
            None if rng.random() < 0.05 else START + datetime.timedelta(seconds=rng.randint(0, 30) + 10 * i), "x") for i in range(n)]
    return out + out[:2]


def brute(left, right, within):
    return sorted((a[0], b[0]) for a in left for b in right if a[1] is not None and a[1] == b[1] and a[2] and b[2]
                  and datetime.timedelta(0) <= a[2] - b[2] <= datetime.timedelta(seconds=within))


def shown(df):
    return sorted((r.id, r.prior_id_) for r in df.select("id", F.col("near_id").alias("prior_id_")).collect())


@pytest.mark.parametrize("within", [1, 60, 100_000])
def test_tables(spark, within):
    left, right = made(150, 1), made(120, 2)
    got = interval_join(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), "device", within, prefix="near_")
    assert got.columns == ["id", "device", "ts", "prior_id", "near_id", "near_ts", "near_prior_id"]
    assert shown(got) == brute(left, right, within)
    assert interval_join(spark.createDataFrame([], SCHEMA), spark.createDataFrame(right, SCHEMA), "device", within).count() == 0


def test_streams_equal_tables_and_let_state_go(spark, tmp_path):
    left, right = made(200, 3), made(200, 4)
    left, right = left[:-2], right[:-2]
    live = []
    for name, rows in (("left", left), ("right", right)):
        for k in range(0, len(rows), 50):  # four batches, each later than the one before
            spark.createDataFrame(rows[k:k + 50], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        live.append(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name)))
    joined = interval_join(*live, "device", 60, prefix="near_", watermark="1 minute")
    query = joined.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")) \
        .trigger(availableNow=True).start()
    query.awaitTermination()
    assert shown(spark.read.schema(joined.schema).parquet(str(tmp_path / "out"))) == brute(left, right, 60)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert held[-1] < 60 < len(left) + len(right)  # two minutes of rows, not all


def test_streams_and_tables_do_not_mix(spark, tmp_path):
    rows = spark.createDataFrame(made(5, 5), SCHEMA)
    rows.write.parquet(str(tmp_path / "rows"))
    with pytest.raises(ValueError):
        interval_join(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "rows")), rows, "device", 10)
    with pytest.raises(ValueError):
        interval_join(rows, rows, "device", 0)


def test_replayed_batches_add_nothing(spark, tmp_path):
    path = str(tmp_path / "sink")
    rows = spark.range(10).select("id", (F.col("id") % 3).alias("batch_key"))
    assert sinks.read_batches(spark, path, rows.schema).count() == 0
    write = sinks.batch_sink(path)
    write(rows, 0)
    write(rows, 0)
    write(rows.where("id > 7"), 1)
    # A batch that failed half-way: rows without an entry in the ledger are not seen, and its replay replaces them.
    rows.write.parquet(f"{path}/rows/batch=2")
    show = lambda: sorted((r.batch, r.id) for r in sinks.read_batches(spark, path, rows.schema).collect())
    want = [(0, i) for i in range(10)] + [(1, 8), (1, 9)]
    assert show() == want
    write(rows.where("id = 5"), 2)
    assert show() == [*want, (2, 5)]


def test_stream_replayed_from_its_start(spark, tmp_path):
    for k in range(3):
        spark.range(10 * k, 10 * k + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for attempt in ("one", "two"):
        sinks.stream_once(live, str(tmp_path / "out"), str(tmp_path / attempt)).awaitTermination()
    got = sinks.read_batches(spark, str(tmp_path / "out"), live.schema).collect()
    assert sorted(r.id for r in got) == list(range(30)) and {r.batch for r in got} == {0, 1, 2}
