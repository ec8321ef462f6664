"""Outputs: alerts, audit log lines, component report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glasswatch.operators.alerts import ALERT_COLUMNS, FORBIDDEN


def check_content_free(df: DataFrame) -> DataFrame:
    """Refuse a schema that could carry content."""
    bad = [c for c in df.columns if c.lower() in FORBIDDEN]
    extra = [c for c in df.columns if c not in ALERT_COLUMNS and c != "size_kb"]
    if bad or extra:
        raise ValueError(f"not an alert column: {bad + extra}")
    return df


def write_alerts(alerts: DataFrame, path: str, fmt: str = "parquet", mode: str = "append") -> None:
    check_content_free(alerts).write.format(fmt).mode(mode).save(path)


def write_component_csv(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.select("type", "name", "detail").write.option("header", True).option("quoteAll", True) \
        .option("escape", '"').mode(mode).csv(path)


def read_component_csv(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a written report.  A CSV file has no null: a missing detail is an empty one."""
    return spark.read.schema("type string, name string, detail string").option("header", True).option("escape", '"') \
        .option("multiLine", True).csv(path).fillna("", ["detail"])


def stream_audit(entries: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append-only JSON lines."""
    return entries.writeStream.format("json").outputMode("append").option("path", path) \
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def batch_sink(path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each batch once, however often it is replayed.

    A batch's rows go to a folder of its own; when they are complete a ledger below ``path`` gets its number.  A replay of a listed batch
    adds nothing, one of a batch that failed half-way replaces what it left, and readers see listed batches only."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if not ledger(spark, path).where(F.col("batch") == batch_id).isEmpty():
            return
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")
        spark.range(1).select(F.lit(batch_id).cast("long").alias("id")).write.mode("overwrite").parquet(f"{path}/ledger/batch={batch_id}")

    return write


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """One row per complete batch."""
    try:
        return spark.read.schema("id long, batch long").parquet(f"{path}/ledger").select("batch")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "batch long")


def read_batches(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of all complete batches, and the number of each row's batch."""
    done = ledger(spark, path)
    if done.isEmpty():
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(None).cast("long"))
    typed = spark.createDataFrame([], schema).withColumn("batch", F.lit(0).cast("long")).schema
    return spark.read.schema(typed).parquet(f"{path}/rows").join(done, "batch", "left_semi").select(typed.names)


def stream_once(rows: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write a stream through ``batch_sink``."""
    return rows.writeStream.foreachBatch(batch_sink(path)).option("checkpointLocation", checkpoint) \
        .trigger(**(trigger or {"availableNow": True})).start()
