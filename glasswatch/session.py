"""Session defaults.  Sizes stay with the cluster; only semantics are pinned."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Many regexes in one projection make large generated methods; Spark falls
    # back to split (non whole-stage) code on its own.
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Texts can be large: smaller Arrow batches keep Python workers small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4194304",
    # Call-site capture costs several JVM round trips per Column operation.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "glasswatch", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
