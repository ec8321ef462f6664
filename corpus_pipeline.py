"""Stages over the documents table; each is written as Parquet and read again as the next one's input."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glasswatch.llm import bpe, decontaminate, quality, secretscan, simhash
from glasswatch.llm.common import BATCH_ROWS, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' posterior keeps."""
    return quality.passed(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of fingerprints that links of two bits or fewer join: the one with the smallest id; one
    without an id only where no document of the group has one."""
    return simhash.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a tag; n_chars follows the text."""
    scanned = secretscan.scan(docs.select(F.struct("*").alias("doc"), F.col("text").cast("string").alias("text")),
                              secretscan.trained(spark, docs))
    masked = scanned.select("doc", F.when(F.size("spans") > 0, secretscan.mask(F.col("text"), F.col("spans"))).alias("masked"))
    new = {"text": F.coalesce("masked", "doc.text"),
           "n_chars": F.when(F.col("masked").isNotNull(), F.char_length("masked")).otherwise(F.col("doc.n_chars"))}
    return masked.select(*(new.get(c, F.col("doc")[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text that is left, and their round trip."""
    return bpe.digests(docs)


def _stage(fn):
    """The stage with Arrow batches of a size that long texts allow."""
    @functools.wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        return fn(spark, docs, sf_dir)
    return run_stage


STAGES = [(name, _stage(fn)) for name, fn in (
    ("quality rules", quality_rules), ("SimHash near-dedup", near_dedup), ("benchmark decontamination", without_benchmark),
    ("secret scans", without_secrets), ("byte-level BPE encoding and decoding", encoding))]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = written(docs) if k + 1 < len(STAGES) else docs
    return docs


#: No SQL twin: neither expectation-maximisation nor merges by rank can be stated in it.
ORACLE_SQL = None
