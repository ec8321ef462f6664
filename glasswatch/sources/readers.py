"""Inputs as DataFrames: text files, tool calls, policies, packs, configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glasswatch.operators.packs import PACK_TYPE
from glasswatch.operators.policy import POLICY_TYPE

# Extensions and types read as text (fixed value).
TEXT_EXTENSIONS = ("txt md csv tsv json js ts jsx tsx py rb go java c cpp h html xml yml yaml log sql sh conf ini env").split()
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def balanced(df: DataFrame) -> DataFrame:
    """Spread a source that has fewer splits than the session has cores.

    One file with one row group would keep text work in a single task.  Tables
    with enough splits - any large one - are returned as they are, unshuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    return df.repartition(cores * 2) if splits < cores else df


def spread(df: DataFrame, key: str, times: int = 32) -> DataFrame:
    """Rows of a narrow table dealt by ``key`` to ``times`` tasks for each split.

    A split of compressed numbers holds millions of rows, which a query may make into text many times as long."""
    return df.repartition(df.rdd.getNumPartitions() * times, key)


def is_textual(name: Column, mime: Column) -> Column:
    ext = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.([A-Za-z]+)$", 1))
    mime = F.coalesce(mime, F.lit(""))
    return mime.startswith("text/") | (mime == "application/json") | ext.isin(*TEXT_EXTENSIONS)


def decode_text(content: Column, cap_bytes: int | None = None) -> Column:
    """File bytes as text; content holding a NUL byte is binary and gives ''.

    The whole file is read unless ``cap_bytes`` asks for the on-device limit."""
    data = F.substring(content, 1, cap_bytes) if cap_bytes else content
    return F.when(F.contains(data, F.lit(bytearray(b"\x00"))), F.lit("")).otherwise(F.make_valid_utf8(data.cast("string")))


def read_files(spark: SparkSession, path: str, cap_bytes: int | None = None, pattern: str = "*") -> DataFrame:
    """(path, name, size, text) of the files under ``path``."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return raw.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"),
                      decode_text(F.col("content"), cap_bytes).alias("text"))


def read_tool_calls(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of tool calls; the input object stays JSON text."""
    raw = spark.read.text(path)
    return raw.select(F.get_json_object("value", "$.call_id").alias("call_id"),
                      F.get_json_object("value", "$.ts").try_cast("timestamp").alias("ts"),
                      F.get_json_object("value", "$.tenant").alias("tenant"),
                      F.coalesce(F.get_json_object("value", "$.tool_name"), F.lit("")).alias("tool_name"),
                      F.coalesce(F.get_json_object("value", "$.tool_input"), F.lit("{}")).alias("tool_input"))


_POLICY_JSON = ("struct<tenant:string,valid_from:timestamp,threatPolicy:map<string,string>,tierPolicy:map<string,string>,"
                "contentPolicy:map<string,string>,mcpAllow:array<string>,allowedTools:array<string>,"
                "outputReview:boolean,outputRedaction:boolean>")


def parse_policy(json: Column) -> Column:
    """Policy JSON -> policy STRUCT; text that is no JSON gives null (no policy)."""
    p = F.from_json(json, _POLICY_JSON)
    threats = F.transform_keys(p["threatPolicy"], lambda k, v: k.cast("int"))
    return F.when(F.try_parse_json(json).isNotNull(), F.struct(
        threats.alias("threat_policy"), p["tierPolicy"].alias("tier_policy"), p["contentPolicy"].alias("content_policy"),
        p["mcpAllow"].alias("mcp_allow"), p["allowedTools"].alias("allowed_tools"),
        p["outputReview"].alias("output_review"), p["outputRedaction"].alias("output_redaction")).cast(POLICY_TYPE))


def read_policies(spark: SparkSession, path: str) -> DataFrame:
    """(tenant, valid_from, policy) from JSON lines."""
    raw = spark.read.text(path).withColumn("p", F.from_json("value", _POLICY_JSON))
    return raw.select("p.tenant", "p.valid_from", parse_policy(F.col("value")).alias("policy"))


def read_packs(spark: SparkSession, path: str) -> DataFrame:
    """Packs from JSON lines {pack_no, packId, detectors}."""
    shape = PACK_TYPE.split("detectors ", 1)[1]
    raw = spark.read.schema(f"pack_no int, packId string, detectors {shape}").json(path)
    return raw.select("pack_no", F.col("packId").alias("pack_id"), "detectors")
