"""Agent tool calls: which text to review, and the verdict per call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glasswatch.functions.regex_dialect import Pattern
from glasswatch.functions.text import js_trim
from glasswatch.operators.policy import decide_mcp_server, decide_reviewed
from glasswatch.operators.scan import review
from glasswatch.plans.skew import salted_join

# Commands that only print files, and shell syntax that hides what is read.
READERS = ("cat", "head", "tail", "less", "bat", "xxd", "nl", "more")
_UNCLEAR = Pattern(r"[|><`$(){}]|&&|\|\|").java()
_READ = Pattern(r"^(?:" + "|".join(READERS) + r")\s+(.+)$").java()
_SPACES = Pattern(r"\s+").java()


def extract_read_paths(command: Column, most: int | None = None) -> Column:
    """Files a plain reader command names, flags dropped; anything unclear gives none.  ``most`` keeps the first few only."""
    cmd = js_trim(F.coalesce(command, F.lit("")))
    tail = F.regexp_replace(cmd, r"\A(?:" + "|".join(READERS) + ")" + _SPACES, "")
    words = F.filter(F.split(tail, _SPACES), lambda w: (w != "") & ~w.startswith("-"))
    return F.when(cmd.rlike(_READ) & ~cmd.rlike(_UNCLEAR), words if most is None else F.slice(words, 1, most)) \
        .otherwise(F.array().cast("array<string>"))


def mcp_server_of(tool: Column) -> Column:
    """``mcp__server__tool`` -> server."""
    return F.when(tool.startswith("mcp__"), F.coalesce(F.try_element_at(F.split(tool, "__"), F.lit(2)), F.lit("")))


def plain_json(text: Column) -> Column:
    """JSON whose characters are written as themselves: escapes cannot hide a phrase.  Text that is no JSON stays."""
    return F.when(F.contains(text, F.lit("\\u")), F.coalesce(F.to_json(F.try_parse_json(text)), text)).otherwise(text)


def route(calls: DataFrame) -> DataFrame:
    """Add ``route`` (read, bash, mcp, other), ``server``, ``paths`` and ``mcp_decision``.

    ``calls``: call_id, tool_name, tool_input (JSON text), policy."""
    tool, ti = F.col("tool_name"), F.col("tool_input")
    return calls.select(
        "*", F.when(tool == "Read", "read").when(tool == "Bash", "bash").when(tool.startswith("mcp__"), "mcp")
        .otherwise("other").alias("route"),
        mcp_server_of(tool).alias("server"),
        F.when(tool == "Read", F.array_compact(F.array(F.get_json_object(ti, "$.file_path"))))
        .when(tool == "Bash", extract_read_paths(F.get_json_object(ti, "$.command")))
        .otherwise(F.array().cast("array<string>")).alias("paths")
    ).withColumn("mcp_decision", F.when(
        F.col("route") == "mcp", decide_mcp_server(F.col("server"), F.col("policy.mcp_allow"))))


def review_calls(calls: DataFrame, files: DataFrame, **rules) -> DataFrame:
    """(call_id, route, decision, reasons): one row per call.

    Each file somebody reads is reviewed once, however many calls name it; what
    is joined to the calls is its short list of findings, salted because one path
    may be in most calls.  A denied server is never scanned; other tools are
    allowed.  ``files``: path, content."""
    routed = route(calls)
    active = F.col("policy").isNotNull()
    wanted = routed.where(active & F.col("route").isin("read", "bash")).select(
        "call_id", "policy", F.posexplode("paths").alias("pos", "path"))
    needed = files.join(wanted.select("path").distinct(), "path", "left_semi").select("path", F.col("content").alias("text"))
    seen_files = review(needed, "text", "file", **rules).drop("text")
    from_files = salted_join(wanted, seen_files, ["path"], "inner", salt_on=["call_id", "pos"]).drop("path")
    args = routed.where(active & (F.col("route") == "mcp") & (F.col("mcp_decision") == "allow")).select(
        "call_id", "policy", F.lit(0).alias("pos"), plain_json(F.col("tool_input")).alias("text"))
    from_args = review(args, "text", "prompt", **rules).drop("text")
    seen = decide_reviewed(from_files.unionByName(from_args), "policy")
    rank = F.when(F.col("decision") == "deny", 3).when(F.col("decision") == "ask", 2).otherwise(1)
    # The strictest text decides; between equals, the first one read.
    best = seen.select("call_id", F.struct((-rank).alias("r"), "pos", "decision", "reasons").alias("b"), F.size("reported").alias("n")) \
        .groupBy("call_id").agg(F.min("b").alias("b"), F.sum("n").alias("findings"))
    out = routed.select("call_id", "tool_name", "route", "server", "mcp_decision", active.alias("__on")).join(best, "call_id", "left")
    denied = F.col("__on") & (F.col("mcp_decision") == "deny")
    return out.select(
        "call_id", "tool_name", "route",
        F.when(denied, "deny").otherwise(F.coalesce("b.decision", F.lit("allow"))).alias("decision"),
        F.when(denied, F.array(F.concat(F.lit("MCP server not on the allow-list: "), F.col("server"))))
        .otherwise(F.coalesce("b.reasons", F.array().cast("array<string>"))).alias("reasons"),
        F.when(denied, F.lit(1)).otherwise(F.coalesce("findings", F.lit(0))).cast("int").alias("findings"))
