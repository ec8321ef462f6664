"""Content-free reporting: what leaves the scan is category, risk and a hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glasswatch.functions.text import content_hash, size_kb
from glasswatch.rules.catalog import THREATS

IDENTITY = ("tenant", "user", "device", "platform")
ALERT_COLUMNS = (*IDENTITY, "tool", "stage", "ts", "threat_id", "category", "risk_level", "content_hash")
# Columns that would carry content; none may appear in an alert.
FORBIDDEN = ("text", "match", "redacted", "hint", "prompt", "content", "path")


def blocked_override(risk_level: Column, action: Column, decision: Column | None = None, scope: str = "finding") -> Column:
    """``scope='text'``: a denied text reports every finding as Blocked;
    ``'finding'``: only blocked findings are."""
    blocked = decision == "deny" if scope == "text" else action == "block"
    return F.when(blocked, F.lit("Blocked")).otherwise(risk_level)


def content_free_alerts(df: DataFrame, findings: str = "reported", scope: str = "text",
                        decision: str = "decision") -> DataFrame:
    """One alert per reported finding.  ``df`` carries the identity columns,
    ``tool``, ``stage`` and ``ts``; absent ones become null."""
    have = set(df.columns)
    base = [F.col(c) if c in have else F.lit(None).cast("timestamp" if c == "ts" else "string").alias(c)
            for c in (*IDENTITY, "tool", "stage", "ts")]
    rows = df.select(*base, *([decision] if scope == "text" else []), F.explode(findings).alias("f"))
    return rows.select(
        *IDENTITY, "tool", "stage", "ts", F.col("f.threat_id").alias("threat_id"), F.col("f.category").alias("category"),
        blocked_override(F.col("f.risk_level"), F.col("f.action"),
                         F.col(decision) if scope == "text" else None, scope).alias("risk_level"),
        content_hash(F.coalesce(F.col("f.match"), F.lit(""))).alias("content_hash"))


def mcp_denied_alert(df: DataFrame, server: str = "server") -> DataFrame:
    have = set(df.columns)
    base = [F.col(c) if c in have else F.lit(None).cast("timestamp" if c == "ts" else "string").alias(c)
            for c in (*IDENTITY, "tool")]
    ts = F.col("ts") if "ts" in have else F.lit(None).cast("timestamp")
    return df.select(*base, F.lit("mcp").alias("stage"), ts.alias("ts"), F.lit(0).alias("threat_id"),
                     F.lit("MCP: unapproved server").alias("category"), F.lit("Blocked").alias("risk_level"),
                     content_hash(F.col(server)).alias("content_hash"))


def upload_events(files: DataFrame, name: str = "name", size: str = "size", mime: str = "mime") -> DataFrame:
    """Every uploaded file is an alert of threat 18, hashed by its name."""
    threat = next(t for t in THREATS if t.threat_id == 18)
    label = F.coalesce(F.nullif(F.col(name), F.lit("")), F.nullif(F.col(mime), F.lit("")), F.lit("file"))
    keep = [c for c in (*IDENTITY, "tool", "ts") if c in files.columns]
    return files.select(*keep, F.lit("upload").alias("stage"), F.lit(18).alias("threat_id"),
                        F.lit(threat.category).alias("category"), F.lit(threat.risk_level).alias("risk_level"),
                        size_kb(F.col(size)).alias("size_kb"), content_hash(label).alias("content_hash"))
