"""Device posture: decoded security state, patches, versions, latest report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def av_flags(state: Column) -> Column:
    """Security-centre product state -> STRUCT<enabled, up_to_date>."""
    scanner = F.shiftright(state, 8).bitwiseAND(0xFF)
    return F.struct(scanner.isin(0x10, 0x11).alias("enabled"), (state.bitwiseAND(0xFF) == 0).alias("up_to_date"))


def firewall_flags(domain: Column, private: Column, public: Column) -> Column:
    return F.struct((domain == 1).alias("domain"), (private == 1).alias("private"), (public == 1).alias("public"))


def volumes_protected(volumes: Column) -> Column:
    """Protection status per volume: 1 = on, null = unknown."""
    return F.transform(volumes, lambda v: F.struct(v["drive"].alias("drive"), (v["status"] == 1).alias("protected")))


def reboot_pending(*flags: Column) -> Column:
    out = F.lit(False)
    for f in flags:
        out = out | F.coalesce(f, F.lit(False))
    return out


def patch_status(text: Column) -> Column:
    """Update-tool output -> STRUCT<up_to_date, count, titles>: titles are counted, labels when there are none."""
    lines = F.transform(F.split(text, r"\r?\n"), lambda l: F.trim(l))
    titles = F.transform(F.filter(lines, lambda l: l.startswith("Title:")),
                         lambda l: F.regexp_replace(F.trim(F.regexp_replace(l, r"^(?:Title:)+", "")), r",+$", ""))
    labels = F.filter(lines, lambda l: l.startswith("* Label:"))
    none_new = F.contains(text, F.lit("No new software available"))
    count = F.when(none_new, 0).when(F.size(titles) > 0, F.size(titles)).otherwise(F.size(labels))
    return F.struct((count == 0).alias("up_to_date"), count.cast("int").alias("count"),
                    F.when(none_new, F.array().cast("array<string>")).otherwise(titles).alias("titles"))


def latest_device_state(reports: DataFrame, device: str = "device", ts: str = "ts",
                        fields: Sequence[str] | None = None) -> DataFrame:
    """Identity, full and follow-up reports merged: the newest non-null value of each field, of equally new ones the
    greatest.

    Pure aggregates, so a chatty device is combined before the shuffle."""
    names = fields or [c for c in reports.columns if c not in (device, ts)]
    return reports.groupBy(device).agg(
        F.max(ts).alias(ts), *[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(ts, c))).alias(c) for c in names])
