"""Terminal output arrives in chunks; review happens on whole lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glasswatch.functions.text import is_blank, strip_ansi
from glasswatch.plans.skew import running_sum

# A buffer without newline longer than LIMIT keeps its last KEEP characters.
LIMIT = 8192
KEEP = 4096


def reassemble(chunks: DataFrame, session: str = "session_id", seq: str = "seq", chunk: str = "chunk", *,
               limit: int | None = None, keep: int = KEEP, block: int = 4096) -> DataFrame:
    """(session, unit, text): each unit is what is reviewed when a chunk with a
    newline arrives - the kept tail plus everything up to that chunk's last newline.

    Chunks are numbered with a block-wise running count, so a busy session is
    split by unit.  Newline-free text is kept whole; with a ``limit`` a longer
    buffer keeps its last ``keep`` characters, as the terminal's does."""
    has = F.contains(F.col(chunk), F.lit("\n"))
    work = chunks.select(session, seq, F.coalesce(F.col(chunk), F.lit("")).alias(chunk))
    work = running_sum(work, session, seq, has.cast("long"), "__n", block)
    tail = F.substring_index(F.col(chunk), "\n", -1)
    head = F.substr(F.col(chunk), F.lit(1), F.length(chunk) - F.length(tail) - 1)
    parts = F.when(has, F.array(
        F.struct((F.col("__n") - 1).alias("unit"), head.alias("part"), F.lit(True).alias("closes"), F.lit(False).alias("opens")),
        F.struct(F.col("__n").alias("unit"), tail.alias("part"), F.lit(False).alias("closes"), F.lit(True).alias("opens")))) \
        .otherwise(F.array(F.struct(F.col("__n").alias("unit"), F.col(chunk).alias("part"), F.lit(False).alias("closes"),
                                    F.lit(False).alias("opens"))))
    rows = work.select(session, seq, F.explode(parts).alias("p")).select(session, seq, "p.*")
    units = rows.groupBy(session, "unit").agg(
        F.array_sort(F.collect_list(F.struct(seq, "closes", "opens", "part"))).alias("__p"),
        F.max("closes").alias("__closed")).where("__closed")

    def add(buffer, p):
        text = F.concat(buffer, p["part"])
        if limit is None:
            return text
        return F.when(p["closes"] | p["opens"] | (F.length(text) <= limit), text).otherwise(F.right(text, F.lit(keep)))

    text = strip_ansi(F.aggregate("__p", F.lit(""), add))
    return units.select(session, "unit", text.alias("text")).where(~is_blank(F.col("text")))
