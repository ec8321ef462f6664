"""Keyed state for streams: line buffers and session windows.

State stays small and bounded per key; the operators only assemble text.
Detection runs afterwards as ordinary stateless expressions, the same ones the
batch operators use.  Rows of a key are ordered within a micro-batch, whose size
the source's trigger limits bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from glasswatch.functions.text import is_blank, strip_ansi
from glasswatch.operators.output_lines import KEEP, LIMIT
from glasswatch.operators.scan import sealed
from glasswatch.operators.sessions import WINDOW, scan_joined, turn_flag


def _ordered(parts: Iterator[pd.DataFrame], by: str) -> pd.DataFrame:
    frames = [p for p in parts if len(p)]
    return pd.concat(frames).sort_values(by, kind="stable") if frames else pd.DataFrame()


def _spread(rows: DataFrame, text: str, *by: str) -> DataFrame:
    """Repartition stateful output (the generator first gives it Spark's row layout)."""
    rest = [c for c in rows.columns if c != text]
    laid = sealed(rows.withColumnRenamed(text, "__text"), text, F.col("__text")).select(*rest, text)
    return laid.repartition(*by)


def line_stream(chunks: DataFrame, session: str = "session_id", seq: str = "seq", chunk: str = "chunk", *,
                limit: int = LIMIT, keep: int = KEEP) -> DataFrame:
    """(session, unit, text) as lines complete; the state is the text since the last newline."""
    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buffer, unit = state.get if state.exists else ("", 0)
        units, texts = [], []
        rows = _ordered(parts, seq)
        for piece in rows[chunk].fillna("") if len(rows) else ():
            buffer += piece
            cut = buffer.rfind("\n")
            if cut < 0:
                if len(buffer) > limit:  # what does not fit is reviewed as a unit of its own, not dropped
                    units.append(unit)
                    texts.append(buffer)
                    buffer, unit = buffer[-keep:] if keep else "", unit + 1
                continue
            units.append(unit)
            texts.append(buffer[:cut])
            buffer, unit = buffer[cut + 1:], unit + 1
        state.update((buffer, unit))
        yield pd.DataFrame({session: [key[0]] * len(units), "unit": units, "text": texts})

    key_type = chunks.schema[session].dataType.simpleString()
    out = chunks.select(session, seq, chunk).groupBy(session).applyInPandasWithState(
        step, f"{session} {key_type}, unit long, text string", "buffer string, unit long", "append",
        GroupStateTimeout.NoTimeout)
    # Spread a busy session again for the work on its text.
    out = _spread(out, "text", session, "unit")
    return out.withColumn("text", strip_ansi(F.col("text"))).where(~is_blank(F.col("text")))


def session_stream(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text", *,
                   window: int = WINDOW, idle: str | None = None, **rules) -> DataFrame:
    """Findings per arriving turn over the last ``window`` turns, as in the batch operator.

    ``idle`` milliseconds without a turn drop a conversation's state."""
    flagged = turn_flag(turns.where(~is_blank(F.col(text))), text, "__flag", **(
        {"detectors": rules["detectors"]} if "detectors" in rules else {})).select(conv, turn, text, "__flag")

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        texts, flags = (list(x) for x in state.get) if state.exists else ([], [])
        out = []
        rows = _ordered(parts, turn)
        for t, body, flag in zip(rows[turn], rows[text], rows["__flag"]) if len(rows) else ():
            texts, flags = [*texts, body][-window:], [*flags, int(flag)][-window:]
            out.append((key[0], t, len(texts), sum(flags), "\n".join(texts)))
        state.update((texts, flags))
        if idle:
            state.setTimeoutDuration(int(idle))
        yield pd.DataFrame(out, columns=[conv, turn, "n_turns", "flagged_turns", "joined"])

    kinds = {c: turns.schema[c].dataType.simpleString() for c in (conv, turn)}
    joined = flagged.groupBy(conv).applyInPandasWithState(
        step, f"{conv} {kinds[conv]}, {turn} {kinds[turn]}, n_turns int, flagged_turns long, joined string",
        "texts array<string>, flags array<int>", "append",
        GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)
    # State is per conversation, but the text work need not be: a busy one is spread again by turn.
    joined = _spread(joined, "joined", conv, turn)
    return scan_joined(joined, "joined", "flagged_turns", "n_turns", **rules).drop("joined").withColumn(
        "multi_turn", F.lit(True))
