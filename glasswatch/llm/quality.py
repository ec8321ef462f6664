"""Quality rules by weak supervision.

Rules look at counts of a text and vote good (1), bad (-1) or abstain (0).  How often each combination of votes occurs is
counted over all documents; there are at most 3**rules combinations, whatever the number of documents, so this table may
go to the driver.  Expectation-maximisation on it estimates, without labels, how often each rule votes what on good and on
bad documents; the posterior probability of good, given all votes, decides instead of all rules having to pass.

Empty and null texts have no words: their counts are 0.  A null id stays null.  Input columns other than the id and the
text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from glasswatch.llm.common import SLICE_BYTES, lower_ascii, mixed, prefix_hash, query, range_hash, slices, table, text_bytes, words

# Function words of the languages of the corpus: fixed values.
STOPWORDS = ("the of and to in a is that it for on was with be by are das der die und ist von im ein eine zu nicht mit den auf für "
             "le la les de des et un une est pour que dans qui sur pas du el los las y en por con una para no se lo del").split()
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_stop",
          "n_ends", "n_shout", "n_stutter")
WINDOW = 5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_BREAK = ord("\n")


def _per(text_of: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(text_of, weights, n).astype(np.int64)


def _earlier(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether an equal key of the same owner stands before; owners ascend."""
    order = np.lexsort((keys, owner))
    same = np.zeros(len(keys), bool)
    if len(keys):
        k, o = keys[order], owner[order]
        same[order[1:]] = (k[1:] == k[:-1]) & (o[1:] == o[:-1])
    return same


def counts(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each text of a batch."""
    data, offsets = text_bytes(column)
    n = len(offsets) - 1
    at = np.repeat(np.arange(n), np.diff(offsets))
    start, end, first = words(data, offsets)
    n_words = np.diff(first)
    of = np.repeat(np.arange(n), n_words)
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    prefix = prefix_hash(data)
    key = range_hash(prefix, start, end)

    # Lines with a word: from the break or text start before its first word to the next break or text end.
    breaks = np.flatnonzero(data == _BREAK)
    edge = np.unique(np.concatenate((offsets[:-1], breaks, breaks + 1)))
    line = np.unique(np.searchsorted(edge, start, "right") - 1)
    begin = edge[line]
    stop = np.concatenate((edge, [len(data)]))[line + 1]
    line_of = np.searchsorted(offsets, begin, "right") - 1
    n_lines = _per(line_of, n)
    dup = _earlier(range_hash(prefix, begin, stop), line_of)

    # Words in windows that occur twice or more in their text.
    repeat = np.zeros(len(start), bool)
    if len(start) >= WINDOW:
        m = len(start) - WINDOW + 1
        window = np.zeros(m, np.uint64)
        for k in range(WINDOW):
            window = mixed(window + key[k:k + m])
        whole = np.flatnonzero(of[:m] == of[WINDOW - 1:])
        w, o = window[whole], of[whole]
        order = np.lexsort((w, o))
        same = (w[order][1:] == w[order][:-1]) & (o[order][1:] == o[order][:-1])
        twice = np.zeros(len(whole), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        delta = np.zeros(len(start) + 1, np.int64)
        np.add.at(delta, whole[twice], 1)
        np.add.at(delta, whole[twice] + WINDOW, -1)
        repeat = np.cumsum(delta[:-1]) > 0

    low = lower_ascii(data)
    upper = low != data
    letter = (low >= 97) & (low <= 122)
    stop_keys = np.sort(_keys(STOPWORDS))
    low_key = range_hash(prefix_hash(low), start, end)
    known = stop_keys[np.minimum(np.searchsorted(stop_keys, low_key), len(stop_keys) - 1)] == low_key
    last = data[end - 1] if len(end) else np.zeros(0, np.uint8)
    return {
        "n_words": n_words, "word_chars": _per(of, n, chars[end] - chars[start]), "n_symbols": _per(at[_SYMBOL[data]], n),
        "n_dup_lines": _per(line_of[dup], n), "n_repeat_words": _per(of[repeat], n), "n_lines": n_lines,
        "n_letters": _per(at[letter], n), "n_upper": _per(at[upper], n), "n_stop": _per(of[known], n),
        "n_ends": _per(of[np.isin(last, [ord(c) for c in ".?!:;,"])], n), "n_shout": _per(at[data == ord("!")], n),
        "n_stutter": _per(of[1:][(of[1:] == of[:-1]) & (low_key[1:] == low_key[:-1])], n),
    }


def _keys(strings: list[str]) -> np.ndarray:
    data, offsets = text_bytes(pa.array(strings))
    return range_hash(prefix_hash(data), offsets[:-1], offsets[1:])


def measured_column(text: Column) -> Column:
    """COUNTS of each text as a struct of longs."""
    @arrow_udf(", ".join(f"{c} long" for c in COUNTS))
    def measured(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [counts(batch.slice(*part)) for part in slices(batch, SLICE_BYTES)] or [counts(batch)]
            yield pa.StructArray.from_arrays([pa.array(np.concatenate([f[c] for f in found]), pa.int64()) for c in COUNTS], COUNTS)
    return measured(text.cast("string"))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and COUNTS (long)."""
    return docs.select(id_col, measured_column(F.col(text_col)).alias("__m")).select(id_col, *(F.col(f"__m.{c}") for c in COUNTS))


def _ratio(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0).cast("tinyint")


def rules() -> dict[str, Column]:
    """Votes by name, over the columns COUNTS.  Thresholds hold for texts of any length."""
    return {
        "length": _vote(F.col("n_words") < 10, F.col("n_words") >= 50),
        "word_length": _vote((_ratio("word_chars", "n_words") < 2.5) | (_ratio("word_chars", "n_words") > 12),
                             _ratio("word_chars", "n_words").between(3.5, 8)),
        "symbols": _vote(_ratio("n_symbols", "n_words") > 0.1, _ratio("n_symbols", "n_words") < 0.02),
        "lines": _vote((_ratio("n_dup_lines", "n_lines") > 0.3) & (F.col("n_lines") >= 10), (F.col("n_lines") >= 3) & (F.col("n_dup_lines") == 0)),
        "repeats": _vote(_ratio("n_repeat_words", "n_words") > 0.2, _ratio("n_repeat_words", "n_words") < 0.05),
        "stutter": _vote(_ratio("n_stutter", "n_words") > 0.15, _ratio("n_stutter", "n_words") < 0.03),
        "capitals": _vote(_ratio("n_upper", "n_letters") > 0.3, _ratio("n_upper", "n_letters") < 0.15),
        "function_words": _vote((_ratio("n_stop", "n_words") < 0.03) & (F.col("n_words") >= 50),
                                _ratio("n_stop", "n_words") >= 0.1),
        "shouting": _vote(_ratio("n_shout", "n_words") > 0.2, (F.col("n_shout") == 0) & (F.col("n_words") >= 20)),
    }


def fit(patterns: np.ndarray, weights: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray]:
    """Prior of good, and P(vote | class, the rule votes) as [rule, class, vote + 1]; classes are bad, good.  Whether a rule
    abstains is taken as independent of the class, so an abstention is no evidence and its entry is 1.

    Bad votes are rare and meant, so it starts from calling bad what any rule calls bad; a rule that cries bad where all
    the others see good loses weight in the rounds that follow."""
    votes = patterns.astype(int) + 1
    r = patterns.shape[1]
    good = np.where((patterns < 0).any(1), 0.05, 0.95)
    prior, table = 0.5, np.full((r, 2, 3), 1 / 3)
    for _ in range(rounds):
        old = table.copy()
        total = weights.sum()
        share = (weights * good).sum()
        prior = float(np.clip((share + 1) / (total + 2), 1e-6, 1 - 1e-6))
        for j in range(r):
            for k, p in enumerate((1 - good, good)):
                # One pseudo-count for each vote; agreement with the class has a second one.
                base = np.array([2.0, 0, 1]) if k == 0 else np.array([1.0, 0, 2])
                cast = np.bincount(votes[:, j], weights * p, 3) * [1, 0, 1] + base
                table[j, k] = cast / cast.sum() + [0, 1, 0]
        good = posterior(patterns, prior, table)
        if np.abs(table - old).max() < 1e-9:
            break
    return prior, table


def posterior(patterns: np.ndarray, prior: float, table: np.ndarray) -> np.ndarray:
    """P(good | votes) of each combination."""
    votes = patterns.astype(int) + 1
    j = np.arange(patterns.shape[1])
    odds = np.log(prior / (1 - prior)) + (np.log(table[j, 1, votes]) - np.log(table[j, 0, votes])).sum(1)
    return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def judge(measured: DataFrame, checks: dict[str, Column] | None = None) -> DataFrame:
    """The measured rows with ``quality``: the posterior probability of good."""
    checks = rules() if checks is None else checks
    names = list(checks)
    # A combination of votes as one number in base 3.
    code = sum((F.col("__votes")[k].cast("long") + 1) * 3 ** k for k in range(len(names)))
    voted = measured.withColumn("__votes", F.array(*checks.values())).withColumn("__code", code)
    seen = voted.groupBy("__code").count().collect()  # at most 3**rules rows
    codes = np.array([x["__code"] for x in seen], np.int64).reshape(-1)
    patterns = np.stack([codes // 3 ** k % 3 - 1 for k in range(len(names))], 1) if len(seen) else np.zeros((0, len(names)), int)
    weights = np.array([x["count"] for x in seen], float)
    prob = posterior(patterns, *fit(patterns, weights))
    rows = [(int(c), float(p)) for c, p in zip(codes, prob)]
    known = measured.sparkSession.createDataFrame(rows, "__code long, quality double")
    return voted.join(F.broadcast(known), "__code").drop("__code", "__votes")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def verdicts(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Counts, base verdict, posterior and decision of each document."""
    return decide(measure(docs), least)


def passed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that are kept, all columns as they were."""
    whole = docs.select(F.struct("*").alias("__doc"), measured_column(F.col(text_col)).alias("__m"))
    return decide(whole.select("__doc", *(F.col(f"__m.{c}") for c in COUNTS))).where("kept").select("__doc.*")


def decide(measured: DataFrame, least: float = 0.5) -> DataFrame:
    judged = judge(measured)
    return judged.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))


@query("op7_quality_rules")
def op7(spark, sf):
    """Verdicts on all documents; no SQL twin (the posterior comes from an iteration)."""
    return verdicts(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
