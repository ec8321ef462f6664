"""Language identification as mixture inference.

Training counts hashed byte trigrams of lower-cased words per language.  The table has languages x BUCKETS cells whatever
the number of documents, so it may go to the driver and be broadcast.  A document is taken as a mixture: each of its
trigrams comes from one of a set of languages, with unknown proportions.  Expectation-maximisation estimates the
proportions for one language, then for the best two, three and so on; a further language is accepted only where the gain
in log-likelihood exceeds a penalty that grows with the logarithm of the length.  All documents of a batch go through the
rounds together.

Null and letter-free texts get ``und`` with score 0, and so does every text if there was nothing to learn from.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glasswatch.llm.common import lower_ascii, query, small, table, text_bytes, words

BUCKETS = 1 << 15
UNKNOWN = "und"
# Log-likelihood that a further language has to gain, for each unit of the logarithm of the trigrams: neighbouring
# trigrams share two bytes, so each counts as a third of an independent draw, and half a unit is due for each proportion.
PENALTY = 3.0
ROUNDS = 12
LETTER = r"\p{L}"


def trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Text, bucket and count of the distinct hashed trigrams of each text; words are framed by one space."""
    data, offsets = text_bytes(column)
    n = len(offsets) - 1
    start, end, first = words(data, offsets)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), n
    # Words written one after the other, with one space before each and one at the end.
    size = end - start + 1
    place = np.concatenate(([0], np.cumsum(size)))
    spaced = np.full(place[-1] + 1, 0x20, np.uint8)
    inside = np.ones(place[-1], bool)
    inside[place[:-1]] = False
    keep = np.repeat(start - place[:-1] - 1, size) + np.arange(place[-1])
    spaced[:-1][inside] = data[keep[inside]]
    low = lower_ascii(spaced).astype(np.uint32)
    code = (low[:-2] << 16 | low[1:-1] << 8 | low[2:]) * np.uint32(2654435761) >> np.uint32(17)
    owner = np.repeat(np.repeat(np.arange(n), np.diff(first)), size)[:len(code)]
    whole = owner[:len(code)].astype(np.int64) << 15 | code
    whole.sort()
    edge = np.flatnonzero(np.concatenate(([True], whole[1:] != whole[:-1])))
    key = whole[edge]
    return key >> 15, key & (BUCKETS - 1), np.diff(np.concatenate((edge, [len(whole)]))), n


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Counts (lang, bucket, n) over all documents that have a language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in small(batches, 1):
            text, bucket, count, _ = trigrams(batch.column(1))
            langs = batch.column(0).dictionary_encode()
            of = langs.indices.to_numpy()[text]
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                here = of == k
                seen.setdefault(lang, np.zeros(BUCKETS))
                seen[lang] += np.bincount(bucket[here], count[here], BUCKETS)
        for lang, total in seen.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()),
                                              pa.array(total[at].astype(np.int64))], ["lang", "bucket", "n"])

    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Smoothed log-free probabilities, bucket by language; languages in order of their names."""

    def __init__(self, langs: list[str], chance: np.ndarray):
        self.langs, self.chance = langs, chance

    @classmethod
    def of(cls, counts: DataFrame) -> "Model":
        rows = counts.toArrow()  # languages x BUCKETS rows at most
        names = rows["lang"].to_pylist()
        langs = sorted(set(names))
        number = {x: k for k, x in enumerate(langs)}
        seen = np.zeros((BUCKETS, len(langs)))
        seen[rows["bucket"].to_numpy(), [number[x] for x in names]] = rows["n"].to_numpy()
        total = seen.sum(0)
        # A part of each language's mass goes to the pooled distribution, so that what one language has not shown is
        # judged by how common it is at all.
        pooled = (seen.sum(1) + 0.5) / (total.sum() + 0.5 * BUCKETS)
        return cls(langs, ((seen + 200 * pooled[:, None]) / (total + 200)).astype(np.float64))


def _mixture(p: np.ndarray, count: np.ndarray, edge: np.ndarray, rows: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each text, over the languages that ``allowed`` leaves it.
    ``edge`` is the first row of each text, ``rows`` how many rows it has."""
    share = allowed / allowed.sum(1, keepdims=True)
    n = np.add.reduceat(count, edge)
    for _ in range(ROUNDS):
        part = p * np.repeat(share, rows, 0)
        part *= (count / part.sum(1))[:, None]
        share = np.add.reduceat(part, edge, axis=0) / n[:, None]
    return share, np.add.reduceat(count * np.log((p * np.repeat(share, rows, 0)).sum(1)), edge)


def proportions(model: Model, column: pa.Array, penalty: float = PENALTY) -> np.ndarray:
    """Texts by languages: the estimated proportions over each text's selected set; zeros where a text has no trigram."""
    text, bucket, count, n = trigrams(column)
    out = np.zeros((n, len(model.langs)))
    if not len(text) or not model.langs:
        return out
    p, count = model.chance[bucket], count.astype(np.float64)
    owner, edge, rows = np.unique(text, return_index=True, return_counts=True)
    alone = np.add.reduceat(count[:, None] * np.log(p), edge, axis=0)
    best, k = alone.argmax(1), len(model.langs)
    here = np.arange(len(owner))
    share = np.zeros((len(owner), k))
    share[here, best] = 1
    fit_now = alone[here, best]
    n_grams = np.add.reduceat(count, edge)
    # Candidates by their proportions in the mixture of all languages; the best single language comes first.
    if k > 1:
        full, _ = _mixture(p, count, edge, rows, np.ones((len(owner), k)))
        full[here, best] = 2
        order = np.argsort(-full, 1, kind="stable")
        open_ = here
        for size in range(2, k + 1):
            row = np.repeat(np.isin(here, open_), rows)
            allowed = np.zeros((len(open_), k))
            allowed[np.arange(len(open_))[:, None], order[open_, :size]] = 1
            r = rows[open_]
            e = np.concatenate(([0], np.cumsum(r)[:-1]))
            new, gain = _mixture(p[row], count[row], e, r, allowed)
            better = gain - fit_now[open_] > penalty * np.log(n_grams[open_] + 1)
            share[open_[better]], fit_now[open_[better]] = new[better], gain[better]
            open_ = open_[better]
            if not len(open_):
                break
    out[owner] = share
    return out


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, lang_pred, score and ``languages`` (JSON: the selected set with its proportions)."""
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.chance))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, chance = sent.value
        known = Model(langs, chance)
        for batch in small(batches, 1):
            share = proportions(known, batch.column(1))
            lettered = batch.column(2).to_pylist()
            top = share.argmax(1) if langs else np.zeros(len(share), int)
            ok = [bool(x) and bool(langs) and share[i].sum() > 0 for i, x in enumerate(lettered)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([langs[top[i]] if o else UNKNOWN for i, o in enumerate(ok)], pa.string()),
                pa.array([min(1.0, float(share[i, top[i]])) if o else 0.0 for i, o in enumerate(ok)], pa.float64()),
                pa.array([json.dumps({langs[j]: round(float(share[i, j]), 6) for j in np.flatnonzero(share[i])}) if o else "{}"
                          for i, o in enumerate(ok)], pa.string())], ["id", "lang_pred", "score", "languages"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
                       F.coalesce(F.col(text_col).cast("string").rlike(LETTER), F.lit(False)).alias("lettered"))
    return rows.mapInArrow(run, f"id {id_type}, lang_pred string, score double, languages string").withColumnRenamed("id", id_col)


def fold(id_col: str = "doc_id"):
    """0 for held-out documents; null ids are learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5, F.lit(1))


@query("op9_language_id")
def op9(spark, sf):
    """Predictions for all documents, learned from four fifths; no SQL twin (an iteration)."""
    docs = table(spark, sf, "documents")
    model = Model.of(fit(docs.where(fold() != 0)))
    found = predict(docs, model)
    return found.select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score", "languages")
