import collections
import re
import tracemalloc

import numpy as np
import pyarrow as pa

from glasswatch.llm import quality
from glasswatch.llm.common import slices

from .helpers import LARGER, WORD, edge_docs, rows


def brute(text):
    text = text or ""
    words, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = collections.Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if grams[tuple(words[i:i + 5])] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_query_and_labels(spark):
    from glasswatch.llm.registry import QUERIES
    got = {r.doc_id: r for r in QUERIES["op7_quality_rules"](spark, LARGER).collect()}
    docs = rows("documents", LARGER)
    assert len(got) == len(docs)
    for x in docs:
        r, b = got[x["doc_id"]], brute(x["text"])
        assert tuple(r[f] for f in FIELDS) == b
        assert r.base_failed == (b[0] < 10 or 100 * b[4] > 20 * b[0])
        assert not (r.base_failed and r.kept)
    seen = collections.Counter((x["quality"], got[x["doc_id"]].kept) for x in rows("labels", LARGER) if not got[x["doc_id"]].base_failed)
    assert seen[1, True] >= 0.97 * (seen[1, True] + seen[1, False])
    assert seen[0, False] >= 0.9 * (seen[0, True] + seen[0, False])


def test_counts_of_odd_texts():
    import pyarrow as pa
    texts = ["", None, "a\na\n\n\na", "x y z v w x y z v w", "é é é é é é é", "\n", "one", "a b c d e\na b c d e", " lead", "trail \n"]
    found = quality.counts(pa.array(texts))
    for k, text in enumerate(texts):
        assert tuple(int(found[f][k]) for f in FIELDS) == brute(text), text


def test_estimation_finds_a_rule_that_lies():
    rng = np.random.default_rng(1)
    good = rng.random(4000) < 0.8
    votes = np.zeros((4000, 4), int)
    for j, right in enumerate((0.95, 0.9, 0.9, 0.5)):  # the last one is a coin
        votes[:, j] = np.where(rng.random(4000) < right, np.where(good, 1, -1), np.where(good, -1, 1))
        votes[rng.random(4000) < 0.2, j] = 0
    patterns, back, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    prior, table = quality.fit(patterns, n.astype(float))
    said = quality.posterior(patterns, prior, table)[back.ravel()] > 0.5
    assert abs(prior - 0.8) < 0.05 and (said == good).mean() > 0.95
    assert abs(table[3, 1, 2] - table[3, 0, 2]) < 0.15 < table[0, 1, 2] - table[0, 0, 2]


def test_edges(spark):
    got = quality.verdicts(edge_docs(spark)).collect()
    assert len(got) == 7 and sum(not r.base_failed for r in got) == 1 and not any(r.kept and r.base_failed for r in got)
    whole = quality.passed(edge_docs(spark))
    assert whole.columns == edge_docs(spark).columns and whole.count() == sum(r.kept for r in got)
    assert quality.verdicts(edge_docs(spark, empty=True)).collect() == []


def test_counting_works_on_short_slices():
    texts = pa.array(["Some words of a text, and more of them.\n" * 100] * 1500)  # 6 MB
    cut = list(slices(texts, quality.SLICE_BYTES))
    assert len(cut) > 4
    tracemalloc.start()
    for part in cut:
        quality.counts(texts.slice(*part))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 160 << 20  # with slices of 4 MB: 434 MB
