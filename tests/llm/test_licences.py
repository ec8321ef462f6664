import random
import re

import numpy as np
from pyspark.sql import functions as F

from glasswatch.llm import licences

from .helpers import LARGER, LOWER, edge_docs, rows

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base(text):
    w = WORDS.findall((text or "").translate(LOWER))
    found = [(i, label) for phrase, label in licences.PHRASES for i in range(len(w)) if w[i:i + len(phrase.split())] == phrase.split()]
    at = sorted(i for i, _ in found)
    return len(w), len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted({x for _, x in found}))


def occurs(templates, run):
    return sorted((t, i) for t, x in enumerate(templates) for i in range(len(x) - len(run) + 1) if x[i:i + len(run)] == run)


def test_statistics_and_places_against_all_substrings():
    rng = random.Random(7)
    for _ in range(60):
        templates = [[rng.choice("abc") for _ in range(rng.randint(1, 14))] for _ in range(rng.randint(1, 5))]
        a = licences.Automaton([("x", " ".join(t)) for t in templates])
        text = [rng.choice("abcd") for _ in range(50)]
        ids = [a.number.get(w.encode(), -1) for w in text]
        best = []
        for i, (state, run) in enumerate(a.statistics(ids)):
            want = max(n for n in range(i + 2) if n == 0 or occurs(templates, text[i + 1 - n:i + 1]))
            assert run == want
            best.append(want)
            if run:
                places = [(t, e - a.first[t] + 1 - run) for e in a.ends[state] for t in [np.searchsorted(a.first, e, "right") - 1]]
                assert sorted(places) == occurs(templates, text[i + 1 - run:i + 1])
        for least in (2, 3):
            whole = {(end, n) for end, n, _ in a.matches(ids, least)}
            assert whole == {(i + 1, n) for i, n in enumerate(best) if n >= least and (i + 1 == len(best) or best[i + 1] != n + 1)}
            cut = {(s + end, n) for s, e in a.stretches(np.array(ids), least) for end, n, _ in a.matches(ids[s:e], least)}
            assert cut == whole  # the words left out change nothing


def shares(spark, texts, **more):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: [(x.label, x.first, x.end, x.covered, x.share) for x in r.spans] for r in licences.scan(frame, **more).collect()}


def test_chains(spark):
    words = [f"w{i}" for i in range(20)]
    made = [("t", " ".join(words))]
    noise = [f"n{i}" for i in range(12)]
    texts = [" ".join(x) for x in (
        words, noise + words + noise, words[:8] + noise + words[8:], words[:8] + noise + ["n"] + words[8:], words[10:] + words[:10],
        words[:9] + ["changed"] + words[10:], words[:2] + noise + words[5:7], words + words)]
    got = shares(spark, texts, templates=made, phrases=())
    assert got[0] == [("t", 0, 20, 20, 1.0)] and got[1] == [("t", 12, 32, 20, 1.0)]
    assert got[2] == [("t", 0, 32, 20, 1.0)]  # twelve words between are still one chain
    assert got[3] == [("t", 0, 8, 8, 0.4), ("t", 21, 33, 12, 0.6)]
    assert got[4] == [("t", 0, 10, 10, 0.5), ("t", 10, 20, 10, 0.5)]  # against the template's order
    assert got[5] == [("t", 0, 20, 19, 0.95)] and got[6] == []
    assert got[7] == [("t", 0, 20, 20, 1.0), ("t", 20, 40, 20, 1.0)]


def test_every_template_is_found_whole(spark):
    got = shares(spark, [f"before it {text} and after" for _, text in licences.TEMPLATES])
    for k, (label, text) in enumerate(licences.TEMPLATES):
        assert any(x[0] == label and x[4] == 1.0 and x[3] == len(WORDS.findall(text.translate(LOWER))) for x in got[k])


def test_query(spark):
    from glasswatch.llm.registry import QUERIES
    got = {r.doc_id: r for r in QUERIES["op12_licence_scan"](spark, LARGER).collect()}
    docs = rows("documents", LARGER)
    assert len(got) == len(docs)
    lines = {"Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache-2.0", "Licensed under CC BY-NC 4.0.": "cc-by-nc",
             "This work is licensed under the GNU General Public License, version 3.": "gpl"}
    for x in docs:
        r = got[x["doc_id"]]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(x["text"])
        want = set(filter(None, r.base_labels.split(","))) | {label for line, label in lines.items() if line in (x["text"] or "")}
        assert r.labels == ",".join(sorted(want)) and 0 <= r.score <= 1


def test_edges(spark):
    docs = edge_docs(spark).withColumn("places", F.lit(1)).withColumn("n_words", F.lit(2))
    got = licences.scan(docs).collect()
    assert sorted((r.n_words, len(r.places)) for r in got) == sorted(base(r.text)[:2] for r in docs.collect())
    assert licences.scan(edge_docs(spark, True)).count() == 0
    long_ = shares(spark, ["All Rights\n\nreserved " * 60_000 + licences.TEMPLATES[0][1]])
    assert [x for x in long_[0] if x[4] == 1.0] == [("apache-2.0", 180_000, 180_008, 8, 1.0)]
