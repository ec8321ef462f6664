import collections
import hashlib
import random
import re

import numpy as np

from glasswatch.llm import repeats

from .helpers import SMALL, edge_docs, rows


def brute(texts, length):
    raws, seen = [(t or "").encode() for t in texts], collections.defaultdict(list)
    for i, raw in enumerate(raws):
        for p in range(len(raw) - length + 1):
            seen[raw[p:p + length]].append((i, p))
    gone = [bytearray(len(raw)) for raw in raws]
    for where in seen.values():
        for i, p in where if len(where) > 1 else ():
            gone[i][p:p + length] = b"\1" * length
    return [(len(raw), g.count(1), len(re.findall(b"\1+", bytes(g))), hashlib.sha256(bytes(x for x, k in zip(raw, g) if not k)).hexdigest())
            for raw, g in zip(raws, gone)]


def test_against_brute_force(spark):
    rng = random.Random(5)
    pool = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(10, 80))) for _ in range(40)]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 8))) for _ in range(120)]
    texts += ["a" * 300, "a" * 90, "ab" * 100, None, "", "xyz", texts[3], texts[5]]
    texts += ["".join(rng.choice("ab") for _ in range(200)) for _ in range(8)]
    want = brute(texts, 40)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for members in (2048, 1):  # compared in tasks, and counted by Spark
        got = {r.doc_id: (r.n_bytes, r.n_bytes - len(r.kept), len(r.removed), hashlib.sha256(bytes(r.kept)).hexdigest())
               for r in repeats.remove(docs, length=40, seed=8, members=members).collect()}
        assert [got[k] for k in range(len(texts))] == want


def test_query(spark):
    from glasswatch.llm.registry import QUERIES
    docs = rows("documents")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op4_repeated_substrings"](spark, SMALL).collect()}
    want = brute([x["text"] for x in docs], 400)
    assert [got[x["doc_id"]] for x in docs] == want and any(w[1] for w in want)


def test_each_string_has_its_first_least_seed():
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 50, 500).astype(np.uint64) << np.uint64(40)  # many ties
    width = 40 - 8 + 1
    said = {}
    for at, least, most in zip(*repeats.anchors(seeds, 40, 8)):
        for o in range(least, most + 1):
            assert at - o not in said
            said[at - o] = at
    assert said == {s: s + int(seeds[s:s + width].argmin()) for s in range(len(seeds) - width + 1)}


def test_edges(spark):
    got = repeats.remove(edge_docs(spark)).collect()
    assert len(got) == 7 and sorted(r.n_bytes for r in got)[:3] == [0, 0, 0]
    assert next(len(r.kept) for r in got if r.doc_id == 4) < 500  # one word over and over
    assert repeats.remove(edge_docs(spark, empty=True)).collect() == []


def test_copies_send_their_surroundings_once(spark, monkeypatch):
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefgh ") for _ in range(300))
    texts = [text] * 50 + [text[:150] + "#" + text[151:]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    sent, around = [], repeats._around
    monkeypatch.setattr(repeats, "_around", lambda *args: sent.append(around(*args)) or sent[-1])
    got = {r.doc_id: hashlib.sha256(bytes(r.kept)).hexdigest() for r in repeats.remove(docs, length=40, seed=8).collect()}
    assert [got[k] for k in range(51)] == [w[3] for w in brute(texts, 40)]
    read = [r for x in sent for r in x.collect()]
    assert len(read) == len({(r.cls, r.ctx) for r in read}) > 0
