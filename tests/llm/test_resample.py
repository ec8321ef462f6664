import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from glasswatch.llm import resample

from .helpers import LOWER, SMALL, edge_docs, rows

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text):
    w = WORDS.findall((text or "").translate(LOWER))
    return w, [" ".join(w[i:i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(docs, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = collections.Counter(), collections.Counter()
    for _, text in docs:
        s.update(map(bucket, grams(text)[1]))
    for text in target:
        t.update(map(bucket, grams(text)[1]))
    S, T = sum(s.values()), sum(t.values())
    out = []
    for i, text in docs:
        w, f = grams(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in map(bucket, f))
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in out if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    drawn = able[:5 * len(able) // 100]
    return out, drawn


def test_crc_of_joined_strings():
    rng = random.Random(1)
    parts = [(rng.randbytes(rng.randint(0, 90)), rng.randbytes(rng.choice([0, 1, 5, 63, 64, 65, 1000, 70_001]))) for _ in range(60)]
    got = resample.shifted(np.array([zlib.crc32(a) for a, _ in parts], np.uint32), np.array([len(b) for _, b in parts])) ^ np.array(
        [zlib.crc32(b) for _, b in parts], np.uint32)
    assert got.tolist() == [zlib.crc32(a + b) for a, b in parts]


def test_features_stay_in_their_text():
    texts = ["One two", None, "", "three", "Ünïcode Ça va_bien 12\n34", "--", "x" * 200 + " y z"]
    n, owner, marks = resample.Counter().features(pa.array(texts))
    assert n.tolist() == [len(grams(t)[0]) for t in texts]
    for k, t in enumerate(texts):
        assert sorted(marks[owner == k].tolist()) == sorted(zlib.crc32(f.encode()) % 10000 for f in grams(t)[1])


def test_query(spark):
    from glasswatch.llm.registry import QUERIES
    docs = [(x["doc_id"], x["text"]) for x in rows("documents")]
    want, drawn = brute(docs, [x["text"] for x in rows("benchmark")])
    got = {r.doc_id: r for r in QUERIES["op13_importance_resample"](spark, SMALL).collect()}
    assert {i: (r.n_words, r.n_features, r.weight, r.score) for i, r in got.items()} == {x[0]: x[1:] for x in want}
    assert [i for _, i in sorted((r.rank, i) for i, r in got.items() if r.rank)] == [x[0] for x in drawn] and drawn
    assert sorted(r.rank for r in got.values() if r.rank) == list(range(1, len(drawn) + 1))


def test_edges_and_ties(spark):
    target = spark.createDataFrame([("the first text",), (None,), ("",)], "text string")
    docs = edge_docs(spark).unionByName(edge_docs(spark).withColumn("text", F.lit("one and the same text " * 10)))
    rows_ = [(r.doc_id, r.text) for r in docs.collect()]
    want, _ = brute(rows_, ["the first text", None, ""])
    for percent in (100, 50, 0):
        got = resample.resample(docs, target, percent=percent).collect()
        show = lambda x: sorted(x, key=lambda r: [(v is not None, v or 0) for v in r])
        assert show([(r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in got]) == show(want)
        able = [r for r in got if r.n_words >= 20]
        drawn = sorted((r for r in able if r.rank is not None), key=lambda r: r.rank)
        assert [r.rank for r in drawn] == list(range(1, percent * len(able) // 100 + 1))
        assert all((-a.score, a.doc_id is None, a.doc_id or 0) <= (-b.score, b.doc_id is None, b.doc_id or 0) for a, b in zip(drawn, drawn[1:]))
    assert resample.resample(edge_docs(spark, True), target).count() == 0
    assert resample.resample(docs, target.where("false")).count() == docs.count()
