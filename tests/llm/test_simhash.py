import random

import numpy as np
import xxhash

from glasswatch.llm import components, simhash

from .helpers import LARGER, LOWER, WORD, edge_docs, rows


def fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(ids, fps):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    f = np.array(fps, np.uint64)
    for k in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(f[k + 1:] ^ f[k]) <= 2).tolist():
            a, b = root(ids[k]), root(ids[k + 1 + j])
            parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_code_is_perfect():
    x = np.random.default_rng(1).integers(0, 1 << 23, 20_000, dtype=np.uint64)
    c = simhash.nearest(x)
    assert np.bitwise_count(x ^ c).max() == 3 and not simhash._syndrome(c).any()


def test_every_near_pair_meets_at_an_anchor():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 3), replace=False)) for _ in x], np.uint64)
    row, at = simhash.anchors_near(x ^ flips)
    own = simhash.anchor(x)
    assert all(own[k] in set(at[row == k].tolist()) for k in range(len(x)))


def test_query(spark):
    from glasswatch.llm.registry import QUERIES
    got = {r.doc_id: r for r in QUERIES["op5_simhash"](spark, LARGER).collect()}
    docs = rows("documents", LARGER)
    ids = sorted(x["doc_id"] for x in docs)
    fps = {x["doc_id"]: fingerprint(x["text"]) for x in docs}
    assert len(got) == len(ids)
    assert all(int(got[i].fingerprint, 16) == fps[i] and len(got[i].fingerprint) == 16 for i in ids)
    assert {i: got[i].component_id for i in ids} == groups(ids, [fps[i] for i in ids])


def test_dense_anchor_is_split(spark):
    rng = random.Random(4)
    base, fps = rng.getrandbits(63), set()
    for _ in range(400):  # one cloud: everything near one point
        x = base
        for _ in range(rng.randint(0, 5)):
            x ^= 1 << rng.randint(46, 62)
        fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    found = simhash.links(df, part=16)
    assert found.count() < len(fps) ** 2 / 8
    got = {r.node: r.root for r in components.components(found).collect()}
    want = groups(fps, fps)
    assert all(got.get(x, x) == want[x] for x in fps)


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (200, 200), (None, 5)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100, 200: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_edges(spark):
    got = simhash.near_duplicates(edge_docs(spark)).collect()
    assert len(got) == 7 and {r.component_id for r in got if r.fp == 0} == {1} and sum(r.fp == 0 for r in got) == 4
    assert simhash.near_duplicates(edge_docs(spark, empty=True)).collect() == []
