import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glasswatch.llm import ngramlm as L

from .helpers import LARGER, LOWER, WORD, edge_docs, rows


@pytest.mark.parametrize("n, top", [(1, 5), (1000, 1 << 50), (5000, 6000), (3000, 300), (0, 1)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    x = np.sort(rng.integers(0, top, n).astype(np.uint64))
    coded = L.EliasFano.of(x)
    assert (coded.get(np.arange(n)) == x).all()
    q = rng.integers(0, top + 10, 2000).astype(np.uint64)
    assert (coded.successor(q) == np.searchsorted(x, q)).all()


def test_trie():
    rng = np.random.default_rng(2)
    grams = np.unique(rng.integers(0, 60, (800, 2)), axis=0).astype(np.uint64)
    code = np.arange(1, len(grams) + 1).astype(np.uint16)
    known = {tuple(map(int, g)): int(c) for g, c in zip(grams, code)}
    asked = np.array([(a, b) for a in range(65) for b in range(65)], np.uint64)
    with L.Trie(grams[:, 0], grams[:, 1], code) as trie:
        got = trie.find(asked[:, 0], asked[:, 1])
    assert [int(c) for c in got] == [known.get((int(a), int(b)), 0) for a, b in asked]


def test_quantiser():
    counts = np.array([0, 1, 2, 16383, 16384, 10**6, 10**12])
    assert np.allclose(L.restored(L.quantise(counts)), counts, rtol=4e-4) and (np.diff(L.quantise(counts).astype(int)) > 0).all()


def test_query_against_dictionaries(spark):
    from glasswatch.llm.registry import QUERIES
    got = {r.doc_id: r for r in QUERIES["op1_ngram_lm"](spark, LARGER).collect()}
    tokens = {x["doc_id"]: WORD.findall((x["text"] or "").translate(LOWER)) + [None] for x in rows("documents", LARGER)}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    one, two, three = (collections.Counter() for _ in range(3))
    for i, w in tokens.items():
        if not held[i]:
            one.update(w)
            two.update(zip(w, w[1:]))
            three.update(zip(w, w[1:], w[2:]))
    n, v = sum(one.values()), len(one)
    sums = collections.Counter()
    assert set(got) == set(tokens)
    for i, w in tokens.items():
        base = model = 0.0
        for k, x in enumerate(w):
            p = (one[x] + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(p)
            if k > 0:
                p = (two[w[k - 1], x] + L.MU2 * p) / (one[w[k - 1]] + L.MU2)
            if k > 1:
                p = (three[w[k - 2], w[k - 1], x] + L.MU3 * p) / (two[w[k - 2], w[k - 1]] + L.MU3)
            model += math.log10(p)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w), sum(one[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, model, rel_tol=1e-3)
        sums[held[i]] += r.score - r.base_score
    assert sums[True] > 0 and sums[False] > 0  # better than single words, on texts it has not seen too


def test_smoothed_probabilities_sum_to_one():
    one, two, three = collections.Counter("aabbbc"), collections.Counter(zip("aabbb", "abbbc")), collections.Counter(zip("aabb", "abbb", "bbbc"))
    n, v = 6, 3
    p1 = {w: (one[w] + 0.5) / (n + 0.5 * (v + 1)) for w in "abc?"}
    ends = {x: sum(c for (a, _), c in two.items() if a == x) for x in "ab"}
    p2 = {w: (two["b", w] + L.MU2 * p1[w]) / (ends["b"] + L.MU2) for w in p1}
    follow = sum(c for (a, b, _), c in three.items() if (a, b) == ("b", "b"))
    assert math.isclose(sum(p1.values()), 1) and math.isclose(sum(p2.values()), 1)
    assert math.isclose(sum((three["b", "b", w] + L.MU3 * p2[w]) / (follow + L.MU3) for w in p1), 1)


def test_blocks_and_shards_do_not_matter(spark):
    docs = spark.createDataFrame([(1, None), (None, "a b"), (2, "A b c"), (2, "a b c"), (3, "a b c a b c")], "doc_id int, text string")
    ways = [sorted(map(str, L.score(docs, ~L.held_out(), size=size, shard_size=shard).collect())) for size, shard in ((1 << 20, 10**6), (1, 2))]
    assert ways[0] == ways[1] and len(ways[0]) == 5
    assert L.score(docs.limit(0), ~L.held_out()).collect() == []
    assert {(r.base_score, r.score, r.train_tokens) for r in L.score(docs, F.lit(False)).collect()} == {(0.0, 0.0, 0)}


def test_edges(spark):
    got = L.score(edge_docs(spark), ~L.held_out()).collect()
    assert len(got) == 7 and sorted(r.n_tokens for r in got)[:4] == [1, 1, 1, 1]


def test_unknown_words_are_not_sent():
    pack = lambda x, t: L._pack(np.array(x, t))
    import pyarrow as pa
    row = {"numbers": pa.scalar(pack([0, L.UNKNOWN, L.UNKNOWN, 1], np.uint32), pa.binary()), "tokens": pa.scalar(pack([0, 3, 0, 1, 2, 0, 3], np.uint32), pa.binary()),
           "lengths": pa.array([3, 4]), "train": pa.array([True, False])}
    grams = L._Grams(row, (np.array([2, 1]), np.array([0, 1, 2])), 1, 100.0)
    assert len(grams.order) and not any((c == L.UNKNOWN).any() for c in grams.columns[1:4])
    codes = np.zeros(len(grams.order), np.uint16)
    assert [len(x) for x in grams.scores(codes, codes, 3, 2)] == [2, 2, 2]
