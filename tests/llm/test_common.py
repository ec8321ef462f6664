"""Hashes of unlike strings differ also where a modulus of two's power makes them equal."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glasswatch.llm import common, ngramlm, quality, repeats
from glasswatch.llm.common import prefix_hash, range_hash, sliding_hash

# The sequence whose n-th letter counts the ones of n, and its complement: equal as polynomials modulo 2**64 from 1,024 letters on.
THUE = "".join("ab"[n.bit_count() & 1] for n in range(2048))
MORSE = THUE.translate(str.maketrans("ab", "ba"))


@given(st.lists(st.integers(0, 255), min_size=1, max_size=40), st.integers(0, 300), st.integers(0, 20))
@settings(deadline=None, max_examples=50)
def test_hash_is_of_the_string_alone(raw, before, after):
    x = np.array(raw, np.uint8)
    rng = np.random.default_rng(before)
    y = np.concatenate((rng.integers(0, 256, before).astype(np.uint8), x, rng.integers(0, 256, after).astype(np.uint8)))
    at = lambda z, a: range_hash(prefix_hash(z), np.array([a]), np.array([a + len(x)]))[0]
    assert at(x, 0) == at(y, before)
    inner = sliding_hash(prefix_hash(y), 0, len(y), len(x))
    assert len(inner) == len(y) - len(x) + 1 and inner[before] == sliding_hash(prefix_hash(x), 0, len(x), len(x))[0]


def test_many_strings_over_stretches():
    rng = np.random.default_rng(4)
    x = rng.integers(97, 100, 3 * common._STRETCH + 17).astype(np.uint8)
    h = sliding_hash(prefix_hash(x), 0, len(x), 12)
    seen = {}
    for k, v in enumerate(h.tolist()):
        assert seen.setdefault(v, bytes(x[k:k + 12])) == bytes(x[k:k + 12])


def test_lines_and_words_of_like_structure():
    got = quality.counts(pa.array([f"{THUE}\n{MORSE}\n{THUE}", " ".join([THUE, MORSE] * 1)]))
    assert got["n_dup_lines"].tolist() == [1, 0] and got["n_stutter"].tolist() == [0, 0]


def test_unlike_texts_are_not_copies(spark):
    rng = np.random.default_rng(7)
    noise = lambda: "".join(map(chr, rng.integers(33, 127, 99)))
    gaps = [noise() for _ in range(1024)]
    docs = [(k, "".join(g + c for g, c in zip(gaps, seq))) for k, seq in enumerate((THUE, MORSE))]
    # Between two letters the texts agree over 99 bytes only.
    got = repeats.remove(spark.createDataFrame(docs, "doc_id int, text string")).collect()
    assert [(r.n_bytes, r.removed) for r in got] == [(102_400, [])] * 2


def test_words_of_the_model_are_told_apart(spark):
    docs = spark.createDataFrame([(0, THUE), (1, THUE), (2, MORSE)], "doc_id int, text string")
    got = {r.doc_id: r.n_known for r in ngramlm.score(docs, docs["doc_id"] < 2).collect()}
    assert got == {0: 2, 1: 2, 2: 1}


def test_a_cluster_needs_shared_storage():
    class Conf:
        def get(self, *_):
            return ""

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://somewhere"})()

    with pytest.raises(ValueError):
        common.shared_folder(Session())
