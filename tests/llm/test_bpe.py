import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from glasswatch.llm import bpe

from .helpers import SMALL, edge_docs, rows

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.RANKS, "rb"))}
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
SPLIT = regex.compile(public_tokenizers.PATTERN)


def agree(text):
    raw = bpe.vocabulary().encode(text, SPLIT)
    assert np.frombuffer(raw, "<u4").tolist() == TIKTOKEN.encode_ordinary(text)
    assert bpe.vocabulary().decode(raw) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    agree(text)


def test_texts_of_tokens_and_long_runs():
    rng = random.Random(3)
    tokens = [t.decode("utf8", "ignore") for t in RANKS]
    for _ in range(3000):
        agree("".join(rng.choice(tokens) for _ in range(rng.randint(1, 5))))
    for text in ("a" * 20_000, " " * 5_000, "ab" * 10_000, "é" * 3_000, "", "\x00"):
        agree(text)


def test_query(spark):
    from glasswatch.llm.registry import QUERIES
    got = {r.doc_id: r for r in QUERIES["op10_byte_bpe"](spark, SMALL).collect()}
    docs = rows("documents")
    assert len(got) == len(docs)
    for x in docs:
        ids = TIKTOKEN.encode_ordinary(x["text"] or "")
        r = got[x["doc_id"]]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((x["text"] or "").encode()).hexdigest()


def test_edges(spark):
    got = bpe.digests(edge_docs(spark)).collect()
    assert len(got) == 7 and sorted(r.n_tokens for r in got)[:3] == [0, 0, 0]
    assert bpe.digests(edge_docs(spark, empty=True)).collect() == []


def test_the_longest_token_is_found_in_one_step():
    v, rng = bpe.vocabulary(), random.Random(5)
    for _ in range(2000):
        piece = "".join(rng.choice(list(v.text.values())) for _ in range(3))
        want = next((v.rank[piece[:n]] for n in range(min(len(piece), v.most), 0, -1) if v.rank.get(piece[:n]) in v.parts), -1)
        assert v.longest(piece, 0) == want
    # before: stepped back byte by byte through beginnings that are no tokens
    assert all(token[:n] in v.ends for token in map(v.text.get, v.parts) for n in range(1, len(token) + 1))


def test_decoding_needs_no_vocabulary(monkeypatch):
    raw = bpe.vocabulary().encode("some text", SPLIT)
    monkeypatch.setattr(bpe, "Vocabulary", None)  # before: every decoding worker built one
    assert bpe.joined_bytes(raw, bpe.token_bytes.__wrapped__(bpe.RANKS)) == b"some text"
