"""Byte-level BPE encoding and decoding by backtracking over longest matches.

Each match of the split pattern is encoded alone.  Its bytes, read as Latin-1, run through an Aho-Corasick automaton of
the vocabulary; from left to right the longest token is taken that may stand after the one before it, with
backtracking to shorter tokens.  Two tokens may be neighbours if merging their bytes by rank would not join or redo
anything across their border; this holds for a whole sequence when it holds for each pair in it, so the sequence found
is the one that rank-ordered merges make.  A place that once failed is never entered again, so the steps are linear in
the bytes.

Nulls: a null text encodes like an empty one, to no ids.  Null ids decode to no bytes.
"""

from __future__ import annotations

import base64
import functools
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from glasswatch.llm.common import query, table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
# Entries of the memo of pieces and of the memo of pairs in one Python worker; a full memo is emptied.
MEMO = 200_000


@functools.cache
def token_bytes(path: str = RANKS) -> list[bytes]:
    """Bytes by rank, all that decoding needs; read once in each Python process."""
    with open(path, "rb") as lines:
        by_rank = {int(b): base64.b64decode(a) for a, b in map(bytes.split, lines)}
    return [by_rank.get(i, b"") for i in range(max(by_rank, default=-1) + 1)]


def joined_bytes(ids: bytes, tokens: list[bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Vocabulary:
    """Ranks of byte strings, with what backtracking needs."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a).decode("latin-1"): int(b) for a, b in map(bytes.split, lines)}
        self.text = {r: t for t, r in self.rank.items()}
        self.bytes = token_bytes(path)
        self.size = [len(b) for b in self.bytes]
        self.most = max(self.size, default=0)
        self.parts: dict[int, tuple[int, int]] = {}  # the last merge that makes a token
        self.joined: dict[tuple[int, int], int] = {}
        self.shorter = [-1] * len(self.bytes)  # the longest proper prefix that is a token too
        self.ends: dict[str, int] = {}  # beginnings of tokens -> the longest token that each starts with
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, bytes] = {}
        for r in sorted(self.text):
            token = self.text[r]
            halves = self._merged(token, r) if len(token) > 1 else [r]
            if len(halves) <= 2:  # else merges alone never make it; only a whole piece can be it
                self.parts[r] = (halves[0], halves[-1])
                if len(halves) == 2:
                    self.joined[halves[0], halves[1]] = r
        self.find = ahocorasick.Automaton()
        for r in self.parts:
            token, held = self.text[r], -1
            self.find.add_word(token, r)
            for n in range(1, len(token)):
                start = self.rank.get(token[:n])
                held = start if start in self.parts else held
                self.ends[token[:n]] = held
            self.shorter[r] = held
            self.ends[token] = r
        self.find.make_automaton()

    def _merged(self, token: str, below: int) -> list[int]:
        """Rank-ordered merges of a vocabulary entry, by ranks under its own."""
        parts = list(token)
        while len(parts) > 1:
            best, at = min((self.rank.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if best >= below:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.rank[p] for p in parts]

    def neighbours(self, left: int, right: int) -> bool:
        """Whether merges keep the border between the two: undo the later merge of the two at the border, again and
        again; no pair that meets there may have a merge due before what was undone last."""
        known = self.pairs.get((left, right))
        if known is not None:
            return known
        a, b, due, fits = left, right, len(self.bytes), True
        while True:
            made = self.joined.get((a, b))
            if made is not None and made < due:
                fits = False
                break
            whole_a, whole_b = self.parts[a][1] == a, self.parts[b][0] == b
            if whole_a and whole_b:
                break
            # The later merge is undone first; of equal ones the right one, as the left one was merged first.
            if whole_b or (a > b and not whole_a):
                due, a = a, self.parts[a][1]
            else:
                due, b = b + 1, self.parts[b][0]
        if len(self.pairs) >= MEMO:
            self.pairs.clear()
        self.pairs[left, right] = fits
        return fits

    def longest(self, piece: str, at: int) -> int:
        """The longest token that starts at a place, or -1: as far as the automaton's trie goes, then back to a token."""
        reach = piece[at:at + self.most]
        return self.ends.get(reach[:self.find.longest_prefix(reach)], -1)

    def encode_piece(self, piece: str) -> list[int]:
        """Token ids of one piece, given as Latin-1."""
        if piece in self.rank:
            return [self.rank[piece]]
        n, size, pairs, shorter, longest = len(piece), self.size, self.pairs, self.shorter, self.longest
        sound = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, token, before = 0, longest(piece, 0), -1
        while at < n:
            while token >= 0:
                end = at + size[token]
                if sound[end]:
                    if before < 0:
                        break
                    fits = pairs.get((before, token))
                    if fits or fits is None and self.neighbours(before, token):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, before = end, token
                token = longest(piece, at) if at < n else -1
            else:
                if before < 0:
                    raise ValueError("the vocabulary lacks single bytes")
                sound[at] = 0
                token = out.pop()
                at -= size[token]
                before = out[-1] if out else -1
        return out

    def encode(self, text: str, pattern) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        memo, out = self.pieces, []
        for piece in pattern.findall(text):
            ids = memo.get(piece)
            if ids is None:
                if len(memo) >= MEMO:
                    memo.clear()
                ids = packed(self.encode_piece(piece.encode().decode("latin-1")))
                if len(piece) < 100:
                    memo[piece] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return joined_bytes(ids, self.bytes)


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str = RANKS) -> Vocabulary:
    """The vocabulary, read once in each Python process."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def encode(text: Column, ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> Column:
    """Ids of each text as binary, four little-endian bytes an id; null and empty texts give an empty binary."""
    @arrow_udf("binary")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        split, words = regex.compile(pattern), vocabulary(ranks)
        for batch in batches:
            yield pa.array((words.encode(t.as_py() or "", split) for t in batch), pa.binary())
    return ids(text)


def decode(ids: Column, ranks: str = RANKS) -> Column:
    """Bytes of each id sequence made by ``encode``."""
    @arrow_udf("binary")
    def raw(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = token_bytes(ranks)
        for batch in batches:
            yield pa.array((joined_bytes(t.as_py() or b"", tokens) for t in batch), pa.binary())
    return raw(ids)


def digests(docs, ranks: str = RANKS):
    """Per document: count and digest of the ids, and digest of the bytes decoded from them."""
    coded = docs.select("doc_id", encode(F.col("text"), ranks).alias("ids"))
    both = coded.select("doc_id", "ids", decode(F.col("ids"), ranks).alias("bytes"))
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


@query("op10_byte_bpe")
def op10(spark, sf):
    """Every document encoded and decoded; no SQL twin (SQL has no merges)."""
    return digests(table(spark, sf, "documents"))
