"""Byte-level BPE encoding and decoding (operator 6).

A text is cut by the vocabulary's pattern and each piece encoded in linear time: pyahocorasick finds,
over the piece's bytes written as Latin-1, the longest token that starts at each place; the encoder
takes longest matches and steps back to shorter ones wherever the last token and the next could not
stand side by side after merging. Whether two tokens can is worked out from the merges that made them
and kept. The result is that of applying the merges in rank order. That longest matches and steps back suffice is known from
the open-source crate `bpe` (MIT licence); the code here is its own.

Encoding is a function of one row: one read of the table, nothing shuffled. A worker keeps the ids of up
to `KEPT_PIECES` pieces and `KEPT_BYTES` bytes, and the tables of the vocabulary.

Defined cases: a null text is empty and has no ids; repeated rows are encoded alike; an empty table gives
an empty result; further columns of the input are kept by `encode`, clashing names replaced.
"""

from __future__ import annotations

import base64
import hashlib
from functools import cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import enter, on_leave, read, slices

#: Pieces whose ids a worker keeps, their bytes in all, and the longest that is kept.
KEPT_PIECES = 400_000
KEPT_BYTES = 16 << 20
KEPT_LENGTH = 256
KEPT_PAIRS = 700_000
_NEVER = 1 << 62


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a file of base64 tokens and ranks, as the session's workers see it."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class BytePairs:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        order = sorted(self.tokens)
        prefix = {}
        for i in order:
            token = self.tokens[i]
            prefix[i] = next((ranks[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in ranks), None)
        self.prefix = prefix
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.reachable = set()
        for i in order:
            self._learn(i)
            token = self.tokens[i]
            if len(token) == 1 or self.parts[i] != (i, i):
                automaton.add_word(token.decode("latin-1"), i)
                self.reachable.add(i)
        self._pairs.clear()
        automaton.make_automaton()
        self.automaton = automaton
        self.size = {i: len(t) for i, t in self.tokens.items()}
        self._ids: dict[str, bytes] = {}
        self._bytes = 0

    def _learn(self, i: int) -> None:
        """The two tokens whose merge gives token i; itself twice if no merge does."""
        token, left = self.tokens[i], self.prefix[i]
        while left is not None:
            right = self.ranks.get(token[self.size_of(left) :])
            if right is not None and left < i and right < i and self._fit(left, right):
                self.merged[left, right] = i
                self.parts[i] = (left, right)
                return
            left = self.prefix[left]
        self.parts[i] = (i, i)

    def size_of(self, i: int) -> int:
        return len(self.tokens[i])

    def _border(self, i: int, side: int) -> list[tuple[int, int]]:
        """Tokens that stood at one end of token i while it was put together (side 1: its right end, 0: its left), the
        latest first, each with the merge that took it up."""
        out, until = [], _NEVER
        while True:
            out.append((i, until))
            inner = self.parts[i][side]
            if inner == i:
                return out
            i, until = inner, i

    def _fit(self, a: int, b: int) -> bool:
        """Whether a and b can be neighbours: while they were put together, nothing across their border could merge first.

        A merge across would have come before both merges that took up its halves; of two of one rank the left one comes first.
        """
        right = self._border(b, 0)
        for x, taken in self._border(a, 1):
            for y, gone in right:
                joint = self.merged.get((x, y))
                if joint is not None and joint < taken and joint <= gone:
                    return False
        return True

    def neighbours(self, a: int, b: int) -> bool:
        known = self._pairs.get((a, b))
        if known is None:
            if len(self._pairs) > KEPT_PAIRS:
                self._pairs.clear()
            known = self._pairs[a, b] = self._fit(a, b)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        size, prefix, pairs = self.size, self.prefix, self._pairs
        n = len(piece)
        longest: list[int | None] = [None] * n
        for end, i in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - size[i]] = i
        open_at = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0] if n else None
        while token is not None:
            last = out[-1] if out else None
            while True:
                end = at + size[token]
                if open_at[end] and (last is None or pairs.get((last, token)) or ((last, token) not in pairs and self.neighbours(last, token))):
                    out.append(token)
                    at = end
                    token = longest[at] if at < n else None
                    break
                shorter = prefix[token]
                while shorter is not None and shorter not in self.reachable:
                    shorter = prefix[shorter]
                if shorter is not None:
                    token = shorter
                    continue
                # Nothing fits here: this place is closed and the last token tried shorter.
                open_at[at] = 0
                token = out.pop()
                at -= size[token]
                break
        return out

    def encode_text(self, text: str | None, pattern: regex.Pattern) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        pieces = pattern.findall(text or "")
        known = self._ids
        if len(known) > KEPT_PIECES or self._bytes > KEPT_BYTES:
            known.clear()
            self._bytes = 0
        own: dict[str, bytes] = {}
        for p in set(pieces).difference(known):
            ids = np.array(self.encode_piece(p.encode()), "<u4").tobytes()
            if len(p) <= KEPT_LENGTH and len(known) <= KEPT_PIECES:
                known[p] = ids
                self._bytes += len(p) + len(ids)
            else:
                own[p] = ids
        return b"".join([known[p] if p in known else own[p] for p in pieces] if own else [known[p] for p in pieces])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@cache
def codec(path: str) -> BytePairs:
    return BytePairs(load_ranks(path))


@cache
def compiled(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


on_leave("bpe", codec.cache_clear)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs with `ids` (array of int) and `decoded` (binary) of each whole text."""

    @F.pandas_udf("ids array<int>, decoded binary")
    def run(texts: pd.Series) -> pd.DataFrame:
        enter("bpe")
        c, p = codec(path), compiled(pattern)
        ids = [c.encode_text(t, p) for t in texts]
        return pd.DataFrame({"ids": [np.frombuffer(x, "<u4").astype(np.int32) for x in ids], "decoded": [c.decode(x) for x in ids]})

    return docs.drop("ids", "decoded").withColumn("_e", run("text")).select("*", "_e.ids", "_e.decoded").drop("_e")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs with `n_tokens` and the SHA-256 of ids and of decoded bytes; the ids stay in the worker."""

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(texts: pa.Array) -> pa.Array:
        enter("bpe")
        c, p = codec(path), compiled(pattern)
        sizes, first, second = [], [], []
        for t in (t for part in slices(texts) for t in part):
            ids = c.encode_text(t, p)
            sizes.append(len(ids) // 4)
            first.append(hashlib.sha256(ids).hexdigest())
            second.append(hashlib.sha256(c.decode(ids)).hexdigest())
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.withColumn("_d", run("text")).select("*", "_d.*").drop("_d")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).drop("text")
