"""Harmonic packing of tokenised documents into fixed-size sequences (operator 9).

A piece of r tokens belongs to class k, where k pieces of its size fit a sequence but k + 1 do not; every
bin of class k takes exactly k pieces, so workers fill bins knowing only how many pieces come before
theirs in the class. A piece that would waste more than `tolerance` of its size in its class is cut at
the largest floor(capacity / k) it reaches, and its rest is classed again; whole capacities are cut off
first. At the end each class leaves fewer than k pieces over, less than a bin. In runs of an eighth of a bin at most, or of
one piece, these are packed by best fit: only the sizes of the runs, eight a class at most (`PARTS`), come together.

Tokens are made once, in the worker that cuts and digests them; what moves is one narrow row per piece.
Numbering within a class goes by blocks of documents, and by groups of blocks, so a class with most of the rows is still
dealt out, and so are rows of one id with different texts.

Defined cases: a null or empty text has only the end id; repeated rows are packed each for themselves;
rows with equal ids are told apart by content only, and may swap places when equal; an empty table gives
an empty result; other columns are not read, and clashing names are replaced.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import enter, on_leave, read, stored

CAPACITY = 4096
TOLERANCE = 0.02
END_ID = 2
#: Words whose ids a worker keeps, at about 150 bytes each: fewer cost seconds, not results.
KEPT_WORDS = 1_500_000
#: Texts whose new words are encoded in one call.
TOGETHER = 200
BLOCK_PIECES = 20_000
#: Blocks whose counts are summed together.
GROUP_BLOCKS = 1024
#: Runs into which what a class leaves over is cut, but for classes of larger pieces.
PARTS = 8
#: White space as the vocabulary's normaliser sees it.
_WORDS = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, block_key long"


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordTokens:
    """Ids of texts for a vocabulary that drops white space: a text's ids are those of its words in turn."""

    def __init__(self, path: str, kept_words: int = KEPT_WORDS):
        self.tokenizer = _tokenizer(path)
        self.kept_words = kept_words
        self.known: dict[str, bytes] = {}

    def texts(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        known = self.known
        for a in range(0, len(texts), TOGETHER):
            words = [_WORDS.findall(t or "") for t in texts[a : a + TOGETHER]]
            new = set().union(*words).difference(known)
            if new:
                if len(known) + len(new) > self.kept_words:
                    known.clear()
                    new = set().union(*words)
                self._learn(new)
            for w in words:
                yield b"".join([known[x] for x in w])

    def _learn(self, new: set[str]) -> None:
        """Ids of new words. A full stop or comma after an ASCII letter or digit is a token of its own, so such
        a word's ids are those of its stem and of the mark."""
        known = self.known
        marked = [w for w in new if w[-1] in ",." and len(w) > 1 and w[-2].isascii() and w[-2].isalnum()]
        stems = new.difference(marked)
        stems.update(w[:-1] for w in marked)
        stems.update(w[-1] for w in marked)
        batch = [w for w in stems if w not in known]
        for w, e in zip(batch, self.tokenizer.encode_batch_fast(batch, add_special_tokens=False), strict=True):
            known[w] = np.array(e.ids, "<u4").tobytes()
        for w in marked:
            known[w] = known[w[:-1]] + known[w[-1]]


@cache
def _words(path: str, kept_words: int) -> WordTokens:
    return WordTokens(path, kept_words)


def _forget() -> None:
    _words.cache_clear()
    _tokenizer.cache_clear()


on_leave("packing", _forget)


def cuts(n: int, capacity: int = CAPACITY, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(length, class) of the pieces of n tokens, in order."""
    out = [(capacity, 1)] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        if capacity / k - rest <= tolerance * rest:
            out.append((rest, k))
            break
        k = -(-capacity // rest)
        size = capacity // k
        out.append((size, k))
        rest -= size
    return out


def pieces(docs: DataFrame, path: str, end_id: int | None = END_ID, capacity: int = CAPACITY, tolerance: float = TOLERANCE, kept_words: int = KEPT_WORDS) -> DataFrame:
    """One row per piece of each document's ids."""
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    names = [x.split()[0] for x in _PIECES.split(", ")]

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("packing")
        for batch in it:
            for a in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(a, TOGETHER)
                doc_ids, keys, texts = (part.column(c).to_pylist() for c in ("doc_id", "block_key", "text"))
                rows = []
                for i, key, ids in zip(doc_ids, keys, _words(path, kept_words).texts(texts), strict=True):
                    ids += end
                    at, n = 0, len(ids) // 4
                    for size, k in cuts(n, capacity, tolerance):
                        rows.append((i, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), n, k, key))
                        at += size
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("block_key"))
    return keyed.mapInArrow(cut, _PIECES)


def best_fit(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each size: the largest first, each to the fullest bin that still takes it."""
    rooms: list[tuple[int, int]] = []  # (room, bin), ascending
    out: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    bins = 0
    for at in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        k = bisect_left(rooms, (sizes[at], -1))
        room, own = rooms.pop(k) if k < len(rooms) else (capacity, bins)
        bins = max(bins, own + 1)
        out[at] = own, capacity - room
        insort(rooms, (room - sizes[at], own))
    return out


def _table(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.Table:
    """A few rows of the driver; as an Arrow table they reach Spark without Python workers."""
    return pa.table({name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(kinds.items())})


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with `sequence_id` and `offset`; cut is a stored table of pieces."""
    spark = cut.sparkSession
    n = cut.select(F.count(F.lit(1))).first()[0]
    blocks = max(1, n // BLOCK_PIECES)
    dealt = cut.withColumn("block", F.pmod("block_key", F.lit(blocks)))
    # How many pieces of the class come before each block: one row per class and block, summed by groups of blocks first.
    counts = dealt.groupBy("class", "block").agg(F.count(F.lit(1)).alias("n")).withColumn("above", F.floor(F.col("block") / GROUP_BLOCKS))
    upper = counts.groupBy("class", "above").agg(F.sum("n").alias("m"))
    upper = upper.withColumn("earlier", F.sum("m").over(Window.partitionBy("class").orderBy("above")) - F.col("m")).drop("m")
    inside = F.sum("n").over(Window.partitionBy("class", "above").orderBy("block")) - F.col("n")
    before = counts.withColumn("inside", inside).join(upper, ["class", "above"]).select("class", "block", (F.col("earlier") + F.col("inside")).alias("before"))
    # Classes are at most as many as the capacity. Sequence numbers of a class follow those of the one before.
    totals = sorted((r["class"], r["n"]) for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect())
    bins = [n // k for k, n in totals]
    first = np.concatenate([[0], np.cumsum(bins)]).astype(int).tolist()
    classes = [(k, n - n % k, a) for (k, n), a in zip(totals, first, strict=False)]
    classes = spark.createDataFrame(_table(classes, {"class": pa.int32(), "full": pa.int64(), "first": pa.int64()}))
    own = Window.partitionBy("class", "block").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    numbered = dealt.withColumn("own", F.row_number().over(own) - 1).join(before, ["class", "block"]).join(F.broadcast(classes), "class")
    numbered = numbered.withColumn("place", F.col("own") + F.col("before"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    kept = numbered.where(F.col("place") < F.col("full")).withColumn("sequence_id", F.col("first") + F.floor(F.col("place") / F.col("class")))
    up_to = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    kept = kept.withColumn("offset", F.coalesce(F.sum("length").over(up_to), F.lit(0))).select(*names)
    # A class leaves less than a bin over. In runs of at most 1/PARTS of a bin, or of one piece, it is packed by the runs' sizes alone.
    left = numbered.where(F.col("place") >= F.col("full")).withColumn("run", F.floor((F.col("place") - F.col("full")) / F.greatest(F.floor(F.col("class") / PARTS), F.lit(1))))
    runs = sorted(tuple(r) for r in left.groupBy("class", "run").agg(F.sum("length").alias("size")).collect())
    placed = [(k, r, first[-1] + b, at) for (k, r, _), (b, at) in zip(runs, best_fit([size for _, _, size in runs], capacity), strict=True)]
    where = spark.createDataFrame(_table(placed, {"class": pa.int32(), "run": pa.int64(), "sequence_id": pa.int64(), "begin": pa.int64()}))
    in_run = Window.partitionBy("class", "run").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rest = left.withColumn("inside", F.coalesce(F.sum("length").over(in_run), F.lit(0))).join(F.broadcast(where), ["class", "run"])
    rest = rest.withColumn("offset", F.col("begin") + F.col("inside"))
    return kept.unionByName(rest.select(*names)).select(*[F.col(c).cast("long") for c in names])


def packed(docs: DataFrame, path: str, kept_words: int = KEPT_WORDS) -> DataFrame:
    return pack(stored(pieces(docs, path, kept_words=kept_words)))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
