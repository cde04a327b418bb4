"""Substring deduplication with repeated-phrase automata (operator 5).

A word is removed if a window of `n` consecutive words that covers it also starts in a document with a
smaller id. The work goes by blocks of documents, so that what is frequent is counted once per block:

1. Exact copies of whole texts are settled by their digest: only the first copy goes on.
2. Each window has an anchor, the least hash among its 5-grams; equal windows have equal anchors. A block
   sends each of its distinct anchors once; those found in two documents anywhere come back.
3. Windows with such an anchor are found recurring in the same way: each distinct window of a block meets the
   others by its hash. The smallest document that has a recurring window owns it.
4. Owners write out their recurring windows as passages of words. A passage goes to each block that has one of its
   windows in a later document.
5. Each block compiles the passages sent to it, from wherever they come, into Aho-Corasick automata of at most
   `SHARD_WINDOWS` windows, and streams its documents past each. What an automaton finds there, word by word,
   is what is removed; the hashes only choose which passages a block sees.

Two different windows with one 64-bit hash could so hide a passage from a block (at 1e13 windows about 3 in 1e7 are
in such a pair), but never remove a word. One exchange of the texts serves all readings. Blocks have 1 to 4 MB, 1024 of
them in between; no group holds more than one row a block (4e7 at 170 TB).

Defined cases: a null or empty text has no words and stays as it is; texts of fewer than n words lose
nothing; rows with a null id neither lose words nor make others lose any; rows that share an id do not
repeat each other; a very long text makes its block as much larger, and its passages are cut into pieces; an empty table
gives an empty result; all other columns are kept, and `n_words` and `n_removed` are replaced if present.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE_CLASS, as_array, enter, gram_hashes, read, stored, word_bounds, word_hashes

WINDOW = 13
ANCHOR = 5
#: A table is cut into BLOCKS blocks, but none smaller than LEAST_BLOCK or larger than MOST_BLOCK bytes of text.
BLOCKS = 1024
LEAST_BLOCK, MOST_BLOCK = 1 << 20, 4 << 20
#: Windows in one automaton, and in one passage row; longer passages are cut between windows.
SHARD_WINDOWS = 25_000
PASSAGE_WINDOWS = 500
_LOW_CODES = 256
_LOW_CODE, _HIGH_CODE = 0x100, 0x10000
_OTHER = "\x01\x01"


class Block:
    """The documents of a block as one run of words, with what tells apart windows that lie in one document."""

    def __init__(self, table: pa.Table, skip: set[tuple[int, str]], n: int):
        enter("repeats")
        self.n = n
        self.ids = table.column("doc_id").to_pylist()
        texts = [(t or "").encode("utf-8", "replace") for t in table.column("text").to_pylist()]
        marks = table.column("_fp").to_pylist()
        used = np.array([i is not None and (i, m) not in skip for i, m in zip(self.ids, marks, strict=True)], bool)
        begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)])
        self.raw = b"\n".join(texts)
        self.words, self.starts, self.ends = word_hashes(as_array(self.raw))
        first = np.searchsorted(self.starts, begin)  # first word of each document
        m = max(len(self.words) - n + 1, 0)
        of = np.searchsorted(first, np.arange(m), "right") - 1
        self.inside = (first[of + 1] >= np.arange(m) + n) & used[of] if m else np.zeros(0, bool)
        number = np.array([i if i is not None else 0 for i in self.ids], np.int64)
        self.doc = number[of] if m else np.zeros(0, np.int64)

    def anchors(self) -> np.ndarray:
        """The least hash of the 5-grams of each window."""
        grams = gram_hashes(self.words, min(ANCHOR, self.n))
        width, have, out = self.n - min(ANCHOR, self.n) + 1, 1, grams
        while have < width:
            step = min(have, width - have)
            out = np.minimum(out[: len(out) - step], out[step:])
            have += step
        return out

    def windows(self) -> np.ndarray:
        return gram_hashes(self.words, self.n)

    def passages(self, h: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, str, list[int]]]:
        """(owner, words, hashes of the windows) of the runs of windows that a document of the block owns, each window once."""
        wh = self.windows()
        same, at = _member(h, wh)
        own = np.flatnonzero(same & self.inside)
        own = own[owner[at[own]] == self.doc[own]]
        own = np.sort(own[np.unique(wh[own], return_index=True)[1]])
        if not len(own):
            return
        cut = np.flatnonzero((np.diff(own) != 1) | (np.diff(self.doc[own]) != 0)) + 1
        for run in np.split(own, cut):
            for k in range(0, len(run), PASSAGE_WINDOWS):
                part = run[k : k + PASSAGE_WINDOWS]
                text = self.raw[self.starts[part[0]] : self.ends[part[-1] + self.n - 1]]
                yield int(self.doc[part[0]]), b" ".join(text.split()).decode("utf-8", "replace"), wh[part].view(np.int64).tolist()


def _summed(block: int, h: np.ndarray, doc: np.ndarray) -> pa.Table:
    """Each hash once, with the smallest and largest document of the block that has it."""
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(h)) - 1 if len(at) else at
    return pa.table({"h": h[at].view(np.int64), "block": np.full(len(at), block, np.int64), "lo": doc[at], "hi": doc[last]})


def _skips(control: pa.Table) -> set[tuple[int, str]]:
    rows = control.filter(pa.compute.is_valid(control.column("_fp"))) if control.num_rows else control
    return set(zip(rows.column("doc_id").to_pylist(), rows.column("_fp").to_pylist(), strict=True))


def _hashes(control: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The hashes sent to a block, ascending, with the documents beside them (0 where there are none)."""
    rows = control.filter(pa.compute.is_valid(control.column("h"))) if control.num_rows else control
    h = rows.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], rows.column("doc_id").fill_null(0).to_numpy()[order]


def _member(sorted_values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_values):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return sorted_values[at] == x, at


def _code(i: int) -> str:
    """Two characters for the i-th word, of two alphabets that do not meet: a node of the automaton has few children so, and
    no match begins inside a word."""
    high, low = divmod(i, _LOW_CODES)
    return chr(_HIGH_CODE + high) + chr(_LOW_CODE + low)


class Shard:
    """An Aho-Corasick automaton over all windows of some passages, two characters a word."""

    def __init__(self, passages: Iterable[tuple[int, str]], n: int):
        self.n = n
        self.codes: dict[bytes, str] = {}
        self.automaton = ahocorasick.Automaton()
        codes = self.codes
        for owner, words in passages:
            line = []
            for w in words.encode().split():
                if w not in codes:
                    codes[w] = _code(len(codes))
                line.append(codes[w])
            text = "".join(line)
            for k in range(0, len(text) - 2 * n + 2, 2):
                self.automaton.add_word(text[k : k + 2 * n], owner)
        self.automaton.make_automaton()

    def found(self, words: list[bytes], doc_id: int) -> np.ndarray:
        """Last words of the windows that a smaller document owns, ascending."""
        ends: list[int] = []
        if len(self.automaton):
            at = 0
            # Windows lie in runs of words that the passages know.
            for run in "".join(map(self.codes.get, words, repeat(_OTHER))).split(_OTHER):
                if len(run) >= 2 * self.n:
                    ends += [(at + end) // 2 for end, owner in self.automaton.iter(run) if owner < doc_id]
                at += len(run) + len(_OTHER)
        return np.array(ends, np.int64)


def shards(passages: Iterable[tuple[int, str]], n: int, most: int = SHARD_WINDOWS) -> Iterator[Shard]:
    """Automata of at most `most` windows each (one passage at least)."""
    some, size = [], 0
    for owner, words in passages:
        own = words.count(" ") + 2 - n
        if some and size + own > most:
            yield Shard(some, n)
            some, size = [], 0
        some.append((owner, words))
        size += own
    if some:
        yield Shard(some, n)


def located(docs: list[tuple[int, bytes]], passages: Iterable[tuple[int, str]], n: int = WINDOW, most: int = SHARD_WINDOWS) -> dict[int, np.ndarray]:
    """For each document (id, UTF-8 text) in which passages of smaller documents occur, by its place, the mask of covered words."""
    steps: dict[int, np.ndarray] = {}
    for shard in shards(passages, n, most):
        for k, (doc_id, raw) in enumerate(docs):
            words = raw.split()
            if len(words) < n:
                continue
            ends = shard.found(words, doc_id)
            if len(ends):
                if k not in steps:
                    steps[k] = np.zeros(len(words) + 1, np.int32)
                steps[k][ends + 1 - n] += 1
                steps[k][ends + 1] -= 1
    return {k: np.cumsum(x[:-1]) > 0 for k, x in steps.items()}


def _without(raw: bytes, mask: np.ndarray) -> str:
    """The text without the masked words; parts that come together are joined by one space."""
    starts, ends = word_bounds(as_array(raw))
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (~mask).view(np.int8), [0]])))
    runs = zip(starts[edge[::2]].tolist(), ends[edge[1::2] - 1].tolist(), strict=True)
    return b" ".join([raw[s:e] for s, e in runs]).decode("utf-8", "replace")


def remove_repeats(docs: DataFrame, n: int = WINDOW, block_bytes: int | None = None) -> DataFrame:
    """docs with repeated passages taken out of `text`, and `n_words`, `n_removed`.

    Kept words keep the white space between them; parts that come together are joined by one space.
    """
    every = docs.drop("n_words", "n_removed", "_fp", "_block")
    # Rows without an id are not compared; they stay where they are, however many they be.
    docs, aside = every.where(F.col("doc_id").isNotNull()), every.where(F.col("doc_id").isNull())
    n_words = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), SPACE_CLASS + "+"), "")).cast("long")
    aside = aside.withColumns({"n_words": n_words, "n_removed": F.lit(0).cast("long")})
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // (block_bytes or min(max(total // BLOCKS, LEAST_BLOCK), MOST_BLOCK))))
    fp, block = F.md5(F.col("text").cast("binary")), F.pmod(F.xxhash64("doc_id"), F.lit(blocks))
    texts = docs.withColumns({"_fp": fp, "_block": block})
    marks = docs.where(F.octet_length("text") > 0).select("doc_id", fp.alias("_fp"), block.alias("_block"))
    # Stored, so that the join below has an exchange of its own on each side and one digest's many copies can be split.
    least = stored(marks.groupBy("_fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    nothing = {"h": F.lit(None).cast("long"), "words": F.lit(None).cast("string")}
    copies = stored(marks.join(least, "_fp").where("doc_id > least").select("_block", "doc_id", "_fp").withColumns(nothing))

    def anchors(key, left: pa.Table, right: pa.Table) -> pa.Table:
        b = Block(left, _skips(right), n)
        found = _summed(key[0].as_py(), b.anchors()[b.inside] if len(b.inside) else np.zeros(0, np.uint64), b.doc[b.inside])
        several = pa.compute.less(found.column("lo"), found.column("hi"))
        return found.select(["h", "block"]).append_column("several", several)

    def windows(key, left: pa.Table, right: pa.Table) -> pa.Table:
        b = Block(left, _skips(right), n)
        if not len(b.inside):
            return _summed(key[0].as_py(), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        pick = b.inside & _member(_hashes(right)[0], b.anchors())[0]
        return _summed(key[0].as_py(), b.windows()[pick], b.doc[pick])

    def passages(key, left: pa.Table, right: pa.Table) -> pa.Table:
        h, owner = _hashes(right)
        # Only documents that own a window are read again.
        left = left.filter(pa.compute.is_in(left.column("doc_id"), pa.array(np.unique(owner), pa.int64())))
        b = Block(left, set(), n)
        rows = list(b.passages(h, owner)) if len(h) and left.num_rows else []
        kinds = [("pid", pa.int64()), ("owner", pa.int64()), ("words", pa.string()), ("windows", pa.list_(pa.int64()))]
        columns = [[r[2][0] for r in rows], *([r[k] for r in rows] for k in range(3))]
        return pa.table({name: pa.array(c, kind) for (name, kind), c in zip(kinds, columns, strict=True)})

    def clean(key, left: pa.Table, right: pa.Table) -> pa.Table:
        enter("repeats")
        skip = _skips(right)
        sent = right.filter(pa.compute.is_valid(right.column("words"))) if right.num_rows else right
        ids, texts, marks = (left.column(c).to_pylist() for c in ("doc_id", "text", "_fp"))
        raws = [(t or "").encode("utf-8", "replace") for t in texts]
        copy = [(i, m) in skip for i, m in zip(ids, marks, strict=True)]
        rest = [(i, b"" if c else r) for i, r, c in zip(ids, raws, copy, strict=True)]
        masks = located(rest, zip(sent.column("doc_id").to_pylist(), sent.column("words").to_pylist(), strict=True), n)
        sizes, kept, removed = [], [], []
        for k, raw in enumerate(raws):
            size = len(raw.split())
            mask = np.ones(size, bool) if copy[k] and size >= n else masks.get(k)
            sizes.append(size)
            kept.append(texts[k] if mask is None else _without(raw, mask))
            removed.append(0 if mask is None else int(mask.sum()))
        out = left.drop_columns(["_fp", "_block"])
        out = out.set_column(out.schema.get_field_index("text"), "text", pa.array(kept, pa.string()))
        return out.append_column("n_words", pa.array(sizes, pa.int64())).append_column("n_removed", pa.array(removed, pa.int64()))

    same = Window.partitionBy("h")

    def control(rows: DataFrame) -> DataFrame:
        """Rows for a block: the copies it need not read, and hashes or passages with their owners."""
        have = {c: F.col(c) if c in rows.columns else F.lit(None).cast(kind) for c, kind in copies.dtypes}
        return copies.unionByName(rows.select(*[have[c].alias(c) for c in copies.columns]))

    def against(other: DataFrame, fn, schema) -> DataFrame:
        return texts.groupBy("_block").cogroup(other.groupBy("_block")).applyInArrow(fn, schema)

    seen = against(copies, anchors, "h long, block long, several boolean")
    twice = seen.withColumns({"n": F.count(F.lit(1)).over(same), "any": F.bool_or("several").over(same)}).where("n > 1 or any")
    # A window's owner is the smallest document that has it; those with a later one recur.
    own = against(control(twice.select(F.col("block").alias("_block"), "h")), windows, "h long, block long, lo long, hi long")
    own = own.withColumns({"owner": F.min("lo").over(same), "most": F.max("hi").over(same)}).where("owner < most")
    owned = own.where("lo = owner").select(F.col("block").alias("_block"), F.col("owner").alias("doc_id"), "h")
    written = against(control(owned).where("h is not null"), passages, "pid long, owner long, words string, windows array<long>")
    needed = own.where("owner < hi").select("h", "block").join(written.select("pid", F.explode("windows").alias("h")), "h")
    sent = needed.select("pid", F.col("block").alias("_block")).distinct().join(written.select("pid", F.col("owner").alias("doc_id"), "words"), "pid")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    return against(control(sent), clean, schema).unionByName(aside)


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), SPACE_CLASS + "+"), "")
    return docs.select("doc_id", "n_words", "n_removed", F.sha2(F.array_join(words, " "), 256).alias("kept_sha256"))


OP5_SQL = f"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words from documents),
p as (select rid, doc_id, unnest(range(1, len(words) - {WINDOW - 2})) as i, words from d where len(words) >= {WINDOW}),
w as (select rid, doc_id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') as k from p),
r as (select rid, i from (select rid, doc_id, i, min(doc_id) over (partition by k) as least from w) where least < doc_id),
c as (select distinct rid, i + o as i from r, (select unnest(range({WINDOW})) as o)),
g as (select rid, list(i) as gone from c group by rid)
select doc_id, len(words)::bigint as n_words, coalesce(len(gone), 0)::bigint as n_removed,
  sha256(array_to_string(case when gone is null then words else [words[j] for j in range(1, len(words) + 1) if not list_contains(gone, j)] end, ' ')) as kept_sha256
from d left join g using (rid)
"""
