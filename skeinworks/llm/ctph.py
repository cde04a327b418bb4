"""Document fingerprints by context-triggered piecewise hashing (operator 2).

A hash over the last seven bytes decides where chunks end: at block size b, where it is -1 modulo b. Each
chunk gives one of 64 letters, so an edit changes the letters of the chunks it touches only. A fingerprint
holds the smallest block size (3 * 2**i) that leaves at most 64 letters, and the letters at it and at the
next two sizes. Two fingerprints are compared at the block sizes they share, by edit distance.

The next document of each one, by descending id, is found without a total sort on one machine: ranges of
ids are dealt out, and the first row of each range is also sent to the range that precedes it. An id (or none) that
fills several ranges is cut by the first bytes of its texts. The text moves once.

Defined cases: a null or empty text has an empty fingerprint, like only to another empty one; equal ids
follow each other by text, null ids come last; the next document of the last is the first, of an only
document itself; an empty table gives an empty result; other columns are not read by the query.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _BASE, _BYTE, _INV, _powers, as_array, enter, mix, read, utf8

SPAN = 7
LETTERS = 64
LEVELS = 3
LEAST_BLOCK = 3
COMMON_RUN = 4
#: Bytes of text hashed at once.
SEGMENT = 1 << 18
RANGE_BYTES = 4 << 20
MOST_RANGES = 65536
_ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_ROLL = np.random.default_rng(20).integers(0, 2**31, SPAN, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_BYTE32 = np.random.default_rng(21).integers(0, 2**32, 256, dtype=np.uint32)
_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def rolling(raw: np.ndarray) -> np.ndarray:
    """Hash of the last SPAN bytes at each place."""
    values = _BYTE32[raw]
    out = values * _ROLL[0]
    for k in range(1, min(SPAN, len(raw))):
        out[k:] += values[:-k] * _ROLL[k]
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x2C1B3C6D)
    out ^= out >> np.uint32(12)
    return out


def _ends(data: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in [a, b) where a chunk may end, and how many doublings of the least block size each of them serves."""
    before = min(a, SPAN - 1)
    t = rolling(data[a - before : b])[before:] + np.uint32(1)
    at = np.flatnonzero(t % np.uint32(LEAST_BLOCK) == 0)
    low = t[at]
    low = low & (~low + np.uint32(1))
    return at + a, np.where(low == 0, 32, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64))


def fingerprint(raw: bytes) -> str:
    """Long texts are read twice, segment by segment: for the block size, then for the chunks."""
    if not raw:
        return ""
    data, n = as_array(raw), len(raw)
    cuts = [(a, min(a + SEGMENT, n)) for a in range(0, n, SEGMENT)]
    first = _ends(data, *cuts[0])
    reach = sum(np.bincount((first if not a else _ends(data, a, b))[1], minlength=33) for a, b in cuts)[::-1].cumsum()[::-1]
    level = int(np.argmax(reach <= LETTERS - 1)) if (reach <= LETTERS - 1).any() else 32
    ends, power, totals, base = [], [], [], 0
    for a, b in cuts:
        at, own = first if not a else _ends(data, a, b)
        total = np.cumsum(_BYTE[data[a:b]] * _powers(_BASE, b - a, "up")) * np.uint64(pow(_BASE, a, 2**64)) + np.uint64(base)
        at, own = at[own >= level], own[own >= level]
        ends.append(at + 1)
        power.append(own)
        totals.append(total[at - a])
        base = int(total[-1])
    ends, power, totals = (np.concatenate(x) for x in (ends, power, totals))
    parts = [str(LEAST_BLOCK << level)]
    for i in range(level, level + LEVELS):
        pick = power >= i
        at, total = ends[pick], totals[pick]
        if not len(at) or at[-1] != n:
            at, total = np.append(at, n), np.append(total, np.uint64(base))
        begins = np.concatenate([[0], at[:-1]])
        inverse = _powers(_INV, n + 1, "down")[begins] if n <= SEGMENT else np.array([pow(_INV, int(x), 2**64) for x in begins], np.uint64)
        sums = np.diff(np.concatenate([np.zeros(1, np.uint64), total]))
        own = mix((sums * inverse) ^ (at - begins).astype(np.uint64))
        parts.append(_ALPHABET[(own >> np.uint64(58)).astype(np.int64)].tobytes().decode())
    return ":".join(parts)


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, a row of the table held in the bits of one integer."""
    if not a or not b:
        return max(len(a), len(b))
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    up, down, score = full, 0, len(a)
    for c in b:
        eq = where.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | ~(xh | up) & full
        mh = up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1 | 1) & full
        mh = (mh << 1) & full
        up = mh | ~(xv | ph) & full
        down = ph & xv
    return score


def likeness(f: str, g: str) -> float:
    """0 to 1: the best over shared block sizes; without a common run of letters they are unlike."""
    if f == g:
        return 1.0
    if not f or not g:
        return 0.0
    x, y = f.split(":"), g.split(":")
    a = {int(x[0]) << i: s for i, s in enumerate(x[1:])}
    best = 0.0
    for i, t in enumerate(y[1:]):
        s = a.get(int(y[0]) << i)
        if s is None:
            continue
        k = min(COMMON_RUN, len(s), len(t))
        runs = {s[j : j + k] for j in range(len(s) - k + 1)}
        if any(t[j : j + k] in runs for j in range(len(t) - k + 1)):
            best = max(best, 1 - edit_distance(s, t) / max(len(s), len(t)))
    return round(best, 6)


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs with `fingerprint` of each whole text."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(utf8(t)) for t in texts], dtype=object)

    return docs.drop("fingerprint").withColumn("fingerprint", run("text"))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows dealt out by ranges of ids: `_range`, `_guest` (1: the first row of the range after, sent along),
    sorted within partitions so that each document is followed by its next one."""
    docs = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(2**63))).alias("_key"))
    # Among equal ids the texts' first bytes, as a number, tell in what order they come.
    begin = F.conv(F.rpad(F.hex(F.substring(F.coalesce("text", F.lit("")).cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long")
    docs = docs.withColumn("_later", -begin)
    n_bytes = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = int(max(1, min(MOST_RANGES, -(-n_bytes // RANGE_BYTES))))
    cuts = [i / ranges for i in range(1, ranges)]
    found = docs.select(F.percentile_approx("_key", F.array(*map(F.lit, cuts)), F.lit(10 * ranges))).first()[0] if cuts else []
    ids, times = np.unique(np.array(found or [], np.int64), return_counts=True)
    # An id that fills several ranges is cut inside, once for each range but the last.
    heavy = {int(i): int(n) for i, n in zip(ids, times, strict=True) if n > 1}
    inner = {}
    if heavy:
        parts = [k / ranges for k in range(1, ranges)]
        rows = docs.where(F.col("_key").isin(list(heavy))).groupBy("_key").agg(F.percentile_approx("_later", F.array(*map(F.lit, parts)), F.lit(10 * ranges)).alias("c"))
        inner = {r["_key"]: sorted({r["c"][ranges * k // (heavy[r["_key"]] + 1)] for k in range(1, heavy[r["_key"]] + 1)}) for r in rows.collect()}
    most = 2**63 - 1
    bounds = [(int(i), c) for i in ids for c in [*inner.get(int(i), []), most]]
    bound_ids, bound_cuts = (np.array([x[k] for x in bounds], np.int64) for k in (0, 1))

    def place(x: np.ndarray, later: np.ndarray) -> np.ndarray:
        """Range of each (id, later): how many bounds lie below it."""
        at = np.searchsorted(bound_ids, x, "left")
        for i in inner:
            own = x == i
            if own.any():
                a, b = np.searchsorted(bound_ids, i, "left"), np.searchsorted(bound_ids, i, "right")
                at[own] = a + np.searchsorted(bound_cuts[a:b], later[own], "left")
        return at

    @F.pandas_udf("int")
    def range_of(x: pd.Series, later: pd.Series) -> pd.Series:
        return pd.Series(place(x.to_numpy(), later.to_numpy()).astype(np.int32))

    firsts = docs.select(range_of("_key", "_later").alias("r"), F.struct("_key", "_later").alias("k")).groupBy("r").agg(F.max("k").alias("k")).collect()
    firsts = sorted((r["r"], (r["k"][0], r["k"][1])) for r in firsts)
    # The first row of a range goes along to the next higher one, that of the highest to the lowest.
    guest_of = {k: firsts[(i + 1) % len(firsts)][0] for i, (_, k) in enumerate(firsts)}

    @F.pandas_udf("array<int>")
    def places(x: pd.Series, later: pd.Series) -> pd.Series:
        own = (2 * place(x.to_numpy(), later.to_numpy())).tolist()
        homes = map(guest_of.get, zip(x.tolist(), later.tolist(), strict=True))
        return pd.Series([[o] if h is None else [o, 2 * h + 1] for o, h in zip(own, homes, strict=True)], dtype=object)

    dealt = docs.select("doc_id", "text", "_key", F.explode(places("_key", "_later")).alias("_place"))
    dealt = dealt.withColumns({"_range": F.shiftright("_place", 1), "_guest": F.col("_place") % 2}).drop("_place")
    return dealt.repartition("_range").sortWithinPartitions("_range", "_guest", F.desc("_key"), "text")


def compared_with_edit(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its half-replaced text, and their likenesses."""

    def row(doc_id, text: str, mark: str, after: str, after_mark: str) -> tuple:
        half = len(text) // 2
        edited = (text[: len(text) - half] + after[:half]).encode("utf-8", "replace")
        own = fingerprint(edited)
        return doc_id, len(text), hashlib.sha256(edited).hexdigest(), mark, own, likeness(mark, own), likeness(mark, after_mark)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("fingerprint")
        held = None
        for batch in it:
            rows = []
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "text", "_range", "_guest")]
            for doc_id, text, at, guest in zip(*columns, strict=True):
                text = text or ""
                if held is None and guest:
                    continue
                mark = fingerprint(utf8(text))
                if held is not None and held[3] == at:
                    rows.append(row(*held[:3], text, mark))
                held = None if guest else (doc_id, text, mark, at)
            kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
            names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return with_next(docs).mapInArrow(run, _OUT)


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared_with_edit(read(spark, sf_dir, "documents").select("doc_id", "text"))
