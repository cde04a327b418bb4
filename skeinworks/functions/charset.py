"""Charset of files that are not UTF-8: what decodes, weighed by the pairs of characters that texts have.

A charset is possible for a content if the whole of it decodes without a fault and without control characters. Of the possible
ones the likeliest is taken: its text's pairs of neighbours, at least one of them outside ASCII, are weighed by how often a corpus
of known texts has them. Confidence is the likeliest charset's share of all possible ones' likelihood (charsets that give the
same text are one), times the share of its pairs that the corpus has; so binary data, for which every reading is strange, stays below
`LEAST_CONFIDENCE` even if one reading is less strange than others.

Pairs may leave a file open: it has few of them, or one odd word that it repeats, so that another reading would be likelier but for a few odd pairs, each
weighed once however often it is repeated (`ODD_PAIRS`); or its confidence is too low. Its likely readings are then compared by the longer contexts that the corpus
has, words and their surroundings (`contexts`), in a join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored
from . import text as text_functions

#: Charsets tried, by the names of Python's codecs; of several that give the same text the first is named.
CHARSETS = ("cp1252", "iso8859_15", "iso8859_2", "cp1250", "cp1251", "koi8_r", "cp850", "cp852", "cp866", "mac_roman", "utf_16_le", "utf_16_be", "shift_jis", "euc_jp", "gb18030", "big5", "euc_kr")
LEAST_CONFIDENCE = 0.7
#: A reading is a rival of the best one if it is likelier but for so many pairs that the corpus lacks: two stand around one odd letter.
ODD_PAIRS = 2
#: How much less likely a reading is for each context that the corpus lacks.
CONTEXT_ODDS = 20.0
#: Most pairs that a model holds: the commonest.
MOST_PAIRS = 1 << 17
_PAIR_BASE = 1 << 21


class Pairs(NamedTuple):
    """Pairs of neighbours, as sorted numbers, with the logarithm of their share; other pairs have `rest`."""

    keys: np.ndarray
    logs: np.ndarray
    rest: float


def _folded(codes: np.ndarray) -> np.ndarray:
    """Code points with all ASCII but letters as a space. Case stays: between capitals a small letter is unlikely."""
    lower = codes | 32
    return np.where((codes < 128) & ((lower < 97) | (lower > 122)), 32, codes)


def pair_counts(texts: DataFrame, column: str = "text") -> DataFrame:
    """(a, b, n): how often characters a and b are neighbours in all texts, at least one of them outside ASCII.

    Runs outside ASCII with their neighbours are cut out natively, so plain ASCII costs a scan; counts are partial where the texts are.
    """
    padded = F.concat(F.lit(" "), F.col(column), F.lit(" "))
    run, end = r"(?s).[^\x00-\x7F]+", r"[^\x00-\x7F][\x00-\x7F]"
    into = F.expr("transform(sequence(1, length(run) - 1), i -> substr(run, i, 2))")
    known = texts.where(F.col(column).isNotNull()).select(padded.alias("padded"))
    inside = known.select(F.explode(F.regexp_extract_all("padded", F.lit(run), F.lit(0))).alias("run")).select(F.explode(into).alias("p"))
    pairs = inside.unionByName(known.select(F.explode(F.regexp_extract_all("padded", F.lit(end), F.lit(0))).alias("p")))
    folded = F.regexp_replace("p", r"[\x00-@\[-`{-\x7F]", " ")
    counted = pairs.groupBy(folded.alias("p")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.substr("p", F.lit(1), F.lit(1)).alias("a"), F.substr("p", F.lit(2), F.lit(1)).alias("b"), "n")


def learn(texts: DataFrame, column: str = "text", most: int = MOST_PAIRS) -> Pairs:
    """A model of all texts; at most `most` pairs reach the driver."""
    got = pair_counts(texts, column).orderBy(F.desc("n"), "a", "b").limit(most).collect()
    keys = np.array([ord(r.a) * _PAIR_BASE + ord(r.b) for r in got], np.int64)
    n = np.array([r.n for r in got], float)
    order = np.argsort(keys)
    # Pairs not seen share one more count, over about as many as there are characters.
    total = n.sum() + 1
    return Pairs(keys[order], np.log(n[order] / total), float(-np.log(total) - np.log(1 << 16)))


#: Characters looked at together, so that a long text needs little beside itself.
_SEGMENT = 1 << 18


def _segments(found: str) -> Iterator[np.ndarray]:
    """Code points of a text between two spaces, in parts that share a character with the next."""
    found = f" {found} "
    for a in range(0, len(found) - 1, _SEGMENT):
        yield np.frombuffer(found[a : a + _SEGMENT + 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def _strange(codes: np.ndarray) -> bool:
    """Control characters, surrogates, private and undefined code points."""
    control = ((codes < 32) & ((codes < 9) | (codes > 13))) | ((codes >= 127) & (codes < 160))
    unmeant = ((codes >= 0xD800) & (codes < 0xF900)) | (codes == 0xFFFD) | ((codes & 0xFFFE) == 0xFFFE)
    return bool(control.any() or unmeant.any())


def reading(content: bytes, charset: str) -> str | None:
    """The whole content in a charset; null if it is not valid there."""
    try:
        found = content.decode(charset).removeprefix("\ufeff")
    except UnicodeDecodeError:
        return None
    return None if any(_strange(codes) for codes in _segments(found)) else found


class Weight(NamedTuple):
    """Log-likelihood of a text's pairs, the share of them that the model has (1 where there are none), and the log-likelihood of its distinct pairs."""

    total: float
    known: float
    once: float


def weight(found: str, pairs: Pairs) -> Weight:
    total, known, seen, distinct = 0.0, 0, 0, np.array([], np.int64)
    for codes in _segments(found):
        codes = _folded(codes)
        a, b = codes[:-1], codes[1:]
        some = (a > 127) | (b > 127)
        keys, n = np.unique(a[some] * _PAIR_BASE + b[some], return_counts=True)
        logs, inside = _logs(keys, pairs)
        total += float((logs * n).sum())
        known, seen = known + int(n[inside].sum()), seen + int(n.sum())
        distinct = np.union1d(distinct, keys) if len(distinct) else keys
    return Weight(total, known / seen if seen else 1.0, float(_logs(distinct, pairs)[0].sum()))


def _logs(keys: np.ndarray, pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood of each pair, and whether the model has it."""
    at = np.searchsorted(pairs.keys, keys)
    inside = np.append(pairs.keys, -1)[at] == keys
    return np.where(inside, np.append(pairs.logs, 0.0)[at], pairs.rest), inside


class Found(NamedTuple):
    """What pairs of characters say of a content; rivals are (charset, text) of the likely readings, if they leave it open."""

    charset: str | None
    confidence: float
    text: str | None
    rivals: list[tuple[str, str]]


def weighed(content: bytes, pairs: Pairs, charsets: Sequence[str] = CHARSETS) -> Found:
    """The likeliest reading of a content and its rivals; no charset if none is possible."""
    weights: dict[bytes, tuple[Weight, str]] = {}
    best: tuple[Weight, str, str] | None = None
    for charset in charsets:
        found = reading(content, charset)
        if found is None:
            continue
        same = hashlib.blake2b(found.encode()).digest()
        if same in weights:
            continue
        w = weight(found, pairs)
        weights[same] = w, charset
        if best is None or w.total > best[0].total:
            best = w, charset, found
    if best is None:
        return Found(None, 0.0, None, [])
    top, gap = best[0], -ODD_PAIRS * pairs.rest
    near = [charset for w, charset in weights.values() if min(top.total - w.total, top.once - w.once) < gap]
    confidence = float(1 / sum(np.exp(max(w.total - top.total, -700.0)) for w, _ in weights.values()) * top.known)
    open_yet = len(near) > 1 or confidence <= LEAST_CONFIDENCE
    return Found(best[1], confidence, best[2], [(c, best[2] if c == best[1] else reading(content, c)) for c in near] if open_yet else [])


def detected(content: bytes, pairs: Pairs, charsets: Sequence[str] = CHARSETS) -> tuple[str | None, float, str | None]:
    """(charset, confidence, text) of a content by pairs; null, 0, null if no charset is possible."""
    return weighed(content, pairs, charsets)[:3]


#: Characters of a wide context on each side.
_WIDE = 12


def _contexts(column: Column) -> Column:
    """Words that have a character outside ASCII, after `w`, and such characters with what is around them, after `c`."""
    padded = F.concat(F.lit(" "), column, F.lit(" "))
    words = F.regexp_extract_all(padded, F.lit(r"(?<![A-Za-z])[A-Za-z]*+[^\x00-\x7F][A-Za-z[^\x00-\x7F]]*+"), F.lit(0))
    wide = F.regexp_extract_all(padded, F.lit(rf"[\x00-\x7F]{{0,{_WIDE}}}+[^\x00-\x7F]++[\x00-\x7F]{{0,{_WIDE}}}+"), F.lit(0))
    marked = F.concat(F.transform(words, lambda x: F.concat(F.lit("w"), x)), F.transform(wide, lambda x: F.concat(F.lit("c"), x)))
    return F.array_distinct(marked)


def contexts(texts: DataFrame, column: str = "text") -> DataFrame:
    """(context): those of known texts, not yet each once; texts in plain ASCII have none."""
    some = texts.where(F.octet_length(column) > F.char_length(column))
    return some.select(F.explode(_contexts(F.col(column))).alias("context"))


def _settled(rivals: DataFrame, known: DataFrame) -> DataFrame:
    """(key, settled: charset, confidence, text) of files that known contexts settle, from rivals (key, charset, text).

    A reading's share is that of its contexts that are known. The best reading's confidence is its share, times its part of all readings' likelihood: a share
    that is less by a context is less likely by `CONTEXT_ODDS`. Wide contexts decide where that is over `LEAST_CONFIDENCE`; else words, by the same rule; else the
    file is not settled.
    """
    each = stored(rivals.select("key", "charset", F.explode(_contexts(F.col("text"))).alias("context")))
    had = known.join(each.select("context").distinct(), "context", "left_semi").distinct().withColumn("had", F.lit(1))
    seen = each.join(had, "context", "left").groupBy("key", "charset", F.substr("context", F.lit(1), F.lit(1)).alias("level"))
    shares = seen.agg((F.count("had") / F.count(F.lit(1))).alias("share"), F.count(F.lit(1)).alias("n"))
    levels = shares.groupBy("key", "level").agg(F.max(F.struct("share", "charset")).alias("best"), F.max("n").alias("n"), F.collect_list("share").alias("shares"))
    likely = lambda x: x * F.pow(F.lit(CONTEXT_ODDS), (x - F.col("best.share")) * F.col("n"))
    part = F.col("best.share") / F.aggregate("shares", F.lit(0.0), lambda total, x: total + likely(x))
    sure = levels.where("best.share > 0").select("key", "level", "best.charset", (F.col("best.share") * part).alias("confidence")).where(F.col("confidence") > LEAST_CONFIDENCE)
    chosen = sure.groupBy("key").agg(F.min_by(F.struct("charset", "confidence"), "level").alias("c")).select("key", "c.*")
    return rivals.join(chosen, ["key", "charset"]).select("key", F.struct("charset", "confidence", "text").alias("settled"))


def decoded(files: DataFrame, pairs: Pairs, content: str = "content", charsets: Sequence[str] = CHARSETS, known: DataFrame | None = None) -> DataFrame:
    """files with `charset`, `confidence` and `text`.

    UTF-8 without zero bytes is told and read natively, with confidence 1 (empty contents too). The rest has the likeliest charset if its confidence is over
    `LEAST_CONFIDENCE`, else UTF-8 with replacements and confidence 0, and a null text if these are too many. A null content gives nulls.
    With known (`contexts` of a corpus), files that pairs leave open are compared by them first; what pairs find is stored for it.
    """
    held = files.sparkSession.sparkContext.broadcast(tuple(pairs))
    kind = "struct<charset: string, confidence: double, text: string, rivals: array<struct<charset: string, text: string>>>"
    rival = pa.list_(pa.struct([("charset", pa.string()), ("text", pa.string())]))
    compared = known is not None

    @F.arrow_udf(kind)
    def detect(contents: pa.Array) -> pa.Array:
        model, sure = Pairs(*held.value), []
        for c in contents:
            found = weighed(c.as_py(), model, charsets) if c.is_valid else Found(None, 0.0, None, [])
            rivals = [{"charset": n, "text": t} for n, t in found.rivals] if compared and found.rivals else None
            sure.append((*(found[:3] if found.confidence > LEAST_CONFIDENCE else (None, 0.0, None)), rivals))
        columns = [pa.array([x[k] for x in sure], t) for k, t in enumerate((pa.string(), pa.float64(), pa.string(), rival))]
        return pa.StructArray.from_arrays(columns, ["charset", "confidence", "text", "rivals"])

    rows = files.drop("charset", "confidence", "text", "_native", "_found")
    # Bytes of zero are valid UTF-8, but texts have none: UTF-16 does.
    plain = F.is_valid_utf8(F.col(content).cast("string")) & ~F.contains(F.col(content), F.lit(b"\x00"))
    marked = rows.withColumn("_native", plain).withColumn("_found", detect(F.when(~F.col("_native"), F.col(content))))
    if compared:
        marked = _compared(marked, content, known)
    replaced = F.make_valid_utf8(F.col(content).cast("string"))
    text: Column = F.when(F.col("_native"), F.col(content).cast("string")).otherwise(F.coalesce("_found.text", F.when(text_functions.readable(replaced), replaced)))
    return marked.withColumns(
        {
            "charset": F.when(F.col("_native"), "utf_8").otherwise(F.coalesce("_found.charset", F.when(F.col(content).isNotNull(), "utf_8"))),
            "confidence": F.when(F.col("_native"), 1.0).when(F.col(content).isNotNull(), F.col("_found.confidence")),
            "text": text,
        }
    ).drop("_native", "_found")


def _compared(marked: DataFrame, content: str, known: DataFrame) -> DataFrame:
    """marked with `_found` of known contexts, where they settle what pairs left open. Only files left open move."""
    marked = stored(marked)
    left_open = F.col("_found.rivals").isNotNull()
    rest = marked.where(~left_open).withColumn("_found", F.struct("_found.charset", "_found.confidence", "_found.text"))
    some = marked.where(left_open).withColumn("_key", F.sha2(content, 256))
    rivals = stored(some.dropDuplicates(["_key"]).select(F.col("_key").alias("key"), F.inline("_found.rivals").alias("charset", "text")))
    some = some.join(_settled(rivals, known), F.col("_key") == F.col("key"), "left")
    some = some.withColumn("_found", F.coalesce("settled", F.struct("_found.charset", "_found.confidence", "_found.text"))).drop("_key", "key", "settled")
    return rest.unionByName(some)
