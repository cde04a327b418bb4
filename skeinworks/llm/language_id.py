"""Language identification by hyperdimensional profiles (operator 1).

Every letter has a random vector of +1 and -1. An n-gram's vector binds its letters' vectors, each
permuted by its place, by element-wise product; a text's vector bundles (sums) the vectors of its
n-grams; a language's prototype bundles those of its texts. A text gets the language of the nearest
prototype by cosine.

Learning bundles texts where they are: each task sends one vector per language, so what reaches the
driver is languages x dimensions. At most about `per_language` labelled texts per language are used,
chosen by a hash of their id.

Defined cases: a null text, or one without a letter, is `und` with score 0; ties go to the language
that sorts first; with nothing to learn from, every text is `und`; repeated rows are judged alike; an
empty table gives an empty result; further columns of the input are kept by `identify`.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import enter, on_leave, read, slices

DIMENSIONS = 1024
GRAM = 3
PER_LANGUAGE = 3000
#: A text that shares no n-gram with a prototype has a cosine about 0 of deviation 1 / sqrt(DIMENSIONS): three are the margin.
NOISE = 3 / DIMENSIONS**0.5
_LETTERS = 4096
_KEPT_GRAMS = 30_000

_codes_cache: list[np.ndarray] = []
_letter_cache: list[np.ndarray] = []
_gram_rows: dict[int, int] = {}
_gram_table = np.zeros((0, DIMENSIONS), np.int8)


def _forget() -> None:
    global _gram_table
    _codes_cache.clear()
    _letter_cache.clear()
    _gram_rows.clear()
    _gram_table = np.zeros((0, DIMENSIONS), np.int8)


on_leave("language", _forget)


def _codes() -> np.ndarray:
    """Letter number of each code point of all planes: 0 for what is no letter, case folded."""
    if not _codes_cache:
        table = np.zeros(sys.maxunicode + 1, np.uint16)
        for c in range(sys.maxunicode + 1):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                table[c] = 1 + ord(low[0]) % (_LETTERS - 1)
        _codes_cache.append(table)
    return _codes_cache[0]


def _letters() -> np.ndarray:
    if not _letter_cache:
        rng = np.random.default_rng(77)
        _letter_cache.append((rng.integers(0, 2, (_LETTERS, DIMENSIONS), dtype=np.int8) * 2 - 1).astype(np.int8))
    return _letter_cache[0]


def _gram_vectors(grams: np.ndarray) -> np.ndarray:
    """Bound vectors of n-grams: the letter at place k is rolled by k before the product."""
    letters, out = _letters(), None
    for k in range(GRAM):
        part = np.roll(letters[(grams // _LETTERS**k) % _LETTERS], k, axis=1)
        out = part if out is None else out * part
    return out


def _rows_of(grams: np.ndarray) -> np.ndarray:
    """Vectors of distinct n-grams, from a bounded store that the worker fills as it goes."""
    global _gram_table
    new = [g for g in grams.tolist() if g not in _gram_rows]
    if new:
        if len(_gram_rows) + len(new) > _KEPT_GRAMS:
            _gram_rows.clear()
            _gram_table = np.zeros((0, DIMENSIONS), np.int8)
            new = grams.tolist()
            if len(new) > _KEPT_GRAMS:
                return _gram_vectors(grams)
        start = len(_gram_rows)
        _gram_rows.update((g, start + i) for i, g in enumerate(new))
        if start + len(new) > len(_gram_table):
            grown = np.zeros((max(2 * len(_gram_table), start + len(new), 4096), DIMENSIONS), np.int8)
            grown[:start] = _gram_table[:start]
            _gram_table = grown
        _gram_table[start : start + len(new)] = _gram_vectors(np.array(new, np.int64))
    return _gram_table[np.fromiter((_gram_rows[g] for g in grams.tolist()), np.int64, len(grams))]


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the whole text, runs of non-letters read as one gap, with their counts."""
    points = np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)
    codes = _codes()[points].astype(np.int64)
    gap = codes == 0
    if gap.all():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keep = ~gap
    keep[1:] |= ~gap[:-1]
    codes = codes[keep]
    # The first code is a letter's; the last may be the gap after one.
    padded = np.concatenate([[0], codes, [0]] if codes[-1] else [[0], codes])
    grams = padded[:-2] + padded[1:-1] * _LETTERS + padded[2:] * _LETTERS**2
    return np.unique(grams, return_counts=True)


def text_vector(text: str | None) -> np.ndarray | None:
    grams, counts = gram_counts(text)
    if not len(grams):
        return None
    out = np.zeros(DIMENSIONS, np.float32)
    for a in range(0, len(grams), 2048):
        out += counts[a : a + 2048].astype(np.float32) @ _rows_of(grams[a : a + 2048]).astype(np.float32)
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages and unit prototypes from the rows of docs (doc_id, text, lang) outside the held-out fold.

    A bounded sample: each labelled row is taken if the hash of its id falls below per_language / rows
    of its language. Each text counts alike, whatever its length.
    """
    fold = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    # One row per language, as many as prototypes reach the driver anyway.
    sizes = F.create_map(*[F.lit(x) for r in fold.groupBy("lang").count().collect() for x in (r["lang"], float(per_language) / r["count"])] or [F.lit(""), F.lit(0.0)])
    share = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    sample = fold.where(share < sizes[F.col("lang")]).select("lang", "text")

    def bundle(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enter("language")
        sums: dict[str, np.ndarray] = {}
        for part in it:
            for lang, text in zip(part["lang"], part["text"], strict=True):
                v = text_vector(text)
                if v is not None:
                    sums[lang] = sums.get(lang, 0) + v / np.linalg.norm(v)
        if sums:
            yield pd.DataFrame({"lang": list(sums), "v": [x.astype(np.float64).tolist() for x in sums.values()]})

    parts = sample.mapInPandas(bundle, "lang string, v array<double>").select("lang", F.posexplode("v"))
    rows = parts.groupBy("lang", "pos").agg(F.sum("col").alias("x")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("v"))
    found = {r["lang"]: np.array([x["x"] for x in r["v"]], np.float32) for r in rows.collect()}
    langs = sorted(found)
    table = np.array([found[x] / max(np.linalg.norm(found[x]), 1e-9) for x in langs], np.float32).reshape(len(langs), DIMENSIONS)
    return langs, table


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """docs with `lang_pred` and `score`, the cosine with that language's prototype, at least 0."""
    langs, table = model

    @F.arrow_udf("lang_pred string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        enter("language")
        names, scores = [], []
        for text in (t for part in slices(texts) for t in part):
            v = text_vector(text) if langs else None
            if v is None:
                names.append("und")
                scores.append(0.0)
            else:
                cos = table @ v / max(float(np.linalg.norm(v)), 1e-9)
                best = int(np.argmax(cos))
                names.append(langs[best])
                scores.append(round(float(min(max(cos[best], 0.0), 1.0)), 6))
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return docs.drop("lang_pred", "score").withColumn("_p", predict("text")).select("*", "_p.lang_pred", "_p.score").drop("_p")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = learn(docs.select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
