"""Corpus pipeline: language, toxicity, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read back
as the next one's docs. All but the last return the columns of `documents`.

Defined cases, for all stages: an empty table stays empty; further columns of docs are kept, whatever their names (the last
stage returns pieces and reads `doc_id` and `text` only); rows that share an id are judged each by its own text, but for
near duplicates, where an id goes if any of its rows does; texts are taken whole, however long. What a stage does with nulls,
empty texts and ties, it says itself.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinworks.llm import language_id, neardup, packing, repeats, toxicity
from skeinworks.llm.common import read, stored
from skeinworks.sources.scratch import delete, passing

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: Ids that a packing worker keeps: less than by default, as workers also hold what the other stages left in memory.
KEPT_WORDS = 300_000
#: Documents in one Arrow batch, instead of the session's default.
BATCH_ROWS = 1000
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in batches of BATCH_ROWS, unless the session has a number of its own: a batch is held by the
    executor and by its worker at the same time, for each of the stages that share them."""
    if spark.conf.get(_BATCH_KEY) == "10000":
        spark.conf.set(_BATCH_KEY, str(BATCH_ROWS))


def _set_aside(docs: DataFrame, *own: str) -> DataFrame:
    """docs with the columns `own`, and all others as one, out of the way of the names that an operator adds."""
    return docs.select(*own, F.struct(F.lit(True).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c not in own]).alias("_row"))


def _restored(found: DataFrame, docs: DataFrame, *own: str) -> DataFrame:
    return found.select(*[F.col(c) if c in own else F.col(f"_row.`{c}`") for c in docs.columns])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labels name; those without a letter, or no nearer to any than noise is, go.

    So null and empty texts go. Of equally near languages the first by name counts, which changes no decision.
    """
    _small_batches(spark)
    model = language_id.learn(docs.select("doc_id", "text", "lang"))
    found = language_id.identify(_set_aside(docs, "text"), model)
    return _restored(found.where((F.col("lang_pred") != "und") & (F.col("score") > language_id.NOISE)), docs, "text")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain does not call toxic: below the threshold, which a tie is not.

    Null and empty texts have the probability of the intercepts, and stay.
    """
    _small_batches(spark)
    chain = toxicity.learn(docs, read(spark, sf_dir, "labels"))
    return _restored(toxicity.score_chain(_set_aside(docs, "text"), chain).where(~F.col("is_toxic")), docs, "text")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, 0.8): the smallest id.

    Null, empty and wordless texts are duplicates of nothing, and rows without an id are not compared: all stay. A pair at
    exactly 0.8 is linked.
    """
    _small_batches(spark)
    found = neardup.near_duplicates(docs.select("doc_id", "text"))
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document has; n_chars follows the text.

    No document goes: a text of which nothing is left is empty, a null text stays null with null n_chars. Rows with one id do
    not repeat each other; rows without an id stay as they are.
    """
    _small_batches(spark)
    clean = repeats.remove_repeats(_set_aside(docs, "doc_id", "text", "n_chars"))
    clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return _restored(clean, docs, "doc_id", "text", "n_chars")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens.

    Null and empty texts have the end token only. Equal pieces may swap places.
    """
    _small_batches(spark)
    return packing.packed(docs, VOCABULARY, KEPT_WORDS)


STAGES = [
    ("language", language_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_passages", repeats_stage),
    ("packing", packing_stage),
]

#: Models and tokenizers have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What the earlier ones wrote on the way is deleted as soon as it has been read."""
    docs, before = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with passing(spark) as made:
            docs = stored(stage(spark, docs, sf_dir))
            at = made.pop()
        if before is not None:
            delete(spark, before)
        before = at
    return STAGES[-1][1](spark, docs, sf_dir)
