"""Dense vectors behind a small protocol: models by name, a local hashing model, checks and fallback."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import search

#: Dimensions of the known models.
MODELS = {"small": 1536, "large": 3072, "medium": 1024, "mini": 384, "hashing": 64}
BATCH_TEXTS = 100


def hashing(rows: DataFrame, text: str, dimensions: int = 64) -> DataFrame:
    """rows with `dense_embedding`: signed hashes of its distinct terms summed by slot and put to length one.

    Terms become signed slots natively; the slots of a batch of texts are summed together. A text without terms, or whose
    terms cancel, has a null vector.
    """

    def signed(term: Column) -> Column:
        slot = F.pmod(F.xxhash64(term), F.lit(dimensions)).cast("int") + 1
        return F.when(F.xxhash64(term, F.lit(1)) % 2 == 0, slot).otherwise(-slot)

    @F.arrow_udf("array<double>")
    def summed(slots: pa.Array) -> pa.Array:
        flat = slots.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        of = np.repeat(np.arange(len(slots)), pa.compute.list_value_length(slots).fill_null(0).to_numpy(zero_copy_only=False))
        total = np.zeros((len(slots), dimensions))
        np.add.at(total, (of, np.abs(flat) - 1), np.sign(flat))
        norm = np.sqrt((total * total).sum(axis=1))
        return pa.array([v / n if n > 0 else None for v, n in zip(total, norm, strict=True)], pa.list_(pa.float64()))

    return rows.withColumn("dense_embedding", summed(F.transform(F.array_distinct(search.terms(F.col(text))), signed)))


def with_model(rows: DataFrame, text: str, model: Callable[[list[str]], list[list[float]]], dimensions: int) -> DataFrame:
    """rows with vectors of an outer model, in batches; a batch that fails is tried text by text, and a text
    that fails has a null vector and is left out."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        out: list[list[float] | None] = []
        for a in range(0, len(texts), BATCH_TEXTS):
            part = texts.iloc[a : a + BATCH_TEXTS].tolist()
            try:
                out += model(part)
            except Exception:  # noqa: BLE001  one bad text must not cost the batch
                for t in part:
                    try:
                        out += model([t])
                    except Exception:  # noqa: BLE001
                        out.append(None)
        for v in out:
            if v is not None and len(v) != dimensions:
                raise ValueError(f"the model gave {len(v)} dimensions, {dimensions} are stored")
        return pd.Series([None if v is None else np.asarray(v, np.float32) for v in out], dtype=object)

    return rows.withColumn("dense_embedding", run(text)).where(F.col("dense_embedding").isNotNull())


def embedded(rows: DataFrame, text: str, name: str = "hashing", model: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """rows with vectors of a model by name; all but `hashing` need the callable that gives them."""
    if name not in MODELS:
        raise ValueError(f"unknown model {name}")
    if name == "hashing":
        return hashing(rows, text, MODELS[name])
    if model is None:
        raise ValueError(f"{name} needs a callable")
    return with_model(rows, text, model, MODELS[name])


def checked(rows: DataFrame, column: str, dimensions: int) -> DataFrame:
    """rows, failing at run time on a vector of another length; a text without terms, or whose terms cancel, has none."""
    fits = F.col(column).isNull() | (F.size(column) == dimensions)
    return rows.withColumn(column, F.when(F.assert_true(fits).isNull(), F.col(column)))


def variants(query: str, most: int = 4) -> list[str]:
    """Distinct other wordings by rule: without short words, reversed, quoted core, keywords; stands in for a model."""
    terms = search.query_terms(query)
    core = [t for t in terms if len(t) > 3] or terms
    found = [" ".join(core), " ".join(reversed(terms)), " ".join(sorted(core)), f'"{" ".join(core[:2])}"']
    return list(dict.fromkeys(x for x in found if x and x != query))[:most]
