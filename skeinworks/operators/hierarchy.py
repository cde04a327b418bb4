"""Navigation over breadcrumbs and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 200


def last_id(breadcrumbs: str = "breadcrumbs") -> Column:
    return F.try_element_at(F.col(breadcrumbs), F.lit(-1))["entity_id"]


def children(rows: DataFrame, parent: str, limit: int = 50) -> DataFrame:
    """Rows directly under a parent; filtered first, then limited."""
    return rows.where(last_id() == parent).orderBy("entity_id").limit(min(limit, MOST))


def siblings(rows: DataFrame, entity_id: str, limit: int = 50) -> DataFrame:
    """Rows with the same direct parent as an entity, itself included."""
    own = rows.where(F.col("entity_id") == entity_id).select(last_id().alias("_p")).distinct()
    return rows.withColumn("_p", last_id()).join(own, "_p", "left_semi").drop("_p").orderBy("entity_id").limit(min(limit, MOST))


def parents(rows: DataFrame) -> DataFrame:
    """(entity_id, parent_id): the first chunk of each row's direct parent."""
    up = rows.where("chunk_index = 0").select(F.col("original_entity_id").alias("_p"), F.col("entity_id").alias("parent_id"))
    return rows.select("entity_id", last_id().alias("_p")).join(up, "_p").select("entity_id", "parent_id")


def surrounding(rows: DataFrame, matched: DataFrame, before: int = 2, after: int = 2) -> DataFrame:
    """Chunks around the matched ones of each parent, in order, with `is_match`."""
    band = matched.groupBy("original_entity_id").agg(F.min("chunk_index").alias("_lo"), F.max("chunk_index").alias("_hi"), F.collect_set("chunk_index").alias("_m"))
    near = rows.join(band, "original_entity_id").where((F.col("chunk_index") >= F.col("_lo") - before) & (F.col("chunk_index") <= F.col("_hi") + after))
    return near.withColumn("is_match", F.array_contains("_m", F.col("chunk_index"))).drop("_lo", "_hi", "_m")


def rendered(chunks: DataFrame, text: str = "text") -> DataFrame:
    """One text per parent: its chunks in order, matches marked."""
    line = F.concat(F.when(F.col("is_match"), F.lit(">> ")).otherwise(F.lit("   ")), F.lit("["), F.col("chunk_index").cast("string"), F.lit("] "), F.col(text))
    ordered = F.sort_array(F.collect_list(F.struct("chunk_index", line.alias("l"))))
    return chunks.groupBy("original_entity_id").agg(F.array_join(F.transform(ordered, lambda x: x["l"]), "\n").alias("rendered"))


def anchors(rows: DataFrame) -> DataFrame:
    """One row per entity: its first chunk."""
    return rows.where("chunk_index = 0")


def collected(have: DataFrame, add: DataFrame | None = None, remove: DataFrame | None = None) -> DataFrame:
    """A set of ids after adding and removing."""
    out = have.select("entity_id")
    if add is not None:
        out = out.unionByName(add.select("entity_id"))
    out = out.distinct()
    return out.join(remove.select("entity_id"), "entity_id", "left_anti") if remove is not None else out
