"""Projections between entity rows, index rows and results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model

UNKNOWN = "Unknown"


def epochs(rows: DataFrame, columns: Sequence[str] = ("created_at", "updated_at")) -> DataFrame:
    """Times as whole seconds since 1970; those that are no times stay null."""
    return rows.withColumns({c: F.unix_timestamp(c) for c in columns if c in rows.columns})


def with_defaults(rows: DataFrame) -> DataFrame:
    """Metadata that index rows must have: an empty type is Unknown, and a row without a parent is its own."""
    kind = F.coalesce(F.nullif(F.col("entity_type"), F.lit("")), F.lit(UNKNOWN))
    return rows.withColumns({"entity_type": kind, "original_entity_id": F.coalesce("original_entity_id", "entity_id")})


def type_fields(rows: DataFrame, is_email: bool = False) -> DataFrame:
    """Base columns and those of the family that the columns belong to, with `schema_name`; the family's optional fields
    (mime_type, local_path) are null where they are empty, other columns are left to the payload."""
    family = model.family_of(rows.columns, is_email)
    base = [f.name for f in model.INDEX.fields if f.name in rows.columns and f.name not in ("schema_name", "payload")]
    own = [c for c in model.FAMILIES[family] if c in rows.columns and c not in base]
    values = {c: F.nullif(F.col(c), F.lit("")) if c in ("mime_type", "local_path") else F.col(c) for c in own}
    return rows.select(*base, *[v.alias(c) for c, v in values.items()], F.lit(family).alias("schema_name"))


def index_ids(rows: DataFrame, schema_name: str = "base_entity") -> DataFrame:
    """Rows with the id and schema under which the index keeps them."""
    return rows.withColumns({"document_id": F.concat("entity_type", F.lit("_"), "entity_id"), "schema_name": F.lit(schema_name)})


def results(hits: DataFrame) -> DataFrame:
    """Hits as results: those without an id are left out, a missing name is empty."""
    return hits.where(F.col("entity_id").isNotNull()).withColumn("name", F.coalesce("name", F.lit("")))


def federated(rows: DataFrame, ident: str) -> DataFrame:
    """Rows of a query-time source as first chunks without a score."""
    return rows.withColumns({"entity_id": F.concat(F.col(ident).cast("string"), F.lit("__chunk_0")), "chunk_index": F.lit(0), "score": F.lit(0.0)})


def summary(full: bool = False, source: Column | None = None) -> Column:
    """Markdown of a result: a heading, its id and source, and with `full` its text; `source` adds further fields."""
    lines = [F.concat(F.lit("### "), "name"), F.concat(F.lit("- id: "), "entity_id"), F.concat(F.lit("- source: "), "source_name")]
    if full:
        lines.append(F.col("textual_representation"))
    if source is not None:
        lines.append(F.concat(F.lit("```json\n"), source, F.lit("\n```")))
    return F.concat_ws("\n", *lines)


def with_content(rows: DataFrame, content: Column, at_least: int = 1) -> DataFrame:
    """Rows whose content has so many characters once trimmed."""
    return rows.where(F.length(F.trim(content)) >= at_least)


def flattened(rows: DataFrame, column: str, fields: dict[str, str]) -> DataFrame:
    """Fields of a JSON column as columns: name to type; what cannot be read as the type is null."""
    return rows.withColumns({name: F.get_json_object(column, f"$.{name}").try_cast(kind) for name, kind in fields.items()})


def errors_split(rows: DataFrame, value: Column) -> tuple[DataFrame, DataFrame]:
    """(rows whose value could be worked out, rows to skip): an entity's error costs its row only."""
    marked = rows.withColumn("_v", value)
    return marked.where(F.col("_v").isNotNull()).drop("_v"), marked.where(F.col("_v").isNull()).drop("_v")
