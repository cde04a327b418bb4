"""The data model: entity rows, index rows (one per chunk), and the dimension of entity types."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BREADCRUMB = T.StructType([T.StructField(n, T.StringType()) for n in ("entity_id", "name", "entity_type")])

INDEX = T.StructType(
    [
        T.StructField("collection_id", T.StringType()),
        T.StructField("schema_name", T.StringType()),
        T.StructField("entity_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("breadcrumbs", T.ArrayType(BREADCRUMB)),
        T.StructField("created_at", T.LongType()),
        T.StructField("updated_at", T.LongType()),
        T.StructField("textual_representation", T.StringType()),
        T.StructField("entity_type", T.StringType()),
        T.StructField("source_name", T.StringType()),
        T.StructField("sync_id", T.StringType()),
        T.StructField("sync_job_id", T.StringType()),
        T.StructField("hash", T.StringType()),
        T.StructField("original_entity_id", T.StringType()),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("access_is_public", T.BooleanType()),
        T.StructField("access_viewers", T.ArrayType(T.StringType())),
        T.StructField("payload", T.StringType()),
    ]
)

#: Columns that each family of entities adds to the base row, families in routing order.
FAMILIES = {
    "code_file_entity": ["url", "size", "file_type", "mime_type", "local_path", "repo_name", "path_in_repo", "repo_owner", "language", "commit_id"],
    "email_entity": ["url", "size", "file_type", "mime_type", "local_path"],
    "file_entity": ["url", "size", "file_type", "mime_type", "local_path"],
    "web_entity": ["crawl_url"],
    "base_entity": [],
}


def family_of(columns: list[str], is_email: bool = False) -> str:
    """The index schema that rows with these columns belong to: code, email, file, web, else base."""
    have = set(columns)
    if {"repo_name", "path_in_repo"} <= have:
        return "code_file_entity"
    if "file_type" in have:
        return "email_entity" if is_email else "file_entity"
    return "web_entity" if "crawl_url" in have else "base_entity"


@dataclass(frozen=True)
class Flags:
    """Marks of an entity field, kept in the column's metadata."""

    embeddable: bool = False
    is_entity_id: bool = False
    is_name: bool = False
    is_created_at: bool = False
    is_updated_at: bool = False
    unhashable: bool = False

    def metadata(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if v}


def flagged(schema: T.StructType, flag: str) -> list[str]:
    return [f.name for f in schema.fields if f.metadata.get(flag)]


def check_flags(schema: T.StructType) -> None:
    """Exactly one id and one name, neither nullable, and at most one of each date."""
    for flag, least in (("is_entity_id", 1), ("is_name", 1), ("is_created_at", 0), ("is_updated_at", 0)):
        found = flagged(schema, flag)
        if not least <= len(found) <= 1:
            raise ValueError(f"{flag}: {len(found)} fields")
        if least and schema[found[0]].nullable:
            raise ValueError(f"{flag}: {found[0]} is nullable")


def fill_base(df: DataFrame) -> DataFrame:
    """Base columns from flagged fields where they are empty."""
    out = {}
    for flag, base in (("is_entity_id", "entity_id"), ("is_name", "name")):
        for f in flagged(df.schema, flag):
            own = F.nullif(F.col(base), F.lit("")) if base in df.columns else F.lit(None)
            out[base] = F.coalesce(own, F.col(f).cast("string"))
    for flag, base in (("is_created_at", "created_at"), ("is_updated_at", "updated_at")):
        for f in flagged(df.schema, flag):
            out[base] = F.coalesce(F.col(base), F.col(f)) if base in df.columns else F.col(f)
    return df.withColumns(out)


def unioned(*parts: DataFrame) -> DataFrame:
    """Families as one table; columns a family lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


_HUMP = re.compile(r"([a-z0-9])([A-Z])|([A-Z])(?=[A-Z][a-z])")


def short_name(class_name: str) -> str:
    """snake_case of a class name."""
    return _HUMP.sub(lambda m: f"{m[1]}_{m[2]}" if m[1] else f"{m[3]}_", class_name).lower()


def short_name_column(name: Column) -> Column:
    two = F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1_$2")
    return F.lower(F.regexp_replace(two, r"([A-Z])([A-Z][a-z])", "$1_$2"))
