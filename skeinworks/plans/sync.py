"""A sync run: deduplicate, hash, classify, update index and state, remove orphans."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import cdc


@dataclass
class SyncResult:
    changes: DataFrame
    state: DataFrame
    index: DataFrame
    orphans: DataFrame


def run(new: DataFrame, state: DataFrame, index: DataFrame, chunk_tokens: int = text.CHUNK_TOKENS, incremental: bool = False, force: bool = False, embed: Callable[[DataFrame], DataFrame] | None = None, syncs: DataFrame | None = None, chunker: Callable[[Column], Column] | None = None) -> SyncResult:
    """Plans of one run over `new` (sync_id, entity_id, entity_type, name, text, seq, ...).

    Updated and deleted parents lose all their chunks before new ones are added. A row whose text cannot be read is no
    change, but it was seen, so what is stored of it stays. An incremental run sees only part of the source, so it has no
    orphans. No chunk has more than `text.HARD_TOKENS` tokens. `embed` adds vectors to new chunks (by `textual_representation`).
    `chunker` makes chunks of a text instead of runs of sentences, such as `chunking.topic_chunks`.

    Syncs are apart from each other: equal entity ids of two syncs are two entities, and state and index rows of a sync that did not
    run stay as they are. Those that ran are the ones in `new`, or in `syncs` (sync_id), which also names those that found nothing.
    """
    seen = cdc.keep_first(new, cdc.KEYS, ["seq"])
    one = cdc.hashed(seen).where(text.readable(F.coalesce("text", F.lit(""))))
    changes = cdc.classified(one, state, force=force)
    gone = cdc.orphans(state, seen, syncs) if not incremental else state.limit(0)
    parent = ["sync_id", "entity_id"]
    stale = changes.where("action in ('UPDATE', 'DELETE')").select(parent).unionByName(gone.select(parent)).distinct()
    fresh = changes.where("action in ('INSERT', 'UPDATE')")
    cut = chunker or (lambda column: text.sentence_chunks(column, chunk_tokens))
    chunks = text.exploded_chunks(fresh.select("sync_id", "entity_id", "entity_type", "name", "text"), cut(F.coalesce("text", F.lit(""))))
    chunks = chunks.select("sync_id", "entity_id", "original_entity_id", "entity_type", "name", "chunk_index", F.col("chunk").alias("textual_representation"))
    if embed is not None:
        chunks = embed(chunks)
    kept = index.join(stale.withColumnRenamed("entity_id", "original_entity_id"), ["sync_id", "original_entity_id"], "left_anti")
    after = cdc.upserted(state, changes, cdc.KEYS).join(gone.select(*cdc.KEYS), cdc.KEYS, "left_anti")
    return SyncResult(changes, after, kept.select(*chunks.columns).unionByName(chunks), gone)
