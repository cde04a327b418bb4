"""Change detection: deduplicate a run, hash, classify against stored state, upsert, find orphans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["sync_id", "entity_id", "entity_type"]
#: Fields that never count as content.
UNHASHED = {"breadcrumbs", "local_path", "url", "hash", "sync_job_id", "seq", "deletion_status"}


def keep_first(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def keep_last(rows: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """The last row of each key, at the place where the key first came."""
    others = [c for c in rows.columns if c not in keys and c != seq]
    found = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), seq).alias("_r"), F.min(seq).alias(seq))
    return found.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in others], seq)


def content_hash(columns: Sequence[str]) -> Column:
    """SHA-256 of the fields by name, nulls left out, each with its length so that no two contents meet."""
    parts = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}:"), F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string"))) for c in sorted(columns)]
    return F.sha2(F.concat_ws("|", *parts), 256)


def hashed(rows: DataFrame, unhashed: Sequence[str] = ()) -> DataFrame:
    fields = [c for c in rows.columns if c not in UNHASHED and c not in unhashed]
    return rows.withColumn("hash", content_hash(fields))


def split_deletions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to keep or write, rows that a source reports as removed)."""
    gone = F.coalesce(F.col("deletion_status") == "removed", F.lit(False))
    return rows.where(~gone), rows.where(gone)


def classified(new: DataFrame, state: DataFrame, keys: Sequence[str] = KEYS, force: bool = False) -> DataFrame:
    """new with `action`: DELETE, INSERT, UPDATE or KEEP; one left join on the keys.

    A row that its source reports as removed is a DELETE; with force, so is one with any other deletion status, and all else
    an INSERT.
    """
    old = state.select(*keys, F.col("hash").alias("_old"), F.lit(True).alias("_known"))
    gone = F.lit(False)
    if "deletion_status" in new.columns:
        gone = F.col("deletion_status").isNotNull() if force else F.coalesce(F.col("deletion_status") == "removed", F.lit(False))
    action = (
        F.when(gone, "DELETE")
        .when(F.lit(force) | F.col("_known").isNull(), "INSERT")
        .when(~F.col("_old").eqNullSafe(F.col("hash")), "UPDATE")
        .otherwise("KEEP")
    )
    return new.join(old, list(keys), "left").withColumn("action", action).drop("_old", "_known")


def orphans(state: DataFrame, seen: DataFrame, syncs: DataFrame | None = None) -> DataFrame:
    """Stored rows whose entity id no type brought in this run of their sync; only of syncs that ran: those in `syncs` (sync_id), or
    in `seen`."""
    ran = (seen if syncs is None else syncs).select("sync_id").distinct()
    known = seen.select("sync_id", "entity_id").distinct()
    return state.join(ran, "sync_id", "left_semi").join(known, ["sync_id", "entity_id"], "left_anti")


def upserted(state: DataFrame, changes: DataFrame, keys: Sequence[str], keep: Sequence[str] = ("created_at",)) -> DataFrame:
    """State after changes: new keys added, known ones replaced but for the `keep` columns, DELETE rows gone."""
    gone = changes.where("action = 'DELETE'").select(*keys)
    put = changes.where("action <> 'DELETE'").select(*state.columns)
    new = put.withColumnsRenamed({c: f"_{c}" for c in state.columns if c not in keys}).withColumn("_new", F.lit(True))
    both = state.withColumn("_old", F.lit(True)).join(new, list(keys), "full_outer")
    cols = []
    for c in state.columns:
        if c in keys:
            cols.append(F.col(c))
        elif c in keep:
            cols.append(F.when(F.col("_old"), F.col(c)).otherwise(F.col(f"_{c}")).alias(c))
        else:
            cols.append(F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c))
    return both.select(*cols).join(gone, list(keys), "left_anti")


def hash_updated(state: DataFrame, hashes: DataFrame, keys: Sequence[str]) -> DataFrame:
    new = hashes.select(*keys, F.col("hash").alias("_h"))
    return state.join(new, list(keys), "left").withColumn("hash", F.coalesce("_h", "hash")).drop("_h")


def without_parents(index: DataFrame, parents: DataFrame) -> DataFrame:
    """Index rows but the chunks of these parents (collection_id, original_entity_id)."""
    return index.join(parents.select("collection_id", "original_entity_id").distinct(), ["collection_id", "original_entity_id"], "left_anti")


def counts(state: DataFrame) -> DataFrame:
    """Entities per sync and type; rows without a type are not counted."""
    return state.where(F.col("entity_type").isNotNull()).groupBy("sync_id", "entity_type").agg(F.count(F.lit(1)).alias("n"))


def action_counts(rows: DataFrame) -> DataFrame:
    """One row per type with a column per action."""
    names = ["INSERT", "UPDATE", "KEEP", "DELETE"]
    return rows.groupBy("entity_type").agg(*[F.count_if(F.col("action") == a).alias(a.lower()) for a in names])


def memberships_after(state: DataFrame, changes: DataFrame) -> DataFrame:
    """Memberships after ADD and REMOVE changes in order of `seq`; a removed group takes all its rows along."""
    keys = ["member_id", "member_type", "group_id"]
    whole = changes.where("op = 'REMOVE_GROUP'").groupBy("group_id").agg(F.max("seq").alias("_cut"))
    single = keep_first(changes.where("op in ('ADD', 'REMOVE')"), keys, [F.desc("seq")])
    base = state.select(*keys).withColumns({"op": F.lit("ADD"), "seq": F.lit(-1).cast("long")})
    last = keep_first(base.unionByName(single.select(*keys, "op", F.col("seq").cast("long"))), keys, [F.desc("seq")])
    kept = last.join(whole, "group_id", "left").where("op = 'ADD' and (_cut is null or seq > _cut)")
    return kept.select(*keys).distinct()
