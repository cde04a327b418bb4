"""Joins and counts over the tables beside the index: connections, memberships, selections, usage, definitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits of usage plans (entities, users); null is no limit.
PLANS = {"free": (50_000, 1), "pro": (2_000_000, 5), "team": (10_000_000, 50), "enterprise": (None, None)}
#: Uses of each kind that are gathered before they are written to the ledger.
FLUSH = {"entities": 100, "queries": 10, "tokens": 100_000}


def stale(stored: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored rows (paths, memberships) that this run did not bring."""
    return stored.join(seen.select(*keys).distinct(), list(keys), "left_anti")


def memberships_of(memberships: DataFrame, connections: DataFrame, collection_id) -> DataFrame:
    """Memberships whose connection belongs to a collection."""
    own = connections.where(F.col("collection_id") == collection_id).select("connection_id").distinct()
    return memberships.join(own, "connection_id", "left_semi")


def has_controlled_sources(rows: DataFrame) -> DataFrame:
    """(collection_id, controlled): whether any row of a collection has access data."""
    return rows.groupBy("collection_id").agg(F.bool_or(F.col("access_is_public").isNotNull()).alias("controlled"))


def with_collection(connections: DataFrame, collections: DataFrame) -> DataFrame:
    """Connections with their collection's name; null where it is not known."""
    return connections.join(collections.select("collection_id", F.col("name").alias("collection")), "collection_id", "left")


def sync_connections(syncs: DataFrame, connections: DataFrame) -> DataFrame:
    """Syncs with the name of their connection; those without one are left out."""
    return syncs.join(connections.select("connection_id", F.col("name").alias("connection")), "connection_id")


def having(rows: DataFrame, others: DataFrame, key: str, condition: Column | None = None) -> DataFrame:
    """Rows whose key some row of others has, under a condition on that row."""
    found = others if condition is None else others.where(condition)
    return rows.join(found.select(key), key, "left_semi")


def lacking(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Rows whose key no row of others has (syncs without a connection); a null key is lacking."""
    return rows.join(others.select(key), key, "left_anti")


def type_counts(definitions: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """Definitions with their counts `n`; 0 where there is none."""
    return definitions.join(counts.select(key, "n"), key, "left").fillna(0, ["n"])


def counts(rows: DataFrame, keys: Sequence[str], latest: str | None = None) -> DataFrame:
    """Rows per key as `n`, with the newest time as `last_at` where one is named."""
    more = [F.max(latest).alias("last_at")] if latest else []
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *more)


def counts_by_type(rows: DataFrame) -> DataFrame:
    """Counts per sync and type, with the type's name for display."""
    return counts(rows, ["sync_id", "entity_type"]).withColumn("display_name", F.regexp_replace("entity_type", "Entity$", ""))


def members(users: DataFrame) -> DataFrame:
    """(org_id, n_users, last_active) of each organisation."""
    return users.groupBy("org_id").agg(F.count(F.lit(1)).alias("n_users"), F.max("last_active").alias("last_active"))


def operation_sum(jobs: DataFrame, statuses: Sequence[str]) -> DataFrame:
    """Jobs of a sync in any of the states: what a check for stuck jobs compares."""
    return jobs.groupBy("sync_id").agg(F.count_if(F.col("status").isin(*statuses)).alias("n"))


def best_by_id(rows: DataFrame, ident: str, score: str) -> DataFrame:
    """Each id once, with its greatest score."""
    return rows.groupBy(F.col(ident).alias("id")).agg(F.max(score).alias("score"))


def first_by_id(rows: DataFrame, ident: str, order: Sequence[str]) -> DataFrame:
    """Each id's first row by the order."""
    rest = [c for c in rows.columns if c != ident]
    found = rows.groupBy(F.col(ident).alias("id")).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return found.select("id", "_r.*")


def common_principals(rows: DataFrame, principals: Sequence[str]) -> DataFrame:
    """Rows that any of the principals may view, with those who may, sorted."""
    wanted = F.array(*map(F.lit, principals))
    seen = rows.where(F.arrays_overlap("access_viewers", wanted))
    return seen.withColumn("both", F.sort_array(F.array_intersect("access_viewers", wanted)))


def deleted_by_selection(rows: DataFrame, selection: Column) -> DataFrame:
    """Rows but those selected; where the selection is unknown, a row stays."""
    return rows.where(~F.coalesce(selection, F.lit(False)))


def usage(events: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Uses, their sum, and uses a day between the first and the last (a day at least)."""
    e = events.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.min(at).alias("_a"), F.max(at).alias("_b"))
    return e.withColumn("per_day", F.floor(F.col("n") / F.greatest(F.datediff("_b", "_a"), F.lit(1)))).drop("_a", "_b")


def flushed(events: DataFrame, keys: Sequence[str], value: Column, threshold: int) -> DataFrame:
    """Sums of uses that have reached the threshold; the others wait in the buffer."""
    return events.groupBy(*keys).agg(F.sum(value).alias("used")).where(F.col("used") >= threshold)


def plan_limits(rows: DataFrame, plan: str = "plan") -> DataFrame:
    """rows with `entities` and `users`, the limits of their plan; an unknown plan has those of the smallest."""
    limits = F.create_map(*[x for name, (a, b) in PLANS.items() for x in (F.lit(name), F.struct(F.lit(a).cast("long").alias("entities"), F.lit(b).cast("long").alias("users")))])
    own = F.coalesce(limits[F.col(plan)], limits[F.lit("free")])
    return rows.withColumn("_l", own).select(*rows.columns, "_l.entities", "_l.users")


def search_history(events: DataFrame, key: str, value, limit: int) -> DataFrame:
    """A user's or collection's newest events."""
    return events.where(F.col(key) == value).orderBy(F.desc("ts"), F.desc("event_id")).limit(limit)


def definitions(rows: DataFrame) -> DataFrame:
    """(source_name, types): entity types of each source, sorted."""
    return rows.groupBy("source_name").agg(F.sort_array(F.collect_set("entity_type")).alias("types"))


def matching_collections(rows: DataFrame, column: str, part: str) -> DataFrame:
    """How many distinct names hold the part, in any case."""
    return rows.select(column).distinct().where(F.lower(column).contains(part.lower())).agg(F.count(F.lit(1)).alias("n"))


def distinct_pairs(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(*columns).distinct()
