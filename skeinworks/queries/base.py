"""What the registered queries share: the register, and index rows made from the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Register:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, fn: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
        self.queries[name] = fn
        if sql is not None:
            self.sql[name] = sql

    def __call__(self, name: str, sql: str | None = None):
        def wrap(fn):
            self.add(name, fn, sql)
            return fn

        return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files, whether it is one file or a folder of them: a pattern may name either, a plain path only a folder."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}[.]parquet")


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index rows of `documents`, with nulls and empty lists in regular places."""
    d = table(spark, sf_dir, "documents")
    return d.selectExpr(
        "lang as collection_id",
        "concat(doc_id, '__chunk_0') as entity_id",
        "cast(doc_id as string) as original_entity_id",
        "concat('Document ', doc_id) as name",
        "source as source_name",
        "if(doc_id % 3 = 0, 'WebPageEntity', 'DocumentEntity') as entity_type",
        "cast(doc_id % 5 as int) as chunk_index",
        "1704067200 + doc_id * 3600 as created_at",
        "if(doc_id % 4 = 0, null, 1704153600 + doc_id * 3600) as updated_at",
        "concat('sync-', doc_id % 10) as sync_id",
        "concat('job-', doc_id % 20) as sync_job_id",
        "if(doc_id % 17 = 0, null, array(named_struct('entity_id', concat('lang-', lang), 'name', upper(lang), 'entity_type', 'LanguageEntity'), named_struct('entity_id', source, 'name', source, 'entity_type', 'TextSourceEntity'))) as breadcrumbs",
        "if(doc_id % 6 = 0, null, doc_id % 3 = 1) as access_is_public",
        "case when doc_id % 6 = 0 then null when doc_id % 5 = 0 then cast(array() as array<string>) else array(concat('user:u', doc_id % 7), concat('group:g', doc_id % 4)) end as access_viewers",
        "text as textual_representation",
        "doc_id",
    )


IDX = """idx as (select lang as collection_id, doc_id || '__chunk_0' as entity_id, doc_id::varchar as original_entity_id, 'Document ' || doc_id as name, source as source_name,
  case when doc_id % 3 = 0 then 'WebPageEntity' else 'DocumentEntity' end as entity_type, (doc_id % 5)::int as chunk_index, 1704067200 + doc_id * 3600 as created_at,
  case when doc_id % 4 = 0 then null else 1704153600 + doc_id * 3600 end as updated_at, 'sync-' || doc_id % 10 as sync_id, 'job-' || doc_id % 20 as sync_job_id,
  case when doc_id % 17 = 0 then null else [{'entity_id': 'lang-' || lang, 'name': upper(lang), 'entity_type': 'LanguageEntity'}, {'entity_id': source, 'name': source, 'entity_type': 'TextSourceEntity'}] end as breadcrumbs,
  case when doc_id % 6 = 0 then null else doc_id % 3 = 1 end as access_is_public,
  case when doc_id % 6 = 0 then null when doc_id % 5 = 0 then []::varchar[] else ['user:u' || doc_id % 7, 'group:g' || doc_id % 4] end as access_viewers, text as textual_representation, doc_id from documents)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk rows of `conversations`: a conversation is the parent, a turn its chunk."""
    return table(spark, sf_dir, "conversations").selectExpr("concat(conv_id, '__chunk_', turn) as entity_id", "cast(conv_id as string) as original_entity_id", "cast(turn as int) as chunk_index", "role", "text")


CHUNKS = "chunks as (select conv_id || '__chunk_' || turn as entity_id, conv_id::varchar as original_entity_id, turn::int as chunk_index, role, text from conversations)"


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sync jobs of `events`: a user is a sync, an event a job."""
    e = table(spark, sf_dir, "events")
    kind = F.pmod("event_id", F.lit(7))
    status = F.when(kind < 3, "completed").when(kind < 5, "failed").when(kind == 5, "running").otherwise("pending")
    return e.select(F.col("user_id").alias("sync_id"), F.col("event_id").alias("job_id"), status.alias("status"), F.col("ts").alias("created_at"), "value", "event_type")


JOBS = "jobs as (select user_id as sync_id, event_id as job_id, case when event_id % 7 < 3 then 'completed' when event_id % 7 < 5 then 'failed' when event_id % 7 = 5 then 'running' else 'pending' end as status, ts as created_at, value, event_type from events)"
