"""Streams over `events` and `documents`, run to their end (ST1-ST5, ST12, windowed counts as an extension)."""

from __future__ import annotations

import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import counts
from ..sources import cursors, sinks
from ..sources.scratch import new_folder
from ..streaming import pipelines, usage
from .base import Register, stream, table

reg = Register()


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession):
    """The state store that processors with their own state need, for streams that run inside."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def _drained(stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """The stream's whole output, written as Parquet and read back; of updates, the last row of each key."""
    spark = stream.sparkSession
    root = new_folder(spark)

    def put(batch: DataFrame, number: int) -> None:
        # Complete output replaces that of the batch before; appended output keeps to its batch, so a replay replaces it.
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={0 if mode == 'complete' else number}")

    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    out = spark.read.schema(schema).option("basePath", f"{root}/out").parquet(f"{root}/out/*")
    if mode != "update":
        return out.select(*stream.columns)
    rest = [c for c in stream.columns if c not in keys]
    return out.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in rest])


def _read_through(stream: DataFrame, rows: int) -> DataFrame:
    """What a stream with timers, which has no end of its own, has given when it has read so many rows."""
    spark = stream.sparkSession
    root, got = new_folder(spark), 0

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    q = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{root}/state").start()
    try:
        while q.isActive and got < rows:
            time.sleep(0.2)
            got = sum({p.batchId: p.numInputRows for p in q.recentProgress}.values())
    finally:
        q.stop()
    if q.exception() is not None:
        raise q.exception()
    return spark.read.schema(stream.schema).option("basePath", f"{root}/out").parquet(f"{root}/out/*")


@reg("st04_first_of_run", "select count(*) as n from (select distinct user_id, event_type from events)")
def _(spark, sf_dir):
    return _drained(pipelines.first_of_run(stream(spark, sf_dir, "events").select("user_id", "event_type"), ["user_id", "event_type"]), "append").agg(F.count(F.lit(1)).alias("n"))


@reg("st_running_counts", "with l as (select user_id % 5 as s, event_type as t, list(case when event_id % 4 < 2 then -1 else 1 end order by event_id) as steps from events where event_type is not null group by all) select s as sync_id, t as entity_type, list_reduce([0::bigint] || steps, lambda x, y: greatest(x + y, 0)) as n from l")
def _(spark, sf_dir):
    steps = stream(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("sync_id"), F.col("event_type").alias("entity_type"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 4 < 2, -1).otherwise(1).cast("long").alias("delta"))
    with state_store(spark):
        return _drained(counts.running_counts(steps), "update", ["sync_id", "entity_type"])


@reg("st_windowed", "select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def _(spark, sf_dir):
    events = stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = _drained(pipelines.windowed(events), "complete")
    return out.withColumns({"total": F.round("total", 4), "start": F.col("start").cast("timestamp_ntz")})


@reg("st12_sliding_limit")
def _(spark, sf_dir):
    calls = stream(spark, sf_dir, "events").select("user_id", "event_id", F.unix_timestamp("ts").cast("double").alias("at"))
    with state_store(spark):
        return _drained(pipelines.limited(calls, 3, 3600.0), "append")


@reg("s09_cursor_stream", "select doc_id, 1::bigint as times from documents where doc_id is not null")
def _(spark, sf_dir):
    """Documents by a cursor on their ids, in three steps or more, each in a query that ends and is started again: every one comes once."""
    cursors.register(spark)
    root = new_folder(spark)
    ends = table(spark, sf_dir, "documents").agg(F.max("doc_id")).first()[0]
    step = max((ends or 0) // 3 + 1, 1)
    source = spark.readStream.format("skein_cursor").schema("doc_id long").option("path", f"{sf_dir}/documents.parquet").option("cursor", "doc_id").option("step", step).option("parts", 8)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    for _ in range(4):
        source.load().writeStream.foreachBatch(put).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema("doc_id long").option("basePath", f"{root}/out").parquet(f"{root}/out/*")
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("times"))


def _sunk(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """Documents as index rows: half by a batch, half by a stream, in the committing sink."""
    sinks.register(spark)
    path = new_folder(spark)
    rows = lambda d: d.selectExpr("cast(doc_id as string) as entity_id", "lang as collection_id", "source as schema_name", "text")
    rows(table(spark, sf_dir, "documents").where("doc_id % 2 = 0")).write.format("skein_index").mode("append").option("path", path).save()
    rest = rows(stream(spark, sf_dir, "documents").where("doc_id % 2 = 1")).writeStream.format("skein_index").option("path", path)
    rest.option("checkpointLocation", new_folder(spark)).trigger(availableNow=True).start().awaitTermination()
    return path, rows(table(spark, sf_dir, "documents"))


@reg("k01_committed_writes", "select doc_id::varchar as entity_id, lang as collection_id, source as schema_name, sha256(text) as content from documents")
def _(spark, sf_dir):
    path, like = _sunk(spark, sf_dir)
    return sinks.read(spark, path, like.schema).select("entity_id", "collection_id", "schema_name", F.sha2("text", 256).alias("content"))


@reg("k02_counts_by_schema", "select lang as collection_id, source as schema_name, count(*) as rows from documents group by all")
def _(spark, sf_dir):
    """Rows by collection and schema as the tasks told them to the commits; no row is read."""
    return sinks.counts(spark, _sunk(spark, sf_dir)[0])


@reg("st15_usage_ledger", """with l as (select user_id, list([event_id % 7, 0] order by event_id) as steps from events group by all),
f as (select user_id, list_reduce([[0::bigint, 0::bigint]] || steps, lambda a, b: case when a[1] + b[1] >= 10 then [0, a[2] + a[1] + b[1]] else [a[1] + b[1], a[2]] end) as s from l)
select user_id as organization_id, s[2] as amount from f where s[2] > 0""")
def _(spark, sf_dir):
    """What a stream of records has written out because enough had gathered; the rest waits for its timer."""
    records = stream(spark, sf_dir, "events").select(F.col("user_id").alias("organization_id"), F.lit("queries").alias("action"), (F.col("event_id") % 7).alias("amount"), F.col("event_id").alias("seq"))
    with state_store(spark):
        out = _read_through(usage.flushed(records, wait=3600.0), table(spark, sf_dir, "events").count())
    return out.where("cause = 'threshold'").groupBy("organization_id").agg(F.sum("amount").alias("amount"))
