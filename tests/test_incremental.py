"""Streams with a cursor, sinks with a commit, usage flushed by count and by time, counts with steps clipped."""

import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinworks.operators import counts
from skeinworks.queries.streams import state_store
from skeinworks.sources import cursors, sinks
from skeinworks.streaming import usage


@pytest.fixture
def source(spark, tmp_path):
    cursors.register(spark)
    rows = spark.range(100).select("id", F.concat(F.lit("text "), "id").alias("text")).union(spark.createDataFrame([(None, "no cursor")], "id long, text string"))
    rows.repartition(3).write.parquet(f"{tmp_path}/table")
    stream = spark.readStream.format("skein_cursor").schema("id long, text string").option("path", f"{tmp_path}/table").option("cursor", "id")
    return stream, str(tmp_path)


def drained(stream, put, checkpoint):
    q = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_each_row_once_over_restarts(source):
    stream, root = source
    seen = {}

    def put(batch, number):
        seen[number] = sorted(r.id for r in batch.collect())

    for _ in range(4):
        drained(stream.option("step", 40).load(), put, f"{root}/state")
    assert [x for n in sorted(seen) for x in seen[n]] == list(range(100))
    assert max(map(len, seen.values())) <= 41


def test_an_unfinished_batch_comes_again(source):
    stream, root = source
    seen, broken = [], [True]

    def put(batch, number):
        seen.append((number, sorted(r.id for r in batch.collect())))
        if broken[0] and number == 1:
            broken[0] = False
            raise RuntimeError("the task that writes is lost")

    for _ in range(5):
        try:
            drained(stream.option("step", 40).option("saved", f"{root}/cursor").load(), put, f"{root}/state")
        except Exception as e:  # noqa: BLE001
            assert "is lost" in str(e)
            assert cursors.saved_cursor(f"{root}/cursor") <= 39
    again = [ids for n, ids in seen if n == 1]
    assert len(again) == 2 and again[0] == again[1]
    assert sorted({x for _, ids in seen for x in ids}) == list(range(100))


def test_a_saved_cursor_outlives_the_checkpoint(spark, source):
    stream, root = source
    got = []
    put = lambda batch, number: got.extend(r.id for r in batch.collect())
    drained(stream.option("saved", f"{root}/cursor").load(), put, f"{root}/one")
    spark.range(100, 130).select("id", F.lit("later").alias("text")).write.mode("append").parquet(f"{root}/table")
    cursors.save_cursor(f"{root}/cursor", 99)
    drained(stream.option("saved", f"{root}/cursor").load(), put, f"{root}/two")
    assert sorted(got) == list(range(130))


ROWS = "entity_id string, collection_id string, schema_name string, n int"


def rows(spark, a, b):
    return spark.range(a, b).selectExpr("concat('e', id) as entity_id", "if(id % 3 = 0, null, concat('c/', id % 3)) as collection_id", "concat('s', id % 2) as schema_name", "cast(id as int) as n")


def test_a_write_is_seen_whole_or_not_at_all(spark, tmp_path):
    sinks.register(spark)
    path, schema = f"{tmp_path}/index", rows(spark, 0, 1).schema
    assert sinks.read(spark, path, schema).count() == 0
    rows(spark, 0, 60).repartition(4).write.format("skein_index").mode("append").option("path", path).save()
    assert sorted(r.n for r in sinks.read(spark, path, schema).collect()) == list(range(60))
    told = {(r.collection_id, r.schema_name): r.rows for r in sinks.counts(spark, path).collect()}
    assert sum(told.values()) == 60 and told[("c/1", "s1")] == 10 and told[(None, "s0")] == 10
    bad = rows(spark, 60, 100).repartition(4).withColumn("entity_id", F.when(F.col("n") == 77, None).otherwise(F.col("entity_id")))
    with pytest.raises(Exception, match="without an entity id"):
        bad.write.format("skein_index").mode("append").option("path", path).save()
    assert sinks.read(spark, path, schema).count() == 60
    sinks.swept(spark, path)
    left = [f for d, _, names in os.walk(f"{path}/files") for f in names if f.endswith(".parquet")]
    assert len(left) == sinks.manifests(spark, path).count()
    assert {r.collection_id for r in sinks.read(spark, path, schema, "c/2").collect()} == {"c/2"}


def test_a_streamed_batch_is_added_once(spark, tmp_path):
    sinks.register(spark)
    path, schema = f"{tmp_path}/index", rows(spark, 0, 1).schema
    rows(spark, 0, 30).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in").writeStream.format("skein_index").option("path", path).option("stream", "run")
    stream().option("checkpointLocation", f"{tmp_path}/one").trigger(availableNow=True).start().awaitTermination()
    # The same stream from its beginning, as if its checkpoint had been lost before the batch was marked as done.
    stream().option("checkpointLocation", f"{tmp_path}/two").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.n for r in sinks.read(spark, path, schema).collect()) == list(range(30))
    assert all(os.path.getsize(f"{path}/{r.file}") for r in sinks.manifests(spark, path).collect())


def plain_flushes(amounts, pending, threshold):
    out = []
    for a in amounts:
        pending += a
        if pending >= threshold:
            out.append(pending)
            pending = 0
    return out, pending


@pytest.mark.parametrize("seed", range(20))
def test_flushes_equal_a_plain_log(seed):
    r = random.Random(seed)
    amounts = [r.choice([0, 1, 2, 5, 30]) for _ in range(r.randint(0, 60))]
    threshold = r.choice([1, 7, 20, 1000])
    pending = r.randint(0, threshold - 1)
    assert usage.flushes(np.array(amounts, np.int64), pending, threshold) == plain_flushes(amounts, pending, threshold)


def test_usage_goes_by_count_and_by_time(spark, tmp_path):
    kinds = "organization_id long, action string, amount long, seq long"
    at, got = f"{tmp_path}/in", []
    spark.createDataFrame([(1, "queries", 4, 1), (1, "queries", 7, 2), (1, "queries", 3, 3), (2, "queries", 2, 4), (2, "unknown", 1, 5)], kinds).coalesce(1).write.parquet(at)
    with state_store(spark):
        stream = usage.flushed(spark.readStream.schema(kinds).parquet(at), wait=2.0)
        q = stream.writeStream.foreachBatch(lambda b, n: got.extend(tuple(r) for r in b.collect())).option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="500 milliseconds").start()
        try:
            # Timers keep batches coming, so there is no end to wait for.
            until = time.time() + 60
            while len(got) < 2 and time.time() < until:
                time.sleep(0.1)
            assert sorted(got)[:2] == [(1, "queries", 11, "threshold"), (2, "unknown", 1, "threshold")] or len(got) > 2
            while len(got) < 4 and time.time() < until:
                time.sleep(0.2)
        finally:
            q.stop()
    assert sorted(got)[1:] and set(got) == {(1, "queries", 11, "threshold"), (2, "unknown", 1, "threshold"), (1, "queries", 3, "time"), (2, "queries", 2, "time")}


@pytest.mark.parametrize("seed", range(3))
def test_counts_clip_at_every_step(spark, seed):
    r = random.Random(seed)
    steps = [(r.choice("ab"), r.choice(["T", "T", "T", "U", None]), k // 2, r.choice([-1, 1, -3])) for k in range(400)]
    stored = {("a", "T"): 2, ("b", "U"): 1, ("c", "T"): 4}
    want = dict(stored)
    for s, t, q, d in sorted(steps, key=lambda x: (x[2], x[3])):
        if t is not None:
            want[(s, t)] = max(want.get((s, t), 0) + d, 0)
    r.shuffle(steps)
    df = spark.createDataFrame(steps, "sync_id string, entity_type string, seq long, delta long").repartition(5)
    before = spark.createDataFrame([(*k, n) for k, n in stored.items()], "sync_id string, entity_type string, n long")
    got = {(x.sync_id, x.entity_type): x.n for x in counts.counts_after(before, df).collect()}
    assert got == {k: n for k, n in want.items() if n}
    none = before.limit(0)
    assert [tuple(x) for x in counts.counts_after(none, spark.createDataFrame([("a", "T", 1, -1), ("a", "T", 2, 1)], df.schema)).collect()] == [("a", "T", 1)]
    assert counts.counts_after(none, df.limit(0)).count() == 0


def test_counts_as_they_come(spark, tmp_path):
    kinds = "sync_id string, entity_type string, seq long, delta long"
    parts = [[("a", "T", 2, 1), ("a", "T", 1, -1), ("b", "T", 1, 1)], [("a", "T", 4, -1), ("a", "T", 3, -1)], [("a", "T", 5, 1), ("a", None, 6, 1)]]
    got = []
    with state_store(spark):
        for part in parts:
            spark.createDataFrame(part, kinds).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = counts.running_counts(spark.readStream.schema(kinds).parquet(f"{tmp_path}/in"))
            drained(stream, lambda b, n: got.append({(r.sync_id, r.entity_type): r.n for r in b.collect()}), f"{tmp_path}/state")
    assert [g for g in got if g] == [{("a", "T"): 1, ("b", "T"): 1}, {("a", "T"): 0}, {("a", "T"): 1}]
