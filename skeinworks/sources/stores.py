"""Reading and writing of entity rows: raw store, snapshots, index, incremental and generated sources."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor, as_completed

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .scratch import create_text, exists, matching, stored


# Raw store: JSON rows under raw/<sync>/entities, a folder a job and, inside it, a folder a bucket of entity ids. Nothing is changed in
# place: a row written later replaces earlier ones of its entity, and a deletion is a row of its own, until `compact_raw` writes the
# newest rows anew. raw/<sync>/buckets holds the number of buckets, which is settled by the first write. raw/<sync>/compacted names the
# folder of a compaction, in which each entity is once: while no other folder stands beside it, readers compare no versions.
RAW_BUCKETS = 32


def _now() -> Column:
    """Microseconds since 1970: one time for all rows of a write."""
    return F.unix_micros(F.current_timestamp())


def raw_buckets(spark: SparkSession, root: str, sync_id: str, wanted: int | None = None) -> int:
    """Number of buckets of a sync's raw store; wanted settles it where nothing is stored yet (of two first writers, one does)."""
    path = f"{root}/raw/{sync_id}/buckets"
    if wanted is not None:
        create_text(spark, path, str(wanted))
    return int(spark.read.text(path).first()[0])


def _bucket(entity_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(entity_id), F.lit(buckets)).cast("int")


def _append_raw(rows: DataFrame, root: str, sync_id: str, job_id: str, buckets: int) -> None:
    """A bucket goes to as few files as its size allows."""
    buckets = raw_buckets(rows.sparkSession, root, sync_id, buckets)
    dealt = rows.withColumn("bucket", _bucket(F.col("entity_id"), buckets)).hint("rebalance", "bucket")
    dealt.write.mode("append").partitionBy("bucket").json(f"{root}/raw/{sync_id}/entities/job={job_id}")


def write_raw(rows: DataFrame, root: str, sync_id: str, job_id: str, buckets: int = RAW_BUCKETS) -> None:
    """Rows become the newest versions of their entities. buckets matters to the first write of a sync only."""
    stamped = rows.withColumns({"sync_job_id": F.lit(job_id), "stored_at": _now(), "deleted": F.lit(False)})
    _append_raw(stamped, root, sync_id, job_id, buckets)


def delete_raw(ids: DataFrame, root: str, sync_id: str, job_id: str, buckets: int = RAW_BUCKETS) -> None:
    """The entities (entity_id) are gone from now on; a later write brings one back."""
    stamped = ids.select("entity_id").distinct().withColumns({"sync_job_id": F.lit(job_id), "stored_at": _now(), "deleted": F.lit(True)})
    _append_raw(stamped, root, sync_id, job_id, buckets)


def _newest(rows: DataFrame) -> DataFrame:
    rest = [c for c in rows.columns if c not in ("entity_id", "job", "bucket")]
    newest = rows.groupBy("entity_id").agg(F.max_by(F.struct(*rest), F.struct("stored_at", "deleted", "sync_job_id")).alias("_r"))
    return newest.select("entity_id", "_r.*").where(~F.coalesce("deleted", F.lit(False))).drop("deleted")


def read_raw(spark: SparkSession, root: str, sync_id: str, schema: T.StructType) -> DataFrame:
    """Newest version of each stored entity that is not deleted; of versions of one moment, that of the larger job id."""
    folder, path = f"{root}/raw/{sync_id}/entities", f"{root}/raw/{sync_id}/compacted"
    jobs = [x.rsplit("/", 1)[-1] for x in matching(spark, f"{folder}/job=*")]
    if len(jobs) == 1 and exists(spark, path) and jobs == [f"job={spark.read.text(path).first()[0]}"]:
        # The folder alone is read, so that a write meanwhile adds no second version.
        rows = spark.read.schema(schema).json(f"{folder}/{jobs[0]}")
        return rows.select("entity_id", *(c for c in rows.columns if c not in ("entity_id", "deleted", "job", "bucket")))
    return _newest(spark.read.schema(schema).json(folder))


def raw_schema(schema: T.StructType) -> T.StructType:
    """Schema of stored rows: the entity's, its job, when it was stored, and whether the row is a deletion."""
    have = {f.name for f in schema.fields}
    more = [T.StructField(n, kind) for n, kind in (("sync_job_id", T.StringType()), ("stored_at", T.LongType()), ("deleted", T.BooleanType())) if n not in have]
    return T.StructType([*schema.fields, *more])


def compact_raw(spark: SparkSession, root: str, sync_id: str, schema: T.StructType, target: str, buckets: int | None = None) -> None:
    """The raw store of a sync with the newest versions only, under another root; buckets may change on the way."""
    rows = read_raw(spark, root, sync_id, schema).withColumn("deleted", F.lit(False))
    job_id = f"compacted-{uuid.uuid4().hex}"
    _append_raw(rows, target, sync_id, job_id, buckets or raw_buckets(spark, root, sync_id))
    create_text(spark, f"{target}/raw/{sync_id}/compacted", job_id)


def raw_rows_of(spark: SparkSession, root: str, sync_id: str, schema: T.StructType, entity_id: str) -> DataFrame:
    """All stored versions of one entity; only the files of its bucket are listed and opened."""
    bucket = spark.range(1).select(_bucket(F.lit(entity_id), raw_buckets(spark, root, sync_id))).first()[0]
    folder = f"{root}/raw/{sync_id}/entities"
    # A bucket that no job has written has no folder, and the store may hold no job at all.
    paths = matching(spark, f"{folder}/job=*/bucket={bucket}")
    rows = spark.read.schema(schema).option("basePath", folder).json(paths) if paths else spark.createDataFrame([], schema)
    return rows.where(F.col("entity_id") == entity_id)


def raw_entity(spark: SparkSession, root: str, sync_id: str, schema: T.StructType, entity_id: str) -> DataFrame:
    """One entity, or no row if it is not stored."""
    return _newest(raw_rows_of(spark, root, sync_id, schema, entity_id))


def snapshot(rows: DataFrame, prefix: str = "snapshot:") -> DataFrame:
    """Rows of a stored snapshot as a source of their own: the source's name says where they come from."""
    return rows.withColumn("source_name", F.concat(F.lit(prefix), "source_name"))


def manifest(jobs: DataFrame) -> DataFrame:
    """Jobs of each sync, each once, in order of first appearance."""
    first = jobs.groupBy("sync_id", "job_id").agg(F.min("created_at").alias("at"))
    return first.groupBy("sync_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "job_id"))), lambda x: x["job_id"]).alias("sync_jobs"))


def read_files(spark: SparkSession, root: str, extensions: list[str]) -> DataFrame:
    """Files with an allowed extension: path, size, SHA-256 and content."""
    glob = "*.{" + ",".join(sorted(extensions)) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)
    return hashed_files(files.select("path", F.col("length").alias("size"), "content"))


def hashed_files(files: DataFrame) -> DataFrame:
    """files with `file_hash`, the SHA-256 of their content."""
    return files.withColumn("file_hash", F.sha2("content", 256))


def fetched(items: DataFrame, key: str, fetch: Callable[[str], bytes], at_once: int = 16, ordered: bool = True) -> DataFrame:
    """items with `content`, what fetch gives for their key, and `error`, null unless it failed: an item's fault costs its row
    only. Each task waits for up to `at_once` answers together; rows leave in their order, or as answers come."""

    def one(row: dict) -> dict:
        try:
            return row | {"content": fetch(row[key]), "error": None}
        except Exception as e:  # noqa: BLE001  any fault of the source is the row's
            return row | {"content": None, "error": f"{type(e).__name__}: {e}"}

    schema = T.StructType([*items.schema.fields, T.StructField("content", T.BinaryType()), T.StructField("error", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(at_once) as pool:
            for batch in it:
                for a in range(0, batch.num_rows, 8 * at_once):
                    rows = batch.slice(a, 8 * at_once).to_pylist()
                    done = pool.map(one, rows) if ordered else (f.result() for f in as_completed([pool.submit(one, r) for r in rows]))
                    yield pa.RecordBatch.from_pylist(list(done), schema=arrow)

    return items.mapInArrow(run, schema)


def unprocessed(rows: DataFrame, done: DataFrame, key: str = "entity_id") -> DataFrame:
    return rows.join(done.select(key).distinct(), key, "left_anti")


def since(rows: DataFrame, cursor: str, last) -> DataFrame:
    """Rows past a stored cursor; None reads all."""
    return rows if last is None else rows.where(F.col(cursor) > F.lit(last))


def selected(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of the chosen nodes of a browse tree."""
    return rows.join(nodes.select("node_id").distinct(), "node_id", "left_semi")


def browse_children(nodes: DataFrame, parent: str | None) -> DataFrame:
    """Direct children (node_id, parent_id, title) of a node of a source's tree, or its roots, by title."""
    below = F.col("parent_id").isNull() if parent is None else F.col("parent_id") == parent
    return nodes.where(below).orderBy("title", "node_id")


def parsed_nodes(nodes: DataFrame) -> DataFrame:
    """nodes (node_id such as `kind:key=value;key=value`) with `node_type` and `node_metadata`, a map."""
    pairs = F.filter(F.split(F.substring_index("node_id", ":", -1), ";"), lambda x: x.contains("="))
    entries = F.transform(pairs, lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.regexp_extract(x, "^[^=]*=(.*)$", 1).alias("v")))
    return nodes.withColumns({"node_type": F.substring_index("node_id", ":", 1), "node_metadata": F.map_from_entries(entries)})


def replace_selections(rows: DataFrame, path: str) -> None:
    """Chosen nodes (connection_id, node_id, ...) take the place of all earlier ones of their connections; others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("connection_id").parquet(path)


def subtree(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen nodes and all below them, level by level."""
    front = stored(chosen.select("node_id").distinct())
    found, links = front, nodes.select("node_id", "parent_id")
    while True:
        step = links.join(front.select(F.col("node_id").alias("parent_id")), "parent_id").select("node_id").distinct()
        front = stored(step.join(found, "node_id", "left_anti"))
        if front.isEmpty():
            return found
        found = found.unionByName(front)


# Index: Parquet by collection, schema and write. Deletions are rows of keys beside it, which readers subtract from what was
# written before them, so a deletion costs as much as its keys; `compact_index` writes the rest anew.
def write_index(rows: DataFrame, path: str) -> int:
    """Rows appended by collection; raises before anything is written if one has no entity id, and after it unless as many
    rows are read back as were sent."""
    if rows.where(F.col("entity_id").isNull()).limit(1).count():
        raise ValueError("rows without an entity id")
    seen = Observation()
    at = int(time.time() * 1e6)
    stamped = rows.observe(seen, F.count(F.lit(1)).alias("n")).withColumn("written_at", F.lit(at))
    stamped.write.mode("append").partitionBy("collection_id", "schema_name", "written_at").parquet(f"{path}/rows")
    sent = seen.get["n"]
    came = rows.sparkSession.read.parquet(f"{path}/rows").where(F.col("written_at") == at).count()
    if came != sent:
        raise ValueError(f"{sent} rows were sent, {came} arrived")
    return sent


def delete_from_index(gone: DataFrame, path: str, keys: list[str]) -> None:
    """Rows with these keys that were written until now are gone."""
    at = int(time.time() * 1e6)
    gone.select(*keys).distinct().withColumn("deleted_at", F.lit(at)).write.mode("append").parquet(f"{path}/deleted/{'+'.join(sorted(keys))}")


def read_index(spark: SparkSession, path: str, collection_id: str | None = None, deleted_by: Sequence[Sequence[str]] = (("entity_id",), ("original_entity_id",), ("sync_id",))) -> DataFrame:
    """Rows of the index without what was deleted after they were written, by any of the kinds of keys in `deleted_by`."""
    rows = spark.read.parquet(f"{path}/rows")
    if collection_id is not None:
        rows = rows.where(F.col("collection_id") == collection_id)
    for keys in deleted_by:
        folder = f"{path}/deleted/{'+'.join(sorted(keys))}"
        if not exists(spark, folder):
            continue
        gone = spark.read.parquet(folder).groupBy(*keys).agg(F.max("deleted_at").alias("_gone"))
        rows = rows.join(gone, list(keys), "left").where(F.col("_gone").isNull() | (F.col("written_at") > F.col("_gone"))).drop("_gone")
    return rows.drop("written_at")


def compact_index(spark: SparkSession, path: str, target: str) -> int:
    """The index without deletions, at another path."""
    return write_index(read_index(spark, path), target)


class _Part(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class StubSource(DataSource):
    """Generated entities: options `seed`, `count`, `after` (a cursor), `partitions`, and `table`: entities or
    memberships (each user in one of ten groups, each group in the one before it). For tests of slow and broken sources:
    `rows_per_second` of each partition, and `fail_at`, the number of a row that cannot be read.

    A row depends on the seed and its number only, so any slice can be made anywhere and again.
    """

    @classmethod
    def name(cls) -> str:
        return "skein_stub"

    def schema(self) -> str:
        if self.options.get("table") == "memberships":
            return "member_id string, member_type string, group_id string"
        return "entity_id string, name string, kind string, content string, sequence_number int, created_at timestamp"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _StubReader(self.options)


class _StubReader(DataSourceReader):
    KINDS = [("small", 0.5), ("medium", 0.3), ("large", 0.2)]

    def __init__(self, options):
        self.seed, self.count = int(options.get("seed", "42")), int(options.get("count", "20"))
        self.table = options.get("table", "entities")
        self.fail_at, self.rate = int(options.get("fail_at", "-1")), float(options.get("rows_per_second", "0"))
        self.after, self.parts = int(options.get("after", "-1")), int(options.get("partitions", "4"))

    def partitions(self) -> list[InputPartition]:
        start = max(self.after + 1, 0)
        step = max(1, -(-(self.count - start) // self.parts))
        return [_Part(a, min(a + step, self.count)) for a in range(start, self.count, step)] or [_Part(0, 0)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        import datetime
        import hashlib

        for i in range(partition.start, partition.stop):
            if i == self.fail_at:
                raise RuntimeError(f"the source fails at row {i}, as asked")
            if self.rate > 0:
                time.sleep(1 / self.rate)
            if self.table == "memberships":
                yield (f"group-{i}", "group", f"group-{i - 1}") if 0 < i < 10 else (f"user-{i}", "user", f"group-{i % 10}")
                continue
            h = hashlib.sha256(f"{self.seed}:{i}".encode()).digest()
            share, kind = int.from_bytes(h[:4], "big") / 2**32, None
            for kind, p in self.KINDS:  # noqa: B007
                share -= p
                if share < 0:
                    break
            words = " ".join(h[4 + k : 6 + k].hex() for k in range({"small": 4, "medium": 10, "large": 24}[kind]))
            yield f"stub-{self.seed}-{i}", f"Stub {i}", kind, words, i, datetime.datetime(2024, 1, 1 + i % 28)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(StubSource)
