"""An index sink whose writes are seen whole or not at all, for batches and streams.

`df.write.format("skein_index").option("path", ...)`, or `writeStream`: tasks write files under `files/<collection>/<schema>/`, and tell the driver their
names and rows. The commit writes one manifest under `commits/`, with the files and the rows by collection and schema; readers know
files by manifests only, so rows become visible at once. An abort deletes the files of the tasks that told of theirs; what a lost task
left is in no manifest, and `swept` deletes it. A streamed batch has its number in its manifest's name, so a batch that comes again after a
failure finds its manifest and adds nothing. A row without an entity id fails the write.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage

from .cursors import _at
from .scratch import exists

KEYS = ("collection_id", "schema_name")
#: Rows in one file of a task, collection and schema, at most; rows held by a task until they are written.
FILE_ROWS, HELD_ROWS = 1_000_000, 50_000


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


class IndexSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "skein_index"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("the index is appended to")
        return IndexWriter(self.options["path"], uuid.uuid4().hex)

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        return IndexStreamWriter(self.options["path"], self.options.get("stream", "stream"))


def _written(path: str, batches: Iterator[pa.RecordBatch]) -> Written:
    """A file for each collection and schema that the task has, opened when it first comes."""
    system, inner = _at(path)
    task = TaskContext.get()
    mark = f"{task.partitionId() if task else 0}-{uuid.uuid4().hex}"
    open_now: dict[tuple, tuple[pq.ParquetWriter, dict]] = {}
    files: list[dict] = []

    def closed(key: tuple) -> None:
        writer, told = open_now.pop(key)
        writer.close()

    try:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if table.column("entity_id").null_count:
                raise ValueError("rows without an entity id")
            pairs = table.select(list(KEYS)).group_by(list(KEYS)).aggregate([])
            for key in zip(*(pairs.column(k).to_pylist() for k in KEYS), strict=True):
                mask = None
                for name, value in zip(KEYS, key, strict=True):
                    own = pa.compute.is_null(table.column(name)) if value is None else pa.compute.fill_null(pa.compute.equal(table.column(name), value), False)
                    mask = own if mask is None else pa.compute.and_(mask, own)
                part = table.filter(mask)
                if key in open_now and open_now[key][1]["rows"] >= FILE_ROWS:
                    closed(key)
                if key not in open_now:
                    folder = "/".join(quote("" if v is None else str(v), safe="") or "_" for v in key)
                    name = f"files/{folder}/{mark}-{len(files)}.parquet"
                    system.create_dir(f"{inner}/files/{folder}", recursive=True)
                    told = {"file": name, "rows": 0, **dict(zip(KEYS, key, strict=True))}
                    files.append(told)
                    open_now[key] = (pq.ParquetWriter(f"{inner}/{name}", part.schema, filesystem=system), told)
                open_now[key][0].write_table(part)
                open_now[key][1]["rows"] += part.num_rows
        for key in list(open_now):
            closed(key)
    except BaseException:
        # A task that fails takes its own files along.
        for key in list(open_now):
            closed(key)
        _deleted(path, files)
        raise
    return Written(files)


def _deleted(path: str, files: list[dict]) -> None:
    system, inner = _at(path)
    for f in files:
        if system.get_file_info(f"{inner}/{f['file']}").type != fs.FileType.NotFound:
            system.delete_file(f"{inner}/{f['file']}")


def _committed(path: str, name: str, messages: list[Written | None]) -> None:
    system, inner = _at(path)
    at = f"{inner}/commits/{name}.json"
    system.create_dir(f"{inner}/commits", recursive=True)
    files = [f for m in messages if m is not None for f in m.files]
    if system.get_file_info(at).type != fs.FileType.NotFound:
        _deleted(path, files)  # this batch was committed before
        return
    with system.open_output_stream(f"{inner}/commits/_{name}.new") as f:
        f.write("".join(json.dumps(x) + "\n" for x in files).encode())
    system.move(f"{inner}/commits/_{name}.new", at)


def _aborted(path: str, messages: list[Written | None]) -> None:
    for m in messages:
        if m is not None:
            _deleted(path, m.files)


class IndexWriter(DataSourceArrowWriter):
    def __init__(self, path: str, name: str):
        self.path, self.commit_name = path, f"write-{name}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return _written(self.path, iterator)

    def commit(self, messages: list[Written | None]) -> None:
        _committed(self.path, self.commit_name, messages)

    def abort(self, messages: list[Written | None]) -> None:
        _aborted(self.path, messages)


class IndexStreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str, stream: str):
        self.path, self.stream = path, stream

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return _written(self.path, iterator)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        _committed(self.path, f"{self.stream}-{batchId}", messages)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        _aborted(self.path, messages)


_MANIFEST = "file string, rows long, collection_id string, schema_name string"


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """(file, rows, collection_id, schema_name) of all committed writes, from their messages; no file of rows is opened."""
    if not exists(spark, f"{path}/commits"):
        return spark.createDataFrame([], _MANIFEST)
    return spark.read.schema(_MANIFEST).option("pathGlobFilter", "*.json").json(f"{path}/commits")


def counts(spark: SparkSession, path: str) -> DataFrame:
    """Rows by collection and schema."""
    return manifests(spark, path).groupBy("collection_id", "schema_name").agg(F.sum("rows").alias("rows"))


def read(spark: SparkSession, path: str, schema: T.StructType, collection_id: str | None = None) -> DataFrame:
    """The rows of committed writes, of one collection or all. The names of files come to the driver, as Spark's own listing would."""
    files = manifests(spark, path)
    files = files if collection_id is None else files.where(F.col("collection_id") == collection_id)
    names = [f"{path}/{r[0]}" for r in files.select("file").collect()]
    return spark.read.schema(schema).parquet(*names) if names else spark.createDataFrame([], schema)


def swept(spark: SparkSession, path: str) -> int:
    """Deletes files that no commit names; to be run while nothing writes. Gives their number."""
    system, inner = _at(path)
    known = {r[0] for r in manifests(spark, path).select("file").collect()}
    left = [f.path for f in system.get_file_info(fs.FileSelector(f"{inner}/files", recursive=True, allow_not_found=True)) if f.type == fs.FileType.File]
    gone = [f for f in left if f[f.index("files/", len(inner)) :] not in known]
    for f in gone:
        system.delete_file(f)
    return len(gone)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(IndexSink)
