"""Tables that jobs of one computation hand to each other, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []
_written: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`; where it is unset, a temporary folder if all runs in one process, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="skeinworks-"))
    return _local[0]


def new_folder(spark: SparkSession) -> str:
    """A path in the shared folder that nothing has used yet."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    if _written:
        _written[-1].append(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """df as a written table: later jobs read files that outlive any executor instead of its lineage."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[list[str]]:
    """Folders made inside are deleted at the end, but for those that are taken out of the list."""
    _written.append([])
    try:
        yield _written[-1]
    finally:
        for path in _written.pop():
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that fit a pattern of the file system; none is no error."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(jvm_path)
    return [str(x.getPath()) for x in found or []]


def create_text(spark: SparkSession, path: str, value: str) -> None:
    """A small file with value, unless there is one already: it comes whole under its name, and the first writer's stays."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    target, draft = spark._jvm.org.apache.hadoop.fs.Path(path), spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    if fs.exists(target):
        return
    out = fs.create(draft)
    out.write(bytearray(value.encode()))
    out.close()
    if not fs.rename(draft, target):
        fs.delete(draft, False)
