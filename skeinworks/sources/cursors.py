"""An incremental source as a stream: rows of a table past a cursor, in steps, each once.

`spark.readStream.format("skein_cursor")` with options `path` (Parquet), `cursor` (an integer column of it), and a schema: the columns that are
read. `step` bounds a micro-batch to so many cursor values, `parts` cuts it into partitions, `saved` names a file in which the
position is kept after each batch has been written: a new query without a checkpoint begins there, so a sync that comes later
reads what is new only. With a checkpoint, Spark asks for a batch that was not finished again with its old ends, and gets the
same rows, as long as rows below the cursor's end do not change. Rows without a cursor value are not read.

The driver looks at the files' statistics for the last value, never at rows; tasks read the row groups of their range only.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyarrow.dataset as ds
import pyarrow.fs as fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def opened(path: str) -> ds.Dataset:
    system, inner = _at(path)
    return ds.dataset(inner, filesystem=system, format="parquet")


def last_value(data: ds.Dataset, cursor: str) -> int:
    """The greatest value of the column by the statistics of row groups, -1 without rows; groups without statistics are read."""
    most = -1
    for fragment in data.get_fragments():
        for group in fragment.split_by_row_group():
            told = next((g.statistics.get(cursor) for g in group.row_groups if g.statistics), None)
            if told is None:
                column = group.to_table(schema=data.schema, columns=[cursor]).column(0)
                told = {"max": pa.compute.max(column).as_py() if len(column) else None}
            if told["max"] is not None:
                most = max(most, int(told["max"]))
    return most


def saved_cursor(path: str | None) -> int:
    if not path:
        return -1
    system, inner = _at(path)
    if system.get_file_info(inner).type == fs.FileType.NotFound:
        return -1
    with system.open_input_stream(inner) as f:
        return int(json.loads(f.read())["cursor"])


def save_cursor(path: str, value: int) -> None:
    """Written beside the file and moved over it, so that a reader sees the old or the new value."""
    system, inner = _at(path)
    with system.open_output_stream(inner + ".new") as f:
        f.write(json.dumps({"cursor": value}).encode())
    system.move(inner + ".new", inner)


class _Range(InputPartition):
    def __init__(self, after: int, upto: int):
        self.after, self.upto = after, upto


class CursorSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "skein_cursor"

    def schema(self) -> str:
        raise ValueError("name the columns to read by .schema(...)")

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return CursorReader(self.options, schema)


class CursorReader(DataSourceStreamReader):
    def __init__(self, options, schema: T.StructType):
        self.path, self.cursor, self.saved = options["path"], options["cursor"], options.get("saved")
        self.step, self.parts = int(options.get("step", "0")), int(options.get("parts", "4"))
        self.columns, self.arrow = schema.fieldNames(), to_arrow_schema(schema)
        self.at: int | None = None

    def initialOffset(self) -> dict:
        self.at = saved_cursor(self.saved)
        return {"cursor": self.at}

    def latestOffset(self) -> dict:
        """Not before the last end that was asked for, and at most a step beyond it."""
        if self.at is None:
            self.at = saved_cursor(self.saved)
        end = last_value(opened(self.path), self.cursor)
        self.at = max(self.at, min(end, self.at + self.step) if self.step else end)
        return {"cursor": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        after, upto = int(start["cursor"]), int(end["cursor"])
        self.at = max(upto, self.at if self.at is not None else upto)
        width = max(1, -(-(upto - after) // self.parts))
        return [_Range(a, min(a + width, upto)) for a in range(after, upto, width)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        past = (ds.field(self.cursor) > partition.after) & (ds.field(self.cursor) <= partition.upto)
        for batch in opened(self.path).to_batches(columns=self.columns, filter=past, batch_size=4096):
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, self.arrow, strict=True)], schema=self.arrow)

    def commit(self, end: dict) -> None:
        if self.saved:
            save_cursor(self.saved, int(end["cursor"]))

    def stop(self) -> None:
        pass


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CursorSource)
