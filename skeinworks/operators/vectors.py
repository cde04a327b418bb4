"""Nearest neighbours by angle over a stored index: vectors in lists around coarse centroids, of which a query reads few.

Layout under a path: `columns` (no row), `centroids` (list, centroid), `rows/list=<n>` (the vectors and whatever columns came with them, with
`written_at`), `lists` (per write and list: rows and radius, the largest angle between the list's centroid and a vector in it) and
`deleted` (keys with `deleted_at`). Centroids are learnt on a bounded sample, every row is indexed. Rows that come later go
to the lists that are there; a deletion is a row of keys that readers subtract from what was written before it.

A search ranks the lists by the angle between query and centroid, reads the folders of the nearest `probes` of them, and scores what is
there exactly. With `exact`, the k-th best angle then tells which of the other lists can hold anything nearer (angle to the centroid
less radius), and those are read too, so the result is that of a full scan. Queries go out to the tasks in blocks of at most
QUERY_BLOCK; a task keeps the k best for each query, and only those are shuffled.

How many lists must be probed depends on the data: `calibrated` asks a bounded sample of the index's own vectors for their true
neighbours and keeps the least number of probes that finds the wished share of them.

A vector that is null, of another length, of no length, or not finite is in no list, and is near to nothing.
"""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import exists, stored

#: Lists: the square root of the number of vectors, at most MOST_LISTS.
MOST_LISTS = 16_384
#: The sample that centroids are learnt on has so many vectors a list, whatever the table's size.
SAMPLE_PER_LIST = 256
ROUNDS = 10
#: Lists that a query probes where the index was not calibrated.
PROBES = 8
#: Vectors asked for their true neighbours, and the share of those that probes must find.
CALIBRATED_BY, RECALL = 128, 0.95
#: Queries that go out to all tasks at once.
QUERY_BLOCK = 2048
#: Angles are compared with this much to spare, so that rounding leaves nothing out.
_SPARE = 1e-6


def units(vectors: pa.Array | Sequence[Sequence[float]]) -> np.ndarray:
    """Rows of one length as unit vectors of doubles."""
    if isinstance(vectors, pa.Array):
        x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    else:
        x = np.array(vectors, np.float64).reshape(len(vectors), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True) if x.size else x


def usable(vector: str, size: int | None = None) -> Column:
    """Whether the column has a whole vector of finite numbers (of `size`) with a length."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(fine & (F.size(v) == size) if size is not None else fine, F.lit(False))


@dataclass
class Lists:
    """What a search needs to know of an index: centroids as unit rows, and each list's rows and radius."""

    path: str
    numbers: np.ndarray
    centroids: np.ndarray
    rows: np.ndarray
    radius: np.ndarray

    def angles(self, queries: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(queries @ self.centroids.T, -1.0, 1.0))


def _assigning(centroids: np.ndarray, vector: str):
    """Arrow batches with `list` and `angle`, to the nearest centroid; ties to the smaller number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = units(batch.column(batch.schema.get_field_index(vector)))
            cosines = x @ centroids.T if len(x) else np.zeros((0, len(centroids)))
            number = cosines.argmax(axis=1) if len(x) else np.zeros(0, np.int64)
            angle = np.arccos(np.clip(cosines[np.arange(len(x)), number], -1.0, 1.0))
            yield batch.append_column("list", pa.array(number, pa.int32())).append_column("angle", pa.array(angle, pa.float64()))

    return run


def _assigned(rows: DataFrame, centroids: np.ndarray, vector: str) -> DataFrame:
    schema = T.StructType([*rows.schema.fields, T.StructField("list", T.IntegerType()), T.StructField("angle", T.DoubleType())])
    return rows.mapInArrow(_assigning(centroids, vector), schema)


def learn(rows: DataFrame, ident: str, vector: str, lists: int | None = None, rounds: int = ROUNDS) -> np.ndarray:
    """Coarse centroids by k-means on the sphere: a round is a job over the sample that sends one row a centroid and task."""
    count = rows.count()
    if not count:
        return np.zeros((0, 0))
    lists = max(1, min(lists or int(count**0.5), MOST_LISTS, count))
    share = min(1.0, SAMPLE_PER_LIST * lists / count)
    mark = F.xxhash64(F.col(ident).cast("string"))
    chosen = stored(rows.where(F.pmod(mark, F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select(F.col(vector).alias("v"), mark.alias("h")))
    centroids = units([r.v for r in chosen.orderBy("h", "v").limit(lists).collect()])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(centroids)
        for batch in batches:
            x = units(batch.column(0))
            if len(x):
                np.add.at(total, (x @ centroids.T).argmax(axis=1), x)
        have = np.flatnonzero(np.abs(total).sum(axis=1))
        yield pa.record_batch([pa.array(have, pa.int32()), pa.array(list(total[have]), pa.list_(pa.float64()))], names=["list", "s"])

    def added(table: pa.Table) -> pa.Table:
        total = np.array(table.column("s").to_pylist(), np.float64).sum(axis=0)
        return pa.table({"list": table.column("list").slice(0, 1), "s": pa.array([total.tolist()], pa.list_(pa.float64()))})

    kinds = "list int, s array<double>"
    for _ in range(rounds):
        found = chosen.select("v").mapInArrow(sums, kinds).groupBy("list").applyInArrow(added, kinds).collect()  # lists x components
        moved = centroids.copy()
        for number, total in found:
            norm = float(np.linalg.norm(total))
            if norm > 0:
                moved[number] = np.array(total) / norm
        if np.array_equal(moved, centroids):
            break
        centroids = moved
    return centroids


def build(rows: DataFrame, ident: str, vector: str, path: str, lists: int | None = None, rounds: int = ROUNDS) -> None:
    """A new index of all usable vectors at a path that nothing has used."""
    spark = rows.sparkSession
    first = rows.where(usable(vector)).orderBy(ident).select(F.size(vector)).limit(1).collect()
    fit = rows.where(usable(vector, first[0][0] if first else 0))
    centroids = learn(fit, ident, vector, lists, rounds)
    table = pa.table({"list": pa.array(range(len(centroids)), pa.int32()), "centroid": pa.array(centroids.tolist(), pa.list_(pa.float64()))})
    spark.createDataFrame(table).coalesce(1).write.parquet(f"{path}/centroids")
    # No row, but the columns: an index without vectors can be read, too.
    rows.limit(0).withColumns({"written_at": F.lit(0).cast("long"), "list": F.lit(0)}).write.parquet(f"{path}/columns")
    add(rows, vector, path)


def add(rows: DataFrame, vector: str, path: str) -> None:
    """Rows to the lists of their nearest centroids."""
    spark = rows.sparkSession
    known = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()
    centroids = np.array([r.centroid for r in known], np.float64)
    at = int(time.time() * 1e6)
    put = stored(_assigned(rows.where(usable(vector, centroids.shape[1])), centroids, vector)) if len(known) else stored(rows.limit(0).withColumns({"list": F.lit(0), "angle": F.lit(0.0)}))
    clustered = put.drop("angle").withColumn("written_at", F.lit(at)).hint("rebalance", "list").sortWithinPartitions("list")
    clustered.write.mode("append").partitionBy("list").parquet(f"{path}/rows")
    told = put.groupBy("list").agg(F.count(F.lit(1)).alias("rows"), F.max("angle").alias("radius"))
    told.coalesce(1).write.mode("append").parquet(f"{path}/lists")


def remove(keys: DataFrame, path: str) -> None:
    """Rows with these keys (all columns of `keys`) that were written until now are gone."""
    at = int(time.time() * 1e6)
    keys.distinct().withColumn("deleted_at", F.lit(at)).write.mode("append").parquet(f"{path}/deleted/{'+'.join(sorted(keys.columns))}")


def opened(spark: SparkSession, path: str) -> Lists:
    """At most MOST_LISTS rows come to the driver."""
    own = spark.read.parquet(f"{path}/centroids")
    told = spark.read.parquet(f"{path}/lists").groupBy("list").agg(F.sum("rows").alias("rows"), F.max("radius").alias("radius"))
    found = own.join(told, "list").orderBy("list").collect()
    centroids = np.array([r.centroid for r in found], np.float64)
    return Lists(path, np.array([r.list for r in found], np.int64), centroids, np.array([r.rows for r in found], np.int64), np.array([r.radius for r in found], np.float64))


def stored_rows(spark: SparkSession, path: str, lists: Sequence[int] | None = None, ident: str = "entity_id") -> DataFrame:
    """The index's rows, of these lists only, without what was deleted after it was written: by id, by parent, or by sync."""
    rows = spark.read.schema(spark.read.parquet(f"{path}/columns").schema).parquet(f"{path}/rows")
    deleted_by = ((ident,), ("original_entity_id", "sync_id"), ("sync_id",))
    if lists is not None:
        rows = rows.where(F.col("list").isin([int(x) for x in lists]))
    for keys in deleted_by:
        folder = f"{path}/deleted/{'+'.join(sorted(keys))}"
        if all(k in rows.columns for k in keys) and exists(spark, folder):
            gone = spark.read.parquet(folder).groupBy(*keys).agg(F.max("deleted_at").alias("_gone"))
            rows = rows.join(gone, list(keys), "left").where(F.col("_gone").isNull() | (F.col("written_at") > F.col("_gone"))).drop("_gone")
    return rows.drop("written_at")


def _scored(rows: DataFrame, ident: str, vector: str, queries: np.ndarray, reads: list[set[int]], k: int) -> DataFrame:
    """(query, ident, score, list): the k best of each task for each query, among the lists that the query reads."""
    kinds = T.StructType([T.StructField("query", T.IntegerType()), T.StructField(ident, rows.schema[ident].dataType), T.StructField("score", T.DoubleType()), T.StructField("list", T.IntegerType())])
    who: dict[int, list[int]] = {}
    for q, own in enumerate(reads):
        for number in own:
            who.setdefault(number, []).append(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[float, object, int]]] = {}
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            numbers = batch.column(2).to_numpy()
            cut = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for a, b in zip(cut, cut[1:], strict=False):
                asking = who.get(int(numbers[a])) if b > a else None
                if not asking:
                    continue
                part = batch.slice(a, b - a)
                x = units(part.column(1))
                scores = 1 / (1 + np.arccos(np.clip(queries[asking] @ x.T, -1.0, 1.0)))
                for q, own in zip(asking, scores, strict=True):
                    have = best.get(q, [])
                    least = -have[-1][0] if len(have) == k else -1.0
                    if b - a > k:
                        least = max(least, np.partition(own, -k)[-k])
                    pick = np.flatnonzero(own >= least)
                    if len(pick):
                        names = part.column(0).take(pa.array(pick)).to_pylist()
                        best[q] = sorted([*have, *((-float(s), n, int(numbers[a])) for s, n in zip(own[pick], names, strict=True))])[:k]
        rows = [(q, n, -s, number) for q, own in best.items() for s, n, number in own]
        if rows:
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.int32())], names=["query", ident, "score", "list"])

    return rows.select(ident, vector, "list").mapInArrow(run, kinds)


def _best(found: DataFrame, ident: str, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), ident))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def nearest(spark: SparkSession, path: str, ident: str, vector: str, queries: Sequence[Sequence[float]], k: int, probes: int | None = None, exact: bool = False, where: Column | None = None, told: list[dict] | None = None) -> DataFrame:
    """(query, ident, score, list, rank): for each query, by its place, the k nearest rows that meet `where`; score is 1 / (1 + angle).

    Queries with fewer than k rows in their probed lists read more lists, until there are k or no more. `told` gets, for each
    block of queries, how many lists and rows there are and how many a query has read on average.
    """
    lists, out = opened(spark, path), None
    if probes is None:
        probes = spark.read.parquet(f"{path}/probes").agg(F.max("probes")).first()[0] if exists(spark, f"{path}/probes") else PROBES
    for a in range(0, len(queries), QUERY_BLOCK):
        block = units([list(q) for q in queries[a : a + QUERY_BLOCK]])
        found = _block(spark, lists, ident, vector, block, k, probes, exact, where, told).withColumn("query", F.col("query") + a)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else _best(_scored(stored_rows(spark, path, [], ident), ident, vector, np.zeros((0, 0)), [], k), ident, k)


def _block(spark: SparkSession, lists: Lists, ident: str, vector: str, queries: np.ndarray, k: int, probes: int, exact: bool, where: Column | None, told: list[dict] | None) -> DataFrame:
    angles = lists.angles(queries) if len(lists.numbers) else np.zeros((len(queries), 0))
    order, total = np.argsort(angles, axis=1, kind="stable"), angles.shape[1]
    done = [set() for _ in queries]
    next_up = [set(lists.numbers[o[:probes]].tolist()) for o in order]
    found, part = None, None
    while part is None or any(next_up):
        rows = stored_rows(spark, lists.path, sorted(set().union(*next_up)), ident)
        rows = rows if where is None else rows.where(where)
        part = _scored(rows, ident, vector, queries, next_up, k)
        # Stored: the next step asks how far the queries have come, and does not read the lists again.
        found = stored(_best(part if found is None else part.unionByName(found.drop("rank")), ident, k))
        for own, more in zip(done, next_up, strict=True):
            own |= more
        reached = {r["query"]: (r["n"], r["least"]) for r in found.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).collect()}
        next_up = []
        for q, own in enumerate(done):
            n, least = reached.get(q, (0, None))
            if n < k:
                more = set(lists.numbers[order[q][: 2 * len(own)]].tolist()) - own
            elif exact:
                # Nearer than the k-th best can only be what may be within its angle.
                near = np.maximum(angles[q] - lists.radius, 0) <= 1 / least - 1 + _SPARE
                more = set(lists.numbers[near].tolist()) - own
            else:
                more = set()
            next_up.append(more if len(own) < total else set())
    if told is not None:
        size = dict(zip(lists.numbers.tolist(), lists.rows.tolist(), strict=True))
        each = max(len(queries), 1)
        told.append({"lists": total, "rows": int(lists.rows.sum()), "lists_read": sum(map(len, done)) / each, "rows_read": sum(size[x] for own in done for x in own) / each})
    return found


def calibrated(spark: SparkSession, path: str, ident: str, vector: str, k: int = 10, recall: float = RECALL) -> int:
    """The least number of probes with which CALIBRATED_BY vectors of the index, chosen by a hash of their ids, find the share `recall` of
    their k true neighbours; kept with the index, for searches that name no number."""
    asked = stored_rows(spark, path, ident=ident).orderBy(F.xxhash64(F.col(ident).cast("string"), F.lit(1)), ident).select(vector).limit(CALIBRATED_BY).collect()
    lists = opened(spark, path)
    if not asked:
        return PROBES
    found = nearest(spark, path, ident, vector, [r[0] for r in asked], k, PROBES, exact=True).select("query", "list").collect()
    place = np.argsort(np.argsort(lists.angles(units([list(r[0]) for r in asked])), axis=1, kind="stable"), axis=1)
    at = {int(n): j for j, n in enumerate(lists.numbers)}
    needed = np.sort([int(place[r["query"], at[r["list"]]]) + 1 for r in found])
    probes = int(needed[max(int(np.ceil(recall * len(needed))) - 1, 0)])
    spark.createDataFrame([(probes,)], "probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/probes")
    return probes
