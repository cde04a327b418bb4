"""Centroid clustering with annulus search (operator 11).

Lloyd's rounds on integer vectors. A vector that is nearer than `bound` to some centroid can only be nearest to one whose norm differs
from its own by no more than `bound`, by the triangle inequality. So centroids are sorted by norm, `bound` is the least distance to
the few centroids whose norms are nearest to the vector's, two binary searches give the run of centroids within it, both ends
included, and only those are compared exactly; of equally near ones the smaller number wins, wherever it stands in the run.

Spark holds the vectors, as written rows of integers; each round is one job in which tasks assign their batches and send one row a
centroid and batch of sums and counts, which Spark adds up. Only k centroids pass through the driver.

Defined cases: a null vector, one of another length, or one with a null or non-finite component is dropped; a component becomes
floor(1024 * x), held within +-2**27 so that every distance fits a long; fewer vectors than k give fewer centroids; an
empty table gives an empty result; rows that share an id are clustered each, and may seed several centroids in the order of their
components; a null id counts as the text `null`; all other columns are kept, and `cluster`, `distance` and `centroid` are replaced
if present.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read, stored

DIMENSIONS, CENTROIDS, ROUNDS, SCALE = 64, 8, 10, 1024
#: Components are held within this, beyond it distances might not fit 63 bits.
LIMIT = 1 << 27
#: Vectors compared at once.
_SLICE = 4096
#: Entries on each side of a vector's norm that give the first bound.
_PROBES = 2
_FAR = np.int64(2**63 - 1)


def quantized(df: DataFrame, column: str, dimensions: int | None = None) -> DataFrame:
    """df with `_v`, array<int>; rows without a whole vector of finite numbers (of `dimensions`) are dropped."""
    v = F.col(column)
    whole = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    if dimensions is not None:
        whole = whole & (F.size(v) == dimensions)
    held = lambda x: F.greatest(F.least(F.floor(x.cast("double") * SCALE), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int")
    return df.where(F.coalesce(whole, F.lit(False))).withColumn("_v", F.transform(v, held))


def matrix(vectors: pa.Array) -> np.ndarray:
    """Arrow lists of one length as rows of 64-bit integers."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(vectors), -1) if len(vectors) else flat.reshape(0, 0)


class Annulus:
    """Entries sorted by norm, for exact nearest-entry search."""

    def __init__(self, entries: np.ndarray):
        norms = np.sqrt((entries.astype(np.float64) ** 2).sum(axis=1))
        self.order = np.argsort(norms, kind="stable")
        self.norms, self.entries = norms[self.order], entries[self.order].astype(np.int64)

    def _squared(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        gap = x - self.entries[at]
        return np.einsum("ij,ij->i", gap, gap)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest entry to each row; ties to the smaller number."""
        number, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for a in range(0, len(x), _SLICE):
            number[a : a + _SLICE], distance[a : a + _SLICE] = self._some(x[a : a + _SLICE])
        return number, distance

    def _some(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        middle = np.searchsorted(self.norms, norm)
        number, best = np.zeros(len(x), np.int64), np.full(len(x), _FAR)
        for step in range(-_PROBES, _PROBES):
            at = np.clip(middle + step, 0, len(self.norms) - 1)
            found, own = self._squared(x, at), self.order[at]
            better = (found < best) | ((found == best) & (own < number))
            best, number = np.where(better, found, best), np.where(better, own, number)
        # A little wider than the bound, so that no rounding of a norm leaves out an entry on its edge.
        bound = np.sqrt(best.astype(np.float64))
        bound += 1e-9 * (bound + norm + self.norms[-1]) + 1e-6
        lo, hi = np.searchsorted(self.norms, norm - bound, "left"), np.searchsorted(self.norms, norm + bound, "right")
        for k in range(len(self.norms)):
            inside = np.flatnonzero((lo <= k) & (k < hi))
            if not len(inside):
                continue
            gap = x[inside] - self.entries[k]
            found = np.einsum("ij,ij->i", gap, gap)
            own = self.order[k]
            better = (found < best[inside]) | ((found == best[inside]) & (own < number[inside]))
            pick = inside[better]
            best[pick], number[pick] = found[better], own
        return number, best


def sums(number: np.ndarray, x: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts, componentwise sums) of the rows of each number."""
    total = np.zeros((count, x.shape[1]), np.int64)
    np.add.at(total, number, x)
    return np.bincount(number, minlength=count), total


def _partial(entries: np.ndarray):
    """Each Arrow batch as one row a centroid that it has: count and sums."""
    kinds = pa.schema([("c", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.int64()))])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Annulus(entries)
        for batch in rows:
            x = matrix(batch.column(0))
            if not len(x):
                continue
            n, s = sums(search.nearest(x)[0], x, len(entries))
            have = np.flatnonzero(n)
            yield pa.record_batch([pa.array(have, pa.int32()), pa.array(n[have], pa.int64()), pa.array(list(s[have]), pa.list_(pa.int64()))], schema=kinds)

    return run


def moved(vectors: DataFrame, entries: np.ndarray) -> np.ndarray:
    """Each entry's vectors' floor(sum / count); entries without a vector stay. `vectors` has the column `_v` only."""
    part = vectors.mapInArrow(_partial(entries), "c int, n long, s array<long>")
    part = part.select("c", "n", F.posexplode("s").alias("k", "x"))
    found = part.groupBy("c", "k").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()  # entries x components
    out = entries.copy()
    for c, k, n, x in found:
        out[c, k] = x // n
    return out


def seeds(vectors: DataFrame, id_column: str, count: int) -> np.ndarray:
    """The vectors with the smallest sha256 of `3:<id>`, in the order of their hashes."""
    mark = F.sha2(F.concat(F.lit("3:"), F.coalesce(F.col(id_column).cast("string"), F.lit("null"))), 256)
    first = vectors.select(mark.alias("h"), "_v").orderBy("h", "_v").limit(count).collect()
    return np.array([r._v for r in first], np.int64)


def clustered(df: DataFrame, column: str = "embedding", id_column: str = "vec_id", count: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS) -> DataFrame:
    """df's whole vectors with `cluster` (its number), `distance` (squared) and `centroid` (array<long>)."""
    rows = stored(quantized(df.drop("cluster", "distance", "centroid", "_v"), column, dimensions))
    plain = rows.select("_v")
    entries = seeds(rows, id_column, count)
    if len(entries):
        for _ in range(rounds):
            entries = moved(plain, entries)
    kinds = "cluster int, distance long, centroid array<bigint>"
    schema = T.StructType([f for f in rows.schema.fields if f.name != "_v"] + T._parse_datatype_string(kinds).fields)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, own = Annulus(entries), [c.tolist() for c in entries]
        for batch in batches:
            number, distance = search.nearest(matrix(batch.column(batch.schema.get_field_index("_v"))))
            out = batch.drop_columns(["_v"]).append_column("cluster", pa.array(number, pa.int32())).append_column("distance", pa.array(distance, pa.int64()))
            yield out.append_column("centroid", pa.array([own[k] for k in number.tolist()], pa.list_(pa.int64())))

    if not len(entries):
        return rows.drop("_v").withColumns({n: F.lit(None).cast(t) for n, t in (("cluster", "int"), ("distance", "bigint"), ("centroid", "array<bigint>"))})
    return rows.mapInArrow(assigned, schema)


def op11_annulus_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clustered(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    mark = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    rows = stored(found.select("vec_id", "cluster", "distance", mark.alias("centroid_sha256")))
    # One row a cluster: at most CENTROIDS of them.
    each = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    inertia = F.lit(rows.agg(F.sum("distance")).first()[0]).cast("long")
    return rows.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", inertia.alias("inertia"), "centroid_sha256")


def _sql() -> str:
    """Unrolled rounds; a vector is rows of (position, component)."""
    parts = [
        f"""e as (select row_number() over () as rid, vec_id, embedding from embeddings
  where len(embedding) = {DIMENSIONS} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {DIMENSIONS}),
v as materialized (select rid, vec_id, list_transform(embedding, lambda x: greatest(least(floor({SCALE} * x::double), {LIMIT}), -{LIMIT})) as v from e),
x as materialized (select rid, unnest(range(1, {DIMENSIONS + 1})) as k, unnest(v)::bigint as x from v),
c0 as materialized (select row_number() over (order by h) - 1 as c, v as m from (select sha256('3:' || vec_id::varchar) as h, v from v order by h limit {CENTROIDS}))"""
    ]
    near = "select rid, arg_min(c, list_distance(v, m) ** 2 * 0 + d * 16 + c) as c, min(d) as d from (select rid, c, v, m, list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from v cross join c{i}) group by rid"
    near = near.replace("list_distance(v, m) ** 2 * 0 + ", "")
    for i in range(ROUNDS):
        parts.append(f"a{i} as materialized ({near.format(i=i)})")
        parts.append(f"s{i} as (select c, k, sum(x) as s, count(*) as n from a{i} join x using (rid) group by c, k)")
        parts.append(f"n{i} as (select c, list(floor_div order by k) as m from (select c, k, (s - ((s % n) + n) % n) // n as floor_div from s{i}) group by c)")
        parts.append(f"c{i + 1} as materialized (select c{i}.c, coalesce(n{i}.m::double[], c{i}.m) as m from c{i} left join n{i} using (c))")
    parts.append(f"f as materialized ({near.format(i=ROUNDS)})")
    return (
        "with "
        + ",\n".join(parts)
        + f"""
select vec_id, c::int as cluster, d as distance, (sum(d) over (partition by c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia,
  sha256(array_to_string(list_transform(m, lambda z: z::bigint::varchar), ',')) as centroid_sha256
from f join v using (rid) join c{ROUNDS} using (c)"""
    )


OP11_SQL = _sql()


def plain_clusters(vectors: list[tuple[int, list[int]]], count: int = CENTROIDS, rounds: int = ROUNDS) -> tuple[list[tuple[int, int, int]], list[list[int]]]:
    """The same by comparing all pairs with Python integers: ((id, cluster, distance), centroids). For tests."""
    entries = [v for _, v in sorted(vectors, key=lambda x: (hashlib.sha256(f"3:{x[0]}".encode()).hexdigest(), x[1]))[:count]]
    for step in range(rounds + 1):
        found = []
        for i, v in vectors:
            d, c = min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), c) for c, m in enumerate(entries))
            found.append((i, c, d))
        if step < rounds:
            for c in range(len(entries)):
                own = [v for (_, v), (_, k, _) in zip(vectors, found, strict=True) if k == c]
                if own:
                    entries[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return found, entries
