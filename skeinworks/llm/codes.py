"""Vector code compression with annular norm pruning (operator 12).

Product quantisation: a vector is cut into equal parts, and each part is replaced by the number of the nearest entry in the
codebook of its position. Entries are sorted by norm; the best distance found so far bounds, by the triangle inequality, how far the norm of
a nearer entry can be from the part's, two binary searches give that interval, and only the entries in it, both ends included, are
compared exactly (`centroids.Annulus`).

Vectors stay in Spark as written rows of integers. A round is one job: tasks encode their batches and send one row a used entry
and batch of sums and counts, which Spark adds up; only codebooks (parts x entries) pass through the driver.

Defined cases: a null vector or one with a null or non-finite component is dropped, and so is one that has not the first vector's
number of components (by id, then components), or whose number `parts` does not divide; a component becomes floor(1024 * x), held
within +-2**27 so that every distance fits a long; fewer vectors than entries give smaller codebooks; an empty table gives an
empty result; rows that share an id are encoded each; null labels are one label; all other columns are kept, and `code`, `error` and
`reconstructed` are replaced if present.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .centroids import LIMIT, SCALE, Annulus, matrix, quantized, sums
from .common import read, stored

PARTS, ENTRIES, ROUNDS = 4, 256, 4


def _partial(books: list[np.ndarray]):
    """Each Arrow batch as one row a part and entry that it uses: count and sums."""
    kinds = pa.schema([("p", pa.int32()), ("c", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.int64()))])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [Annulus(b) for b in books]
        for batch in rows:
            x = matrix(batch.column(0))
            if not len(x):
                continue
            for p, part in enumerate(np.split(x, len(books), axis=1)):
                n, s = sums(search[p].nearest(part)[0], part, len(books[p]))
                have = np.flatnonzero(n)
                yield pa.record_batch([pa.array(np.full(len(have), p), pa.int32()), pa.array(have, pa.int32()), pa.array(n[have], pa.int64()), pa.array(list(s[have]), pa.list_(pa.int64()))], schema=kinds)

    return run


def improved(vectors: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Each entry's parts' floor(sum / count); unused entries stay. `vectors` has the column `_v` only."""
    rows = vectors.mapInArrow(_partial(books), "p int, c int, n long, s array<long>")
    rows = rows.select("p", "c", "n", F.posexplode("s").alias("k", "x")).groupBy("p", "c", "k").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    out = [b.copy() for b in books]
    for p, c, k, n, x in rows.collect():  # as many as the codebooks have numbers
        out[p][c, k] = x // n
    return out


def whole_vectors(df: DataFrame, column: str, id_column: str, parts: int) -> DataFrame:
    """df's usable vectors, as `_v`, written; all have the length of the first one by id."""
    rows = quantized(df, column)
    first = rows.where(F.size("_v") > 0).orderBy(id_column, "_v").select(F.size("_v")).limit(1).collect()
    size = first[0][0] if first else 0
    return stored(rows.where((F.size("_v") == size) & (F.size("_v") % parts == 0) & (F.size("_v") > 0)))


def codebooks(rows: DataFrame, id_column: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Learnt codebooks, one a part; they begin as the parts of the vectors with the smallest ids. Empty without vectors."""
    first = rows.orderBy(F.col(id_column).asc_nulls_last(), "_v").select("_v").limit(entries).collect()
    books = np.split(np.array([r._v for r in first], np.int64), parts, axis=1) if first else []
    plain = rows.select("_v")
    for _ in range(rounds if books else 0):
        books = improved(plain, books)
    return books


def encoded(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """rows with `code` (two hex digits a part), `error` (squared) and `reconstructed` (array<double>), instead of `_v`."""
    kinds = "code string, error long, reconstructed array<double>"
    names = [f for f in rows.schema.fields if f.name not in ("_v", "code", "error", "reconstructed")]
    schema = T.StructType(names + T._parse_datatype_string(kinds).fields)
    rows = rows.select(*[F.col(f"`{f.name}`") for f in names], "_v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [Annulus(b) for b in books]
        for batch in batches:
            x = matrix(batch.column(batch.schema.get_field_index("_v")))
            codes, error, again = [], np.zeros(len(x), np.int64), []
            for p, part in enumerate(np.split(x, len(books), axis=1) if len(x) else []):
                number, distance = search[p].nearest(part)
                codes.append(number.astype(np.uint8))
                error += distance
                again.append(books[p][number] / SCALE)
            text = [c.tobytes().hex() for c in np.stack(codes, axis=1)] if codes else []
            out = batch.drop_columns(["_v"]).append_column("code", pa.array(text, pa.string())).append_column("error", pa.array(error, pa.int64()))
            yield out.append_column("reconstructed", pa.array(list(np.concatenate(again, axis=1)) if again else [], pa.list_(pa.float64())))

    if not books:
        return rows.drop("_v").withColumns({"code": F.lit(None).cast("string"), "error": F.lit(None).cast("long"), "reconstructed": F.lit(None).cast("array<double>")})
    return rows.mapInArrow(run, schema)


def digest(books: list[np.ndarray]) -> str:
    """sha256 of all numbers of the codebooks, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whole_vectors(read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), "embedding", "vec_id", PARTS)
    books = codebooks(rows.select("vec_id", "_v"), "vec_id")
    found = stored(encoded(rows.select("vec_id", "label", "_v"), books).select("vec_id", "label", "code", "error"))
    # Stored, so that the join has plain exchanges on both sides and a label with most rows can be split.
    each = stored(found.groupBy("label").agg(F.sum("error").alias("label_error"))).withColumnRenamed("label", "_label")
    joined = found.join(each, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    size = 64 // PARTS
    near = """select rid, p, d // 65536 as d, (d % 65536)::int as c from (
  select rid, p, min(list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint * 65536 + c) as d from x join b{i} using (p) group by rid, p)"""
    parts = [
        f"""e as (select row_number() over () as rid, vec_id, label, embedding from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
x as materialized (select rid, p, list_transform(embedding[p * {size} + 1 : p * {size} + {size}], lambda x: greatest(least(floor({SCALE} * x::double), {LIMIT}), -{LIMIT})) as v
  from e, unnest(range({PARTS})) as t(p)),
o as (select rid, row_number() over (order by vec_id) - 1 as c from e qualify c < {ENTRIES}),
b0 as materialized (select p, c, v as m from x join o using (rid))"""
    ]
    for i in range(ROUNDS):
        parts.append(f"a{i} as materialized ({near.format(i=i)})")
        parts.append(f"u{i} as (select p, c, k, v[k]::bigint as y from a{i} join x using (rid, p), unnest(range(1, {size + 1})) as t(k))")
        parts.append(f"n{i} as (select p, c, list(y order by k) as m from (select p, c, k, floor(sum(y)::double / count(*)) as y from u{i} group by p, c, k) group by p, c)")
        parts.append(f"b{i + 1} as materialized (select b{i}.p, b{i}.c, coalesce(n{i}.m, b{i}.m) as m from b{i} left join n{i} using (p, c))")
    parts.append(f"f as materialized ({near.format(i=ROUNDS)})")
    parts.append("g as (select rid, string_agg(format('{:02x}', c), '' order by p) as code, sum(d)::bigint as error from f group by rid)")
    parts.append(f"h as (select sha256(string_agg(array_to_string(list_transform(m, lambda z: z::bigint::varchar), ','), ',' order by p, c)) as codebooks_sha256 from b{ROUNDS})")
    return "with " + ",\n".join(parts) + "\nselect vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from g join e using (rid), h"


OP12_SQL = _sql()


def plain_codes(vectors: list[tuple[int, list[int]]], parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[list[tuple[int, str, int]], list[list[list[int]]]]:
    """The same by comparing all pairs with Python integers: ((id, code, error), codebooks). For tests."""
    size = len(vectors[0][1]) // parts
    cut = [[v[p * size : (p + 1) * size] for _, v in vectors] for p in range(parts)]
    order = sorted(range(len(vectors)), key=lambda k: vectors[k])[:entries]
    books = [[cut[p][k] for k in order] for p in range(parts)]
    found: list[list[tuple[int, int]]] = []
    for step in range(rounds + 1):
        found = [[min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), c) for c, m in enumerate(books[p])) for v in cut[p]] for p in range(parts)]
        for p in range(parts if step < rounds else 0):
            for c in range(len(books[p])):
                own = [v for v, (_, k) in zip(cut[p], found[p], strict=True) if k == c]
                if own:
                    books[p][c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return [(i, "".join(f"{found[p][k][1]:02x}" for p in range(parts)), sum(found[p][k][0] for p in range(parts))) for k, (i, _) in enumerate(vectors)], books
