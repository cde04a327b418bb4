"""Centroid clusters and vector codes against plain integer arithmetic, and their hard cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinworks.llm import centroids, codes

KINDS = "vec_id long, embedding array<float>, label int"


def rounded(v):
    return [max(-centroids.LIMIT, min(centroids.LIMIT, math.floor(1024 * float(np.float32(x))))) for x in v]


@pytest.mark.parametrize("seed", range(4))
def test_annulus_is_exact_with_ties(seed):
    r = np.random.default_rng(seed)
    # Few values, so that many entries are equally near, have equal norms, or are the same.
    entries = r.integers(-2, 3, (40, 3)) * (1 if seed else 10**7)
    x = np.concatenate([r.integers(-3, 4, (300, 3)) * (1 if seed else 10**7), entries])
    number, distance = centroids.Annulus(entries).nearest(x)
    every = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert np.array_equal(number, every.argmin(axis=1)) and np.array_equal(distance, every.min(axis=1))


@pytest.mark.parametrize("dimensions, count, rounds", [(3, 4, 5), (64, 8, 10), (2, 30, 3)])
def test_clusters_equal_plain_ones(spark, dimensions, count, rounds):
    r = random.Random(dimensions)
    rows = [(i, [r.choice([-1.0, 0.25, 0.5, r.gauss(0, 1)]) for _ in range(dimensions)], 0) for i in range(150)]
    rows += [(1000 + i, rows[0][1], 0) for i in range(40)]  # one vector with many rows
    found, entries = centroids.plain_clusters([(i, rounded(v)) for i, v, _ in rows], count, rounds)
    got = centroids.clustered(spark.createDataFrame(rows, KINDS).repartition(5), count=count, rounds=rounds, dimensions=dimensions).collect()
    assert sorted((g.vec_id, g.cluster, g.distance) for g in got) == sorted(found)
    assert all(list(g.centroid) == entries[g.cluster] for g in got)


@pytest.mark.parametrize("parts, entries", [(4, 16), (2, 256), (1, 3)])
def test_codes_equal_plain_ones(spark, parts, entries):
    r = random.Random(parts)
    rows = [(i, [r.choice([-0.5, 0.0, r.gauss(0, 1)]) for _ in range(8)], i % 3 or None) for i in range(200)]
    rows += [(-5 - i, rows[1][1], 1) for i in range(30)]
    plain, books = codes.plain_codes([(i, rounded(v)) for i, v, _ in rows], parts, entries)
    df = codes.whole_vectors(spark.createDataFrame(rows, KINDS).repartition(5), "embedding", "vec_id", parts)
    learnt = codes.codebooks(df, "vec_id", parts, entries)
    assert [b.tolist() for b in learnt] == books
    got = codes.encoded(df, learnt).collect()
    assert sorted((g.vec_id, g.code, g.error) for g in got) == sorted(plain)
    for g in got[:20]:
        again = [x for p in range(parts) for x in books[p][int(g.code[2 * p : 2 * p + 2], 16)]]
        assert [x * 1024 for x in g.reconstructed] == again


NAN, INF = float("nan"), float("inf")
HARD = [
    (1, [0.5, -0.5, 1.0, 2.0], 1),
    (2, None, 1),
    (3, [0.5, None, 1.0, 2.0], 1),
    (4, [NAN, 0.0, 0.0, 0.0], 1),
    (5, [INF, 0.0, 0.0, 0.0], 2),
    (6, [1.0, 2.0], 2),
    (7, [], 2),
    (8, [1e30, -1e30, 0.0, 1.0], None),
    (None, [0.25, 0.0, 0.0, 1.0], None),
    (1, [0.5, -0.5, 1.0, 2.0], 1),
    (1, [-0.0001, 0.0, 0.0, 0.0], None),
]
KEPT = [(1, 1), (1, 1), (1, None), (8, None), (None, None)]


def test_hard_rows(spark, tmp_path):
    order = lambda x: (x[0] is None, x[0] or 0, x[1] is None)
    df = spark.createDataFrame(HARD, KINDS).withColumns({n: F.lit("clash") for n in ("cluster", "distance", "centroid", "code", "error", "reconstructed")})
    got = centroids.clustered(df, dimensions=4, count=3, rounds=2).collect()
    assert sorted(((g.vec_id, g.label) for g in got), key=order) == KEPT
    assert {g.code for g in got} == {"clash"} and all(0 <= g.distance < 2**63 and 0 <= g.cluster < 3 for g in got)
    rows = codes.whole_vectors(df, "embedding", "vec_id", 2)
    got = codes.encoded(rows, codes.codebooks(rows, "vec_id", 2, 2, 2)).collect()
    assert sorted(((g.vec_id, g.label) for g in got), key=order) == KEPT
    assert {g.cluster for g in got} == {"clash"} and {g.error for g in got if g.vec_id == 8} != {0}
    # All copies of a row have one answer, whatever its key.
    assert len({(g.code, g.error) for g in got if g.vec_id == 1 and g.label == 1}) == 1


def test_nothing_to_learn_from(spark, tmp_path):
    none = spark.createDataFrame(HARD, KINDS).where("vec_id = 2")
    assert centroids.clustered(none).columns == ["vec_id", "embedding", "label", "cluster", "distance", "centroid"]
    assert centroids.clustered(none).count() == 0
    for name, rows in (("none", none), ("empty", none.limit(0))):
        rows.write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        assert centroids.op11_annulus_clusters(spark, f"{tmp_path}/{name}").count() == 0
        assert codes.op12_vector_codes(spark, f"{tmp_path}/{name}").count() == 0


def test_rounds_and_floors_of_negative_sums(spark):
    rows = [(1, [-0.001, 0.0], 0), (2, [-0.002, 0.001], 0), (3, [-0.004, 0.0], 0)]
    got = centroids.clustered(spark.createDataFrame(rows, KINDS), count=1, rounds=1, dimensions=2).first()
    assert list(got.centroid) == [math.floor((-2 - 3 - 5) / 3), math.floor(1 / 3)]
