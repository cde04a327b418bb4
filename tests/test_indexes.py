"""Stored indexes against reading everything: vectors in lists, BM25 postings, and sync runs over several syncs."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skeinworks.operators import postings, search, vectors
from skeinworks.plans import search as plans
from skeinworks.plans import sync

R = np.random.default_rng(4)
CENTRES = R.normal(size=(12, 16))


def clustered(n, seed):
    r = np.random.default_rng(seed)
    return [(i, (CENTRES[i % 12] + 0.1 * r.normal(size=16)).tolist(), i % 3) for i in range(n)]


HARD = [(9001, None, 0), (9002, [], 0), (9003, [0.0] * 16, 0), (9004, [1.0] * 3, 0), (9005, [float("nan")] + [1.0] * 15, 0), (9006, [None] + [1.0] * 15, 0)]
KINDS = "entity_id long, v array<double>, part int"


def plain(rows, query, k, keep=lambda r: True):
    q = np.array(query) / np.linalg.norm(query)
    found = [(1 / (1 + math.acos(max(-1.0, min(1.0, float(q @ (np.array(v) / np.linalg.norm(v))))))), i) for i, v, p in rows if keep((i, v, p))]
    return [i for _, i in sorted(found, key=lambda x: (-round(x[0], 12), x[1]))[:k]]


@pytest.fixture(scope="module")
def lists(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lists")) + "/index"
    rows = clustered(1500, 1)
    vectors.build(spark.createDataFrame(rows + HARD, KINDS).repartition(6), "entity_id", "v", path, lists=12)
    return path, rows


def test_exact_search_reads_few_lists_of_clustered_vectors(spark, lists):
    path, rows = lists
    asked = [v for _, v, _ in clustered(7, 9)]
    told = []
    got = vectors.nearest(spark, path, "entity_id", "v", asked, 10, probes=1, exact=True, told=told).collect()
    for q, v in enumerate(asked):
        assert [r.entity_id for r in sorted(got, key=lambda r: r.rank) if r.query == q] == plain(rows, v, 10)
    assert told[0]["rows"] == 1500 and told[0]["rows_read"] < 750
    files = [r[0] for r in vectors.stored_rows(spark, path, [3]).select(F.input_file_name()).distinct().collect()]
    assert files and all("/list=3/" in f for f in files)


def test_filters_widen_the_search_and_blocks_of_queries_add_up(spark, lists, monkeypatch):
    path, rows = lists
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 2)
    asked = [v for _, v, _ in clustered(5, 11)]
    got = vectors.nearest(spark, path, "entity_id", "v", asked, 40, probes=1, exact=True, where=F.col("part") == 1).collect()
    for q, v in enumerate(asked):
        assert [r.entity_id for r in sorted(got, key=lambda r: r.rank) if r.query == q] == plain(rows, v, 40, lambda r: r[2] == 1)
    every = vectors.nearest(spark, path, "entity_id", "v", asked[:1], 5000).collect()
    assert len(every) == 1500
    assert vectors.nearest(spark, path, "entity_id", "v", [], 5).count() == 0
    assert vectors.calibrated(spark, path, "entity_id", "v") <= 3


def test_vectors_come_and_go(spark, tmp_path):
    rows, path = clustered(200, 2), f"{tmp_path}/index"
    df = spark.createDataFrame(rows, KINDS)
    vectors.build(df.where("entity_id < 120"), "entity_id", "v", path)
    vectors.add(df.where("entity_id >= 120"), "v", path)
    vectors.remove(df.where("entity_id % 5 = 0").select("entity_id"), path)
    vectors.add(df.where("entity_id % 10 = 0"), "v", path)
    live = [r for r in rows if r[0] % 5 or r[0] % 10 == 0]
    got = vectors.nearest(spark, path, "entity_id", "v", [rows[3][1]], 30, probes=2, exact=True).orderBy("rank").collect()
    assert [r.entity_id for r in got] == plain(live, rows[3][1], 30)


def test_no_vectors(spark, tmp_path):
    path = f"{tmp_path}/index"
    vectors.build(spark.createDataFrame(HARD, KINDS).where("v is null or size(v) = 0"), "entity_id", "v", path)
    assert vectors.nearest(spark, path, "entity_id", "v", [[1.0, 2.0]], 5).count() == 0
    assert vectors.calibrated(spark, path, "entity_id", "v") == vectors.PROBES


def texts(n):
    r = random.Random(6)
    common, rare = ["the", "and", "of"], [f"word{k}" for k in range(60)]
    out = []
    for i in range(n):
        words = [r.choice(common) for _ in range(r.randint(0, 30))] + [r.choice(rare) for _ in range(r.choice([0, 1, 2, 40]))]
        out.append((i, None if i == 7 else "" if i == 8 else " ".join(words) + (" reerhan" * (i % 3) if i % 50 == 0 else "")))
    return out


def bm25(rows, query):
    found = {i: Counter(re.findall(r"[^\W_]+", (t or "").lower())) for i, t in rows}
    mean = sum(sum(c.values()) for c in found.values()) / len(found)
    score = Counter()
    for w in set(re.findall(r"[^\W_]+", query.lower())):
        df = sum(w in c for c in found.values())
        for i, c in found.items():
            if c[w]:
                score[i] += math.log(1 + (len(found) - df + 0.5) / (df + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))
    return {i: round(s, 6) for i, s in score.items()}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("postings")) + "/index"
    postings.build(spark.createDataFrame(texts(2000), "entity_id long, text string").repartition(5), "entity_id", F.col("text"), path, size=16)
    return path


@pytest.mark.parametrize("query", ["the reerhan", "word5 Word6 the", "reerhan", "nowhere", " . ?!", "nowhere and"])
def test_pruned_pages_equal_full_sums(spark, index, query):
    want = bm25(texts(2000), query)
    got = {r.entity_id: round(r.keyword, 6) for r in postings.scores(spark, index, "entity_id", query).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 2e-6 for i in got)
    for k in (1, 10, 3000):
        full = postings.scores(spark, index, "entity_id", query).orderBy(F.desc("keyword"), "entity_id").limit(k).collect()
        assert [tuple(r) for r in postings.top(spark, index, "entity_id", query, k).collect()] == [tuple(r) for r in full]


def test_blocks_are_left_out(spark, index):
    told = {}
    postings.top(spark, index, "entity_id", "the reerhan", 5, told=told).collect()
    assert told["read"] < told["blocks"] / 2
    few = spark.range(3).withColumnRenamed("id", "entity_id")
    assert {r.entity_id for r in postings.top(spark, index, "entity_id", "the", 5, few).collect()} <= {0, 1, 2}


def test_whole_json_finds_names_and_writes_nulls(spark):
    rows = spark.createDataFrame([("e1", "Test Entity", None, "s1")], "entity_id string, name string, textual_representation string, sync_id string")
    assert rows.select(postings.whole_json(rows)).first()[0] == '{"entity_id":"e1","name":"Test Entity","textual_representation":null}'


def test_postings_come_and_go(spark, tmp_path):
    rows, path = texts(300), f"{tmp_path}/index"
    df = spark.createDataFrame(rows, "entity_id long, text string")
    postings.build(df, "entity_id", F.col("text"), path, size=8)
    postings.remove(df.where("entity_id % 4 = 0"), "entity_id", path)
    postings.build(df.where("entity_id % 8 = 0"), "entity_id", F.concat("text", F.lit(" reerhan reerhan")), path, size=8)
    live = [(i, t + " reerhan reerhan" if i % 8 == 0 and t is not None else t) for i, t in rows if i % 4 or i % 8 == 0]
    # A text that is null stays null when words are added to it.
    assert {r.entity_id for r in postings.scores(spark, path, "entity_id", "reerhan").collect()} == bm25(live, "reerhan").keys()
    postings.compacted(spark, path, "entity_id", f"{tmp_path}/new")
    got = {r.entity_id: r.keyword for r in postings.scores(spark, f"{tmp_path}/new", "entity_id", "reerhan the").collect()}
    indexed = [(i, t) for i, t in live if re.findall(r"[^\W_]+", t or "")]
    want = bm25(indexed, "reerhan the")
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 2e-6 for i in got)


def test_plan_needs_no_text_with_stored_indexes(spark, index):
    rows = spark.range(2000).selectExpr("id as entity_id", "cast(null as boolean) as access_is_public", "cast(null as array<string>) as access_viewers", "id % 2 = 0 as even")
    plan = plans.SearchPlan("word5 the", strategy="keyword", limit=7, offset=2)
    got = [r.entity_id for r in plans.run(plan, rows.where("even"), stores=plans.Stores(postings=index)).collect()]
    want = sorted(((-s, i) for i, s in bm25(texts(2000), "word5 the").items() if i % 2 == 0))
    assert got == [i for _, i in want[2:9]]


def test_syncs_stay_apart(spark):
    state = spark.createDataFrame([("a", "1", "T", "old"), ("a", "2", "T", "old"), ("b", "1", "T", "old"), ("b", "2", "T", "old"), ("c", "1", "T", "old")], "sync_id string, entity_id string, entity_type string, hash string")
    kinds = "sync_id string, entity_id string, original_entity_id string, entity_type string, name string, chunk_index int, textual_representation string"
    chunks = [(s, f"{e}__chunk_0", e, "T", "n", 0, "old") for s, e in (("a", "1"), ("a", "2"), ("b", "1"), ("b", "2"), ("c", "1"))]
    new = spark.createDataFrame([("a", "1", "T", "n", "words.", 1), ("b", "1", "T", "n", "other.", 2)], "sync_id string, entity_id string, entity_type string, name string, text string, seq long")
    found = sync.run(new.where("sync_id = 'a'"), state, spark.createDataFrame(chunks, kinds))
    assert {(r.sync_id, r.entity_id) for r in found.orphans.collect()} == {("a", "2")}
    assert {(r.sync_id, r.entity_id) for r in found.state.collect()} == {("a", "1"), ("b", "1"), ("b", "2"), ("c", "1")}
    assert {(r.sync_id, r.original_entity_id, r.textual_representation) for r in found.index.collect()} == {("a", "1", "words."), ("b", "1", "old"), ("b", "2", "old"), ("c", "1", "old")}
    # Both keep their entity of one id, and a sync that found nothing loses all it had.
    both = sync.run(new, state, spark.createDataFrame(chunks, kinds), syncs=spark.createDataFrame([("a",), ("b",), ("c",)], "sync_id string"))
    assert {(r.sync_id, r.entity_id) for r in both.state.collect()} == {("a", "1"), ("b", "1")}
    assert {(r.sync_id, r.entity_id) for r in both.orphans.collect()} == {("a", "2"), ("b", "2"), ("c", "1")}


def test_texts_are_moved_instead_of_their_terms(spark):
    """Below the rows of terms there is the only exchange, and equal ids and colliding terms still have one row."""
    rows = spark.createDataFrame([("a", "x y x"), ("b", None), ("c", "..."), ("a", "y z")], "entity_id string, text string")
    for found in (search.term_table(rows, "entity_id", "text"), postings.counted(rows, "entity_id", F.col("text"))):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.index("Generate") < plan.index("Exchange") and plan.count("Exchange") == 1
    assert {tuple(r) for r in search.term_table(rows, "entity_id", "text").collect()} == {("a", "x", 2), ("a", "y", 2), ("a", "z", 1)}
    assert sorted(r.tf for r in postings.counted(rows, "entity_id", F.col("text")).where("length = 5").collect()) == [1, 2, 2]
    pairs = spark.createDataFrame([([(7, 1), (5, 2), (7, 3)],), ([(9, 4)],), (None,)], "c array<struct<token: bigint, tf: int>>")
    assert [r[0] for r in pairs.select(postings._merged(F.col("c"))).collect()] == [[(5, 2), (7, 4)], [(9, 4)], None]


def test_compaction_moves_no_entries_by_themselves(spark, tmp_path):
    rows = spark.range(300).selectExpr("cast(id as string) as entity_id", "concat('common word', id % 7) as text")
    path, target = f"{tmp_path}/old", f"{tmp_path}/new"
    postings.build(rows, "entity_id", F.col("text"), path)
    postings.remove(rows.where("entity_id % 3 = 0"), "entity_id", path)
    postings.build(rows.where("entity_id % 6 = 0"), "entity_id", F.col("text"), path)
    postings.compacted(spark, path, "entity_id", target)
    assert spark.read.parquet(f"{target}/chunks").count() == 250
    assert spark.read.parquet(f"{target}/totals").first()[:2] == (250, 500)
    assert {r.entity_id for r in postings.scores(spark, target, "entity_id", "common").collect()} == {str(i) for i in range(300) if i % 3 or i % 6 == 0}


def moved(spark):
    """Bytes shuffled and spilled to disk by all stages so far."""
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, None)
    return sum(stages.apply(i).shuffleWriteBytes() + stages.apply(i).diskBytesSpilled() for i in range(stages.size()))


def test_a_build_moves_little_more_than_its_texts(spark, tmp_path):
    """Neither ids nor rows of single terms and blocks move, and no posting has an id."""
    r = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    rows = [(f"a-long-id-of-an-entity-{i}", " ".join(r.choice(words) for _ in range(r.randint(1, 120)))) for i in range(4000)]
    df = spark.createDataFrame(rows, "entity_id string, text string").repartition(3).persist()
    chars = df.agg(F.sum(F.length("text"))).first()[0]
    before = moved(spark)
    postings.build(df, "entity_id", F.col("text"), f"{tmp_path}/index", size=8)
    assert moved(spark) - before < 2 * chars
    assert set(spark.read.parquet(f"{tmp_path}/index/postings").columns) == {"token", "block", "pos", "tf", "most", "n", "written_at", "bucket"}
    got = {r.entity_id: round(r.keyword, 6) for r in postings.scores(spark, f"{tmp_path}/index", "entity_id", "w1 w7").collect()}
    want = bm25(rows, "w1 w7")
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 2e-6 for i in got)
    df.unpersist()


@pytest.mark.parametrize("size, most", [(8, 1 << 20), (10, 50), (128, 7), (5000, 1 << 20)])
def test_places_of_terms_are_those_of_the_chunks(monkeypatch, size, most):
    """By terms and spans and back to blocks, in pieces or not, over the ends of spans and batches."""
    monkeypatch.setattr(postings, "PART_ENTRIES", most)
    r = random.Random(9)
    chunks = [(at, sorted(r.sample(range(-(2**31), 2**31, 2**28), r.randint(1, 9)))) for at in [*range(4090, 4130), *range((3 << 33) - 5, (3 << 33) + 5)]]
    kinds = pa.schema([("at", pa.int64()), ("tokens", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])
    whole = pa.RecordBatch.from_pydict({"at": [c[0] for c in chunks], "tokens": [c[1] for c in chunks], "tfs": [[at % 7 + 1] * len(t) for at, t in chunks]}, kinds)
    by_terms = list(postings._by_terms(iter([whole.slice(0, 20), whole.slice(20, 0), whole.slice(20)])))
    found = [row for b in postings._by_blocks(size)(iter(by_terms)) for row in b.to_pylist()]
    got = sorted((x["block"] * size + p, x["token"] - 2**31, tf) for x in found for p, tf in zip(x["pos"], x["tf"], strict=True))
    assert got == sorted((at, t, at % 7 + 1) for at, ts in chunks for t in ts)
    assert all(0 <= p < size for x in found for p in x["pos"]) and all((x["most"], x["n"]) == (max(x["tf"]), len(x["tf"])) for x in found)


@pytest.mark.parametrize("most", [100_000, 0])
def test_a_compaction_leaves_postings_where_they_are(spark, tmp_path, monkeypatch, most):
    """What moves of it is keys of chunks; with more blocks to join than may go out, the result is the same."""
    monkeypatch.setattr(postings, "BROADCAST_BLOCKS", most)
    r = random.Random(10)
    rows = [(i, " ".join(f"w{r.randrange(300)}" for _ in range(120))) for i in range(3000)]
    df = spark.createDataFrame(rows, "entity_id long, text string")
    postings.build(df, "entity_id", F.col("text"), f"{tmp_path}/old")
    postings.remove(df.where("entity_id % 3 = 0"), "entity_id", f"{tmp_path}/old")
    entries = spark.read.parquet(f"{tmp_path}/old/postings").agg(F.sum("n")).first()[0]
    before = moved(spark)
    postings.compacted(spark, f"{tmp_path}/old", "entity_id", f"{tmp_path}/new")
    if most:
        assert entries > 200_000 and moved(spark) - before < entries
    got = {r.entity_id: round(r.keyword, 6) for r in postings.scores(spark, f"{tmp_path}/new", "entity_id", "w1 w7").collect()}
    want = bm25([(i, t) for i, t in rows if i % 3], "w1 w7")
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 2e-6 for i in got)


def test_a_page_over_small_blocks_moves_its_texts_once(spark, tmp_path):
    from skeinworks.queries import QUERIES

    (tmp_path / "tables").symlink_to("/root/testdata/sf0.001")
    chars = spark.read.parquet(f"{tmp_path}/tables/documents.parquet").agg(F.sum(F.length("text"))).first()[0]
    before = moved(spark)
    assert QUERIES["r10_blocks_left_out"](spark, f"{tmp_path}/tables").first()[0]
    assert moved(spark) - before < 2 * chars
