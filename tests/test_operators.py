"""Truth tables and properties of single operators."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skeinworks import model
from skeinworks.functions import scoring, text
from skeinworks.operators import access, cdc, filters, hierarchy, legacy_filters, metadata
from skeinworks.operators.filters import Condition as C
from skeinworks.plans import search as plans
from skeinworks.sources import stores


def test_filter_validation():
    for bad in (C("nope", "equals", 1), C("name", "greater_than", "x"), C("chunk_index", "contains", "1"), C("name", "in", "[1"), C("created_at", "equals", "not a date"), C("name", "equals", ["a"]), C("name", "near", "a")):
        with pytest.raises(ValueError):
            filters.condition(bad)
    with pytest.raises(ValueError):
        legacy_filters.translate({"key": "a"})
    with pytest.raises(ValueError):
        legacy_filters.translate({"must": [{"strange": 1}]})


def test_epoch_seconds():
    assert filters.epoch_seconds("'2024-01-15T12:00:00Z'") == filters.epoch_seconds("2024-01-15T12:00:00") == 1705320000
    assert filters.epoch_seconds("2024-01-15") == 1705276800


def test_null_fields(spark):
    rows = spark.createDataFrame([(None,), ("a",), ("b",)], "name string")
    n = lambda c: rows.where(filters.condition(c)).count()
    assert n(C("name", "equals", "a")) == 1
    assert n(C("name", "not_equals", "a")) == 2
    assert n(C("name", "in", ["a"])) == 1
    assert n(C("name", "not_in", ["a"])) == 2
    assert n(C("name", "not_in", [])) == 3
    assert n(C("name", "in", [])) == 0
    assert n(C("name", "contains", "A")) == 1


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["x", "y", "z"]), min_size=1, max_size=2), min_size=1, max_size=3), st.lists(st.lists(st.sampled_from(["x", "w"]), min_size=1, max_size=2), min_size=1, max_size=2))
def test_dnf_merge_keeps_meaning(user, plan):
    as_groups = lambda gs: [[C("name", "contains", v) for v in g] for g in gs]
    holds = lambda gs, s: any(all(c.value in s for c in g) for g in gs)
    both = filters.merged(as_groups(user), as_groups(plan), "dnf")
    for s in ("", "x", "xy", "wz", "wxyz", "yz"):
        assert holds(both, s) == (holds(as_groups(user), s) and holds(as_groups(plan), s))


def test_visibility(spark):
    rows = spark.createDataFrame([(1, None, None), (2, True, None), (3, False, ["user:a"]), (4, False, []), (5, False, ["group:g"])], "i int, access_is_public boolean, access_viewers array<string>")
    ids = lambda c: sorted(r.i for r in rows.where(c).collect())
    assert ids(access.visible(None)) == [1, 2, 3, 4, 5]
    assert ids(access.visible([])) == [2]
    assert ids(access.visible(["user:a"])) == [2, 3]
    assert ids(access.visible_in_memory(["group:g"])) == [1, 2, 5]
    assert ids(access.may_open(["user:b"])) == [1, 2, 4]


def test_groups_with_cycles_and_depth(spark):
    edges = [("u", "user", "a"), ("a", "group", "b"), ("b", "group", "a"), ("b", "group", "c"), (None, "user", "z")]
    df = spark.createDataFrame(edges, "member_id string, member_type string, group_id string")
    assert sorted((r.group_id, r.depth) for r in access.expanded(df).collect()) == [("a", 1), ("b", 2), ("c", 3)]
    assert sorted(r.group_id for r in access.expanded(df, 2).collect()) == ["a", "b"]


def test_second_run_keeps_all(spark):
    rows = spark.createDataFrame([("s", str(i), "T", f"n{i}", f"text {i}", i) for i in range(20)], "sync_id string, entity_id string, entity_type string, name string, text string, seq long")
    one = cdc.hashed(rows)
    state = one.select("sync_id", "entity_id", "entity_type", "hash")
    assert cdc.classified(one, state.limit(0)).where("action <> 'INSERT'").count() == 0
    assert cdc.classified(one, state).where("action <> 'KEEP'").count() == 0
    assert cdc.orphans(state, one).count() == 0


def test_hash_tells_fields_apart(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), ("ab", None), (None, "ab")], "x string, y string")
    assert df.select(cdc.content_hash(["x", "y"]).alias("h")).distinct().count() == 4


@settings(max_examples=10, deadline=None)
@given(st.permutations(list(range(6))))
def test_rank_fusion_is_symmetric(spark, order):
    a = spark.createDataFrame([(i, n + 1) for n, i in enumerate(order)], "id int, rank int")
    b = spark.createDataFrame([(i, n + 1) for n, i in enumerate(reversed(order))], "id int, rank int")
    x = {r.id: round(r.score, 12) for r in scoring.reciprocal_rank_fusion([a, b], "id").collect()}
    y = {r.id: round(r.score, 12) for r in scoring.reciprocal_rank_fusion([b, a], "id").collect()}
    assert x == y


def test_min_max_of_equal_scores(spark):
    rows = spark.createDataFrame([(1, 2.0, 0.5), (2, 2.0, 0.5)], "id int, k double, s double")
    assert [r.score for r in scoring.hybrid(rows, "k", "s", "id").collect()] == [0.0, 0.0]


def test_closeness_of_zero_vectors(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, None)], "id int, v array<double>")
    assert [r.id for r in scoring.nearest(rows, "v", [[1.0, 0.0]], 5, "id").collect()] == [2]


def test_sentence_chunks(spark):
    df = spark.createDataFrame([("a", "One two. Three four five! Six\nseven."), ("b", ""), ("c", None)], "entity_id string, text string")
    got = text.exploded_chunks(df, text.sentence_chunks(F.col("text"), 4)).orderBy("entity_id").collect()
    assert [(r.entity_id, r.chunk) for r in got] == [("a__chunk_0", "One two."), ("a__chunk_1", " Three four five! Six\n"), ("a__chunk_2", "seven.")]


def test_surrounding_and_siblings(spark):
    c = spark.createDataFrame([(f"p__{i}", "p", i) for i in range(10)], "entity_id string, original_entity_id string, chunk_index int")
    got = hierarchy.surrounding(c, c.where("chunk_index in (4, 5)")).collect()
    assert sorted(r.chunk_index for r in got) == list(range(2, 8))
    assert sorted(r.chunk_index for r in got if r.is_match) == [4, 5]


def test_health(spark):
    rows = [("a", 1, 5, 500), ("a", 2, 6, 500), ("a", 3, 7, 500), ("b", 4, 1, 200), ("c", 5, 2, 500), ("c", 6, 1, 200)]
    got = metadata.health(spark.createDataFrame(rows, "endpoint string, delivery_id long, at long, code int"))
    assert {r.endpoint: r.health for r in got.collect()} == {"a": "failing", "b": "healthy", "c": "degraded"}


def test_flags():
    from pyspark.sql import types as T

    good = T.StructType([T.StructField("i", T.StringType(), False, model.Flags(is_entity_id=True).metadata()), T.StructField("n", T.StringType(), False, model.Flags(is_name=True).metadata())])
    model.check_flags(good)
    with pytest.raises(ValueError):
        model.check_flags(T.StructType([good[0]]))
    assert model.family_of(["repo_name", "path_in_repo"]) == "code_file_entity"
    assert model.short_name("GitHubIssueEntity") == "git_hub_issue_entity"


def test_plan_limits():
    for bad in (dict(strategy="x"), dict(limit=0), dict(limit=5000), dict(offset=-1)):
        with pytest.raises(ValueError):
            plans.SearchPlan("q", **bad).check()


def test_query_time_sources_are_fused(spark):
    index = spark.createDataFrame([(f"e{i}", f"e{i}", "word " * i, None, None, None, 0) for i in range(1, 6)], "entity_id string, original_entity_id string, textual_representation string, access_is_public boolean, access_viewers array<string>, dense_embedding array<double>, chunk_index int")
    fetch = lambda q, n: spark.createDataFrame([("f1", 1), ("e1", 2)], "entity_id string, place int")
    got = [r.entity_id for r in plans.run(plans.SearchPlan("word", strategy="keyword", limit=5), index, [fetch]).collect()]
    assert got[0] == "e1" and len(got) == 5


def test_stub_source_is_repeatable(spark):
    stores.register(spark)
    read = lambda **o: sorted(map(tuple, spark.read.format("skein_stub").options(**o).load().collect()))
    assert read(count=30, partitions=3) == read(count=30, partitions=7)
    assert len(read(count=30, after=9)) == 20


def test_filter_reaches_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumnRenamed("source", "source_name")
    plan = df.where(filters.condition(C("source_name", "in", ["src1"]))).select("doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,source:string>" in plan


def test_texts_whose_terms_cancel_have_no_vector(spark):
    from skeinworks.operators import embed

    texts = [(None,), ("",), ("...",), *((f"a{i} b{i}",) for i in range(2000))]
    rows = embed.checked(embed.hashing(spark.createDataFrame(texts, "text string"), "text"), "dense_embedding", 64).collect()
    none = [r for r in rows if r.dense_embedding is None]
    assert len(rows) == 2003 and 3 < len(none) < 100
    with pytest.raises(Exception, match="not true"):
        embed.checked(spark.createDataFrame([([1.0],)], "dense_embedding array<double>"), "dense_embedding", 64).collect()
