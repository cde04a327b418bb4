"""Rows at both ends of a table count: queries that once saw only the first ids, on a fixture with ids beyond them."""

import pytest
from pyspark.sql import functions as F

from skeinworks.functions import scoring
from skeinworks.queries import ORACLE, QUERIES
from tests.compare import same


@pytest.fixture(scope="module")
def fixture(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    texts = [None, "", "  ", "x", "Ünï 漢字 \"quoted\" \\ back", "one\ntwo\r\nthree\t", "w " * 30000]
    docs = [(i, texts[k % len(texts)]) for k, i in enumerate(range(0, 1400, 50))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    events = [(i, None if i % 400 == 0 else f'{{"k": {i}}}') for i in range(0, 2000, 100)]
    spark.createDataFrame(events, "event_id long, props string").write.parquet(f"{at}/events.parquet")
    return at


@pytest.mark.parametrize("name", ["c07_files_decoded_all", "c08_json_fenced_all", "s06_raw_round_trip_all"])
def test_whole_table(spark, fixture, name):
    same(QUERIES[name](spark, fixture), ORACLE[name], fixture)


def test_budget_is_filled_beyond_200_rows(spark, tmp_path):
    spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("a b c d e f g h i j k l m n o p q r s t u v w x y z" + " w" * 24).alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id for r in QUERIES["w08_budget_prefix"](spark, str(tmp_path)).collect()} == set(range(400))


@pytest.mark.parametrize("ranges", [2, 7, 200])
@pytest.mark.parametrize("budget", [0, 10, 57, 10_000])
def test_budget_by_ranges_equals_one_window(spark, ranges, budget):
    rows = [((i * 37) % 101, (i * i) % 7 if i % 11 else None) for i in range(101)] + [(None, 2), (-3, None), (-2, None)]
    sums, total = {}, None
    for key, n in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0)):
        total = total if n is None else (total or 0) + n
        sums[key] = total
    df = spark.createDataFrame(rows, "k long, n long").repartition(5)
    got = {r.k for r in scoring.within_budget_by_ranges(df, "n", "k", budget, ranges).collect()}
    assert got == {k for k, t in sums.items() if t is not None and t <= budget}
    assert scoring.within_budget_by_ranges(df.limit(0), "n", "k", budget, ranges).count() == 0
