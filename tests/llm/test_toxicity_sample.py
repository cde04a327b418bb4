"""The sample that toxicity learns from is bounded in rows and in bytes."""

from pyspark.sql import functions as F

from skeinworks.llm import toxicity


def sample(spark, most_bytes, rows=200):
    docs = spark.range(rows).select(F.col("id").alias("doc_id"), F.concat(F.lit("plain words "), F.when(F.col("id") == 7, F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(3000)), lambda i: F.concat(F.lit("long"), F.conv(i.cast("string"), 10, 36))))).otherwise(F.col("id").cast("string"))).alias("text"))
    labels = spark.range(rows).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    return toxicity.labelled_sample(docs, labels, ["toxic"], 80, most_bytes)


def test_all_fit(spark):
    got = sample(spark, 1 << 30)
    assert got["toxic"].value_counts().to_dict() == {0.0: 80, 1.0: 80}


def test_bytes_are_bounded_and_long_texts_passed_over(spark):
    whole = sample(spark, 1 << 30).set_index("doc_id")
    least = whole["features"].map(len).median() * 64
    got = sample(spark, int(least * 1.05))
    for _, part in got.groupby("toxic"):
        assert 0 < part["features"].map(len).sum() <= least * 1.05 and len(part) >= 32
    assert 7 not in set(got["doc_id"]) and set(got["doc_id"]) <= set(whole.index)


def test_the_sample_is_the_same_each_time(spark):
    first, again = (set(sample(spark, 40_000)["doc_id"]) for _ in range(2))
    assert first == again and first
