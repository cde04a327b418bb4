"""Scores and their fusion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
RERANK_WINDOW = 100
BUDGET_RANGES = 200


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null where one has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, F.greatest(F.least(dot(a, b) / norms, F.lit(1.0)), F.lit(-1.0)))


def closeness(a: Column, b: Column) -> Column:
    """1 / (1 + angle)."""
    return 1 / (1 + F.acos(cosine(a, b)))


def nearest(rows: DataFrame, vector: str, queries: Sequence[Sequence[float]], k: int, ident: str) -> DataFrame:
    """The k rows closest to any of the query vectors; each partition keeps k, nothing is shuffled but those."""
    best = [closeness(F.col(vector), F.array(*[F.lit(float(x)) for x in q])) for q in queries]
    score = F.greatest(*best) if len(best) > 1 else best[0]
    return rows.withColumn("score", score).where(F.col("score").isNotNull()).orderBy(F.desc("score"), ident).limit(k)


def min_max(column: str, window: Window) -> Column:
    """Linear position of a value between the least and largest of the window; 0 where all are equal."""
    low, high = F.min(column).over(window), F.max(column).over(window)
    return F.when(high > low, (F.col(column) - low) / (high - low)).otherwise(F.lit(0.0))


def hybrid(rows: DataFrame, keyword: str, semantic: str, ident: str, window: int = RERANK_WINDOW) -> DataFrame:
    """First phase: the `window` best by the plain sum. Second: both scores put on 0..1 inside it and added."""
    top = rows.withColumn("_first", F.col(keyword) + F.col(semantic)).orderBy(F.desc("_first"), ident).limit(window)
    everything = Window.partitionBy(F.lit(0))
    return top.withColumn("score", min_max(keyword, everything) + min_max(semantic, everything)).drop("_first")


def reciprocal_rank_fusion(lists: Sequence[DataFrame], ident: str, k: int = RRF_K) -> DataFrame:
    """(ident, score) from lists with a 1-based `rank`; lists add up where they share rows."""
    parts = [x.select(ident, (F.lit(1.0) / (k + F.col("rank"))).alias("_s")) for x in lists]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(ident).agg(F.sum("_s").alias("score"))


def ranked(rows: DataFrame, score: str, ident: str, most: int) -> DataFrame:
    """The best rows with their place; the limit comes first, so numbering sees `most` rows only."""
    top = rows.orderBy(F.desc(score), ident).limit(most)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(score), ident)))


def within_budget(rows: DataFrame, size: str, order: Sequence[str], budget: int, at_least: int = 0) -> DataFrame:
    """Rows from the top until the summed size would pass the budget; rows come ranked and few."""
    w = Window.partitionBy(F.lit(0)).orderBy(*order)
    out = rows.withColumns({"_sum": F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_n": F.row_number().over(w)})
    return out.where((F.col("_sum") <= budget) | (F.col("_n") <= at_least)).drop("_sum", "_n")


def within_budget_by_ranges(rows: DataFrame, size: str, key: str, budget: int, ranges: int = BUDGET_RANGES) -> DataFrame:
    """Rows by ascending key, null keys last, until the summed size would pass the budget; for tables of any size.

    Sizes are at least 0. Sums by range of the key come first, one row a range; the window then runs inside the
    ranges that the budget reaches, on top of what the earlier ones hold. Rows of one key stay or go together.
    """
    cuts = rows.select(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 10 * ranges).alias("c")).first()["c"] or []
    part = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c < F.col(key))) if cuts else F.lit(0)
    rows = rows.withColumn("_part", F.when(F.col(key).isNull(), F.lit(ranges)).otherwise(part))
    before, total = [], None
    for r in sorted(rows.groupBy("_part").agg(F.sum(size).alias("n")).collect()):
        if (total or 0) <= budget:
            before.append((r["_part"], total))
        total = total if r["n"] is None else (total or 0) + r["n"]
    reached = rows.where(F.col("_part").isin([p for p, _ in before]))
    w = Window.partitionBy("_part").orderBy(key).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    offset = F.create_map(*[x for p, n in before for x in (F.lit(p), F.lit(n).cast("long"))])[F.col("_part")] if before else F.lit(None).cast("long")
    own = F.sum(size).over(w)
    return reached.withColumn("_sum", F.coalesce(own + offset, offset, own)).where(F.col("_sum") <= budget).drop("_sum", "_part")


def permuted(rows: DataFrame, order: Sequence[int], top: int, place: str = "place") -> DataFrame:
    """Rows in the order of a reranker's indices: repeated ones count once, missing ones follow in their old order."""
    seen = list(dict.fromkeys(int(i) for i in order))
    if not seen:
        return rows.orderBy(place).limit(top)
    at = F.create_map(*[F.lit(x) for pair in ((i, n) for n, i in enumerate(seen)) for x in pair])
    return rows.orderBy(F.coalesce(at[F.col(place).cast("int")], F.lit(len(seen)) + F.col(place)), place).limit(top)
