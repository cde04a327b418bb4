"""Search plans: tenant, filters and access in one predicate, then scores, fusion and paging."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import access, filters, postings, search
from ..operators import vectors as nearby

STRATEGIES = {"hybrid": "hybrid", "semantic": "semantic", "neural": "semantic", "keyword": "keyword"}
MOST_RESULTS = 1000


@dataclass
class SearchPlan:
    """A query with its variations (text and vectors), restrictions, strategy and page."""

    query: str
    variations: Sequence[str] = ()
    vectors: Sequence[Sequence[float]] = ()
    strategy: str = "hybrid"
    limit: int = 20
    offset: int = 0
    groups: Sequence[filters.Group] = ()
    user_groups: Sequence[filters.Group] = ()
    principals: Sequence[str] | None = None
    collection_id: str | None = None
    merge: str = "flat"
    dedupe_by_entity: bool = False
    errors: list[str] = field(default_factory=list)
    probes: int | None = None
    exact: bool = False

    def check(self) -> None:
        if self.strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {self.strategy}")
        if not 0 < self.limit <= MOST_RESULTS or self.offset < 0:
            raise ValueError("limit or offset out of range")

    def predicate(self) -> Column:
        """One native Column, so all of it can reach the scan."""
        parts = [filters.groups(filters.merged(self.user_groups, self.groups, self.merge)), access.visible(self.principals)]
        if self.collection_id is not None:
            parts.append(filters.tenant(self.collection_id))
        return filters.all_of(parts)

    @property
    def window(self) -> int:
        return max(scoring.RERANK_WINDOW, self.limit + self.offset)


@dataclass
class Stores:
    """Where the stored indexes of chunks are: a table of terms (`search.write_terms`), postings with BM25 weights (`postings.build`; they
    come before terms), vectors in lists (`vectors.build`, with the index's columns that filters and access need). What is not named is
    found by reading the index rows."""

    terms: DataFrame | None = None
    postings: str | None = None
    vectors: str | None = None


def _keyword(plan: SearchPlan, rows: DataFrame, stores: Stores, most: int) -> DataFrame:
    if stores.postings is not None:
        return postings.top(rows.sparkSession, stores.postings, "entity_id", plan.query, most, rows.select("entity_id"))
    if stores.terms is None:
        words = search.keyword_scores(rows, "entity_id", "textual_representation", plan.query)
    else:
        words = search.stored_scores(stores.terms, "entity_id", plan.query).join(rows.select("entity_id"), "entity_id", "left_semi")
    return words.orderBy(F.desc("keyword"), "entity_id").limit(most)


def _semantic(plan: SearchPlan, rows: DataFrame, stores: Stores, most: int) -> DataFrame:
    if stores.vectors is None:
        return scoring.nearest(rows, "dense_embedding", plan.vectors, most, "entity_id")
    found = nearby.nearest(rows.sparkSession, stores.vectors, "entity_id", "dense_embedding", plan.vectors, most, plan.probes, plan.exact, plan.predicate())
    return found.groupBy("entity_id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "entity_id").limit(most)


def candidates(plan: SearchPlan, index: DataFrame, stores: Stores | None = None) -> DataFrame:
    """(entity_id, keyword, semantic) of what either method finds among permitted rows: the best of each that a page could show, and
    CANDIDATES of each where both are fused."""
    plan.check()
    kind, stores = STRATEGIES[plan.strategy], stores or Stores()
    most = search.CANDIDATES if kind == "hybrid" or plan.dedupe_by_entity else plan.window
    rows = index.where(plan.predicate())
    nothing = rows.select("entity_id", F.lit(0.0).alias("keyword"), F.lit(0.0).alias("semantic")).limit(0)
    parts = []
    if kind in ("hybrid", "keyword"):
        parts.append(_keyword(plan, rows, stores, most).select("entity_id", "keyword", F.lit(None).cast("double").alias("semantic")))
    if kind in ("hybrid", "semantic") and plan.vectors:
        parts.append(_semantic(plan, rows, stores, most).select("entity_id", F.lit(None).cast("double").alias("keyword"), F.col("score").alias("semantic")))
    if not parts:
        return nothing
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("entity_id").agg(F.coalesce(F.max("keyword"), F.lit(0.0)).alias("keyword"), F.coalesce(F.max("semantic"), F.lit(0.0)).alias("semantic"))


def ranked(plan: SearchPlan, index: DataFrame, stores: Stores | None = None) -> DataFrame:
    """(entity_id, score) in the strategy's profile."""
    found = candidates(plan, index, stores)
    kind = STRATEGIES[plan.strategy]
    if kind == "hybrid":
        return scoring.hybrid(found, "keyword", "semantic", "entity_id", plan.window).select("entity_id", "score")
    return found.select("entity_id", F.col(kind).alias("score"))


class SourceError(Exception):
    """A query-time source that answered with an HTTP status."""

    def __init__(self, status: int):
        super().__init__(f"the source answered {status}")
        self.status = status


#: Answers after which a query-time source is asked again.
RETRIED = (429, 500, 502, 503, 504)


def retrying(fetch: Callable[[str, int], DataFrame], retries: int = 2, wait: float = 1.0) -> Callable[[str, int], DataFrame]:
    """fetch, asked again after passing faults, each time after twice the wait; other faults end the query at once."""

    def run(query: str, need: int) -> DataFrame:
        for k in range(retries):
            try:
                return fetch(query, need)
            except SourceError as e:
                if e.status not in RETRIED:
                    raise
                time.sleep(wait * 2**k)
        return fetch(query, need)

    return run


def run(plan: SearchPlan, index: DataFrame, federated: Sequence[Callable[[str, int], DataFrame]] = (), stores: Stores | None = None) -> DataFrame:
    """A page of results; rows of query-time sources (entity_id, access columns) are fused by reciprocal rank.

    With query-time sources all lists are read down to offset + limit before the page is cut; a failure of one
    fails the query.
    """
    need = plan.offset + plan.limit
    own = ranked(plan, index, stores)
    if plan.dedupe_by_entity:
        parents = index.select("entity_id", "original_entity_id")
        own = search.best_per_parent(own.join(parents, "entity_id")).select("entity_id", "score")
    if federated:
        lists = [scoring.ranked(own, "score", "entity_id", need)]
        for fetch in federated:
            rows = fetch(plan.query, need).limit(need)
            if plan.principals is not None:
                rows = rows.where(access.visible_in_memory(plan.principals))
            lists.append(scoring.ranked(rows.withColumn("score", -F.col("place").cast("double")), "score", "entity_id", need))
        own = scoring.reciprocal_rank_fusion(lists, "entity_id")
    return search.page(own, [F.desc("score"), F.col("entity_id")], plan.offset, plan.limit)


def count(plan: SearchPlan, index: DataFrame) -> int:
    return index.where(plan.predicate()).count()


def browse(plan: SearchPlan, index: DataFrame, name: str | None = None) -> DataFrame:
    """Unranked listing of entities (first chunks), by id."""
    rows = index.where(plan.predicate() & (F.col("chunk_index") == 0))
    if name:
        rows = rows.where(filters.name_contains(name))
    return search.page(rows, ["entity_id"], plan.offset, plan.limit)
