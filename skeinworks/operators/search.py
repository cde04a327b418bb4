"""Retrieval: tokens, keyword and vector candidates, ranking, paging."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.text import bound

CANDIDATES = 5000
#: Folders of a stored table of terms: part of its format.
TERM_BUCKETS = 64
#: Candidates that are fetched for each wanted result where a model ranks them anew.
RERANK_FETCH = 2.0
#: More query terms than this are joined by shuffle instead of going out to all tasks.
BROADCAST_TERMS = 10_000
_TERM = re.compile(r"[^\W_]+", re.UNICODE)


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def query_terms(query: str) -> list[str]:
    return list(dict.fromkeys(t.lower() for t in _TERM.findall(query)))


def term_counts(found: Column) -> Column:
    """(term, tf) of each distinct term of an array, null without any: sorted, and told apart where neighbours differ, inside the row."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: ~F.get(s, i).eqNullSafe(F.get(s, i - 1)))
        return bound(starts, lambda at: F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).alias("tf"))))

    return bound(F.sort_array(found), lambda s: F.when(F.size(s) > 0, runs(s)))


def term_table(rows: DataFrame, ident: str, text: str, wanted: Sequence[str] | None = None) -> DataFrame:
    """(ident, term, tf): the inverted table, worth storing partitioned by a hash of the term; of the `wanted` terms only, if given, so that
    no other term leaves its row. Else texts are moved once, to those of their id, and counted there: their terms are many times as large."""
    if wanted is not None:
        found = F.filter(terms(F.col(text)), lambda t: t.isin(list(wanted)))
        return rows.select(ident, F.explode(found).alias("term")).groupBy(ident, "term").agg(F.count(F.lit(1)).alias("tf"))
    whole = rows.groupBy(ident).agg(F.collect_list(text).alias("_t"))
    found = whole.select(ident, F.inline(term_counts(F.flatten(F.transform("_t", terms)))))
    return found.withColumn("tf", F.col("tf").cast("long"))


def write_terms(rows: DataFrame, ident: str, text: str, path: str) -> None:
    """The inverted table as Parquet, in folders by a hash of the term and sorted by term inside files, so that a query reads
    its terms' rows only. A bucket with a frequent term is written by several tasks."""
    table = term_table(rows, ident, text).withColumn("bucket", _bucket(F.col("term")))
    table.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(path)


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(TERM_BUCKETS)).cast("int")


def stored_scores(terms: DataFrame, ident: str, query: str) -> DataFrame:
    """As `keyword_scores`, from a table that `write_terms` wrote: no text is read. Sums are rounded to nine places, so
    that their order does not show."""
    wanted = query_terms(query)
    if not wanted:
        return terms.select(ident, F.lit(0.0).alias("keyword")).limit(0)
    found = terms.where(F.col("bucket").isin([_bucket(F.lit(w)) for w in wanted]) & F.col("term").isin(wanted))
    return found.groupBy(ident).agg(F.round(F.sum(F.log1p(F.col("tf").cast("double"))), 9).alias("keyword"))


def keyword_scores(rows: DataFrame, ident: str, text: str, query: str) -> DataFrame:
    """(ident, keyword): summed ln(1 + tf) of the query's terms; rows without any are left out.

    Only the query's terms are counted, so a text gives as many rows as it has distinct query terms. A query
    without a letter or digit gives no row.
    """
    wanted = query_terms(query)
    if not wanted:
        return rows.select(ident, F.lit(0.0).alias("keyword")).limit(0)
    found = F.filter(terms(F.col(text)), lambda t: t.isin(wanted))
    hits = rows.select(ident, found.alias("_t")).where(F.size("_t") > 0)

    def times(word: str) -> Column:
        return F.size(F.filter("_t", lambda t: t == word)).cast("double")

    score = sum((F.log1p(times(w)) for w in wanted), F.lit(0.0))
    return hits.select(ident, score.alias("keyword"))


def sparse_scores(tokens: DataFrame, query: DataFrame, ident: str) -> DataFrame:
    """(ident, keyword): dot product of sparse vectors, as a join on the token and a sum.

    tokens: ident, term, weight; query: term, q, one row a term, sent out whole only if small.
    """
    side = F.broadcast(query) if query.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else query
    return tokens.join(side, "term").groupBy(ident).agg(F.sum(F.col("weight") * F.col("q")).alias("keyword"))


def candidates(parts: Sequence[DataFrame], ident: str, most: int = CANDIDATES) -> DataFrame:
    """Union of each method's best rows (ident, score), each once."""
    out = None
    for p in parts:
        own = p.orderBy(F.desc("score"), ident).limit(most).select(ident)
        out = own if out is None else out.unionByName(own)
    return out.distinct()


def page(rows: DataFrame, order: Sequence[Column | str], offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def reranked(rows: DataFrame, query: str, text: str, model: Callable[[str, list[str]], list[int]], offset: int, limit: int, most: int | None = None) -> DataFrame:
    """A page of rows (with `score` and an id first) in the order of an outer model, which gets twice as many of the best as
    the page needs, or `most` if that is less. Rows that it does not name follow in their old order."""
    need = offset + limit
    fetch = int(need * RERANK_FETCH)
    ident = rows.columns[0]
    top = scoring.ranked(rows, "score", ident, min(fetch, most) if most else fetch).withColumn("place", F.col("rank") - 1)
    texts = [r[0] for r in top.orderBy("place").select(text).collect()]
    order = model(query, texts)[:need] if texts else []
    return scoring.permuted(top.drop("rank"), order, need).offset(offset).limit(limit)


def best_per_parent(rows: DataFrame, score: str = "score") -> DataFrame:
    """The best chunk of each parent."""
    found = rows.groupBy("original_entity_id").agg(F.max_by(F.struct(*rows.columns), F.struct(F.col(score), F.col("entity_id"))).alias("_r"))
    return found.select("_r.*")
