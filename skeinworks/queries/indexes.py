"""Stored indexes: BM25 postings (R2, R10, R11, J17) and vectors in lists (J18, T4, R1), and pages read from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import postings, vectors
from ..operators.filters import Condition
from ..plans import search as plans
from ..sources.scratch import new_folder
from .base import IDX, Register, index, table
from .ranking import _NEAR, _OTHERS, QUERY, _vector
from .ranking import vectors as with_vectors

reg = Register()
_AT: dict[tuple, str] = {}


def once(spark, kind: str, sf_dir: str, build) -> str:
    """The path of an index that `build` writes, once a session and folder, as an ingest run would."""
    at = (spark.sparkContext.applicationId, kind, sf_dir)
    if at not in _AT:
        path = new_folder(spark)
        build(path)
        _AT[at] = path
    return _AT[at]


def bm25(spark, sf_dir: str, size: int = postings.BLOCK) -> str:
    rows = index(spark, sf_dir)
    return once(spark, f"postings-{size}", sf_dir, lambda path: postings.build(rows, "entity_id", postings.whole_json(rows, ["doc_id"]), path, ["collection_id"], size))


_JSON = "to_json({'breadcrumbs': breadcrumbs, 'created_at': created_at, 'entity_id': entity_id, 'name': name, 'textual_representation': textual_representation, 'updated_at': updated_at})"


def _bm25(rows: str) -> str:
    return f"""tok as (select entity_id, unnest(regexp_extract_all(lower({_JSON}), '[\\p{{L}}\\p{{N}}]+')) as t from {rows}), len as (select entity_id, count(*) as length from tok group by all), st as (select count(*) as chunks, sum(length) / count(*) as mean from len),
tf as (select entity_id, ('0x' || substr(md5(t), 1, 8))::bigint as token, count(*)::double as tf from tok group by all), w as (select entity_id, token, tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)) as weight from tf join len using (entity_id), st),
df as (select token, ln(1 + (chunks - count(*) + 0.5) / (count(*) + 0.5)) as r from tf, st where token in (select ('0x' || substr(md5(t), 1, 8))::bigint from (values ('the'), ('and'), ('reerhan')) v(t)) group by token, chunks),
kw as (select entity_id, round(sum(weight * r), 9) as keyword from w join df using (token) group by entity_id)"""


_BM = f"{IDX}, {_bm25('idx')}"


@reg("r11_bm25_weights", f"with {_BM} select entity_id, token, round(weight, 6) as weight from w")
def _(spark, sf_dir):
    rows = index(spark, sf_dir)
    found = postings.counted(rows, "entity_id", postings.whole_json(rows, ["doc_id"]))
    mean = rows.select(F.avg(F.size(postings.search.terms(postings.whole_json(rows, ["doc_id"]))))).first()[0]
    return found.select("entity_id", "token", F.round(postings.weight(F.col("tf"), F.col("length"), mean or 1.0), 6).alias("weight"))


@reg("r02_bm25_scores", f"with {_BM} select entity_id, round(keyword, 6) as keyword from kw")
def _(spark, sf_dir):
    return postings.scores(spark, bm25(spark, sf_dir), "entity_id", QUERY).withColumn("keyword", F.round("keyword", 6))


@reg("r10_pruned_top", f"with {_BM} select entity_id, round(keyword, 6) as keyword from kw order by kw.keyword desc, entity_id limit 20")
def _(spark, sf_dir):
    return postings.top(spark, bm25(spark, sf_dir, 8), "entity_id", QUERY, 20).withColumn("keyword", F.round("keyword", 6))


@reg("r10_blocks_left_out", "select true as some_left_out")
def _(spark, sf_dir):
    """Whether a page of five leaves entries of blocks unread."""
    told: dict = {}
    postings.top(spark, bm25(spark, sf_dir, 8), "entity_id", QUERY, 5, told=told).count()
    return table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n")).select((F.lit(told.get("read", 0)) < F.lit(told.get("blocks", 0))).alias("some_left_out"))


_CHANGED = f"""{IDX}, live as (select * replace (case when doc_id % 7 = 0 then textual_representation || ' the and reerhan' else textual_representation end as textual_representation) from idx where doc_id % 11 <> 0), {_bm25('live')}"""


@reg("r11_bm25_after_changes", f"with {_CHANGED} select entity_id, round(keyword, 6) as keyword from kw")
def _(spark, sf_dir):
    """Chunks that changed are removed and added again, others removed for good; then the rest is written anew."""
    rows, path, target = index(spark, sf_dir), new_folder(spark), new_folder(spark)
    changed = rows.where("doc_id % 7 = 0 and doc_id % 11 <> 0").withColumn("textual_representation", F.concat("textual_representation", F.lit(" the and reerhan")))
    whole = postings.whole_json(rows, ["doc_id"])
    postings.build(rows, "entity_id", whole, path, ["collection_id"])
    postings.remove(rows.where("doc_id % 7 = 0 or doc_id % 11 = 0"), "entity_id", path)
    postings.build(changed, "entity_id", whole, path, ["collection_id"])
    postings.compacted(spark, path, "entity_id", target)
    return postings.scores(spark, target, "entity_id", QUERY).withColumn("keyword", F.round("keyword", 6))


@reg("search_bm25_page", f"""with {_BM}, f as (select entity_id from idx where collection_id = 'en' and chunk_index in (1, 2, 3) and (coalesce(access_is_public, false) or coalesce(list_has_any(access_viewers, ['user:u3']), false)))
select entity_id, round(keyword, 6) as score from kw where entity_id in (select entity_id from f) order by keyword desc, entity_id limit 15 offset 5""")
def _(spark, sf_dir):
    plan = plans.SearchPlan(QUERY, strategy="keyword", limit=15, offset=5, collection_id="en", principals=["user:u3"], groups=[[Condition("chunk_index", "in", [1, 2, 3])]])
    return plans.run(plan, index(spark, sf_dir), stores=plans.Stores(postings=bm25(spark, sf_dir))).select("entity_id", F.round("score", 6).alias("score"))


def listed(spark, sf_dir: str) -> str:
    """All of `embeddings` in lists, with the number of probes that they need."""

    def build(path: str) -> None:
        vectors.build(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", path)
        vectors.calibrated(spark, path, "vec_id", "embedding")

    return once(spark, "lists", sf_dir, build)


def _asked(spark, sf_dir) -> tuple[list[int], list[list[float]]]:
    """Every vector whose id is divisible by 100; they go out in blocks of at most vectors.QUERY_BLOCK."""
    rows = table(spark, sf_dir, "embeddings").where((F.col("vec_id") % 100 == 0) & vectors.usable("embedding")).orderBy("vec_id").collect()
    return [r.vec_id for r in rows], [r.embedding for r in rows]


def _nearest(spark, sf_dir, **how):
    ids, asked = _asked(spark, sf_dir)
    found = vectors.nearest(spark, listed(spark, sf_dir), "vec_id", "embedding", asked, 10, **how)
    return found.withColumn("query_id", F.array(*map(F.lit, ids)).cast("array<bigint>")[F.col("query")])


_NEAREST = """s as (select q.vec_id as query_id, x.vec_id, 1 / (1 + acos(greatest(least(list_cosine_similarity(x.embedding::double[], q.embedding::double[]), 1.0), -1.0))) as score
  from embeddings x join (select * from embeddings where vec_id % 100 = 0) q on len(x.embedding) = len(q.embedding)),
n as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)"""


@reg("j18_nearest_exact", f"with {_NEAREST} select query_id, vec_id, round(score, 5) as score from n where rank <= 10")
def _(spark, sf_dir):
    """Lists are left out only where their radius shows that nothing in them is nearer."""
    return _nearest(spark, sf_dir, exact=True).select("query_id", "vec_id", F.round("score", 5).alias("score"))


@reg("j18_recall_of_probes", "select count(*) as queries, true as recall_is_enough, true as reads_less from embeddings where vec_id % 100 = 0")
def _(spark, sf_dir):
    """Recall at 10 of the probed lists against the full scan, at least 0.9, and whether fewer rows are read."""
    told: list = []
    some = _nearest(spark, sf_dir, told=told).select("query_id", "vec_id").withColumn("hit", F.lit(1))
    whole = _nearest(spark, sf_dir, exact=True).select("query_id", "vec_id")
    each = whole.join(some, ["query_id", "vec_id"], "left").groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    less = all(t["rows_read"] < t["rows"] for t in told)
    return each.agg(F.count(F.lit(1)).alias("queries"), (F.avg("recall") >= 0.9).alias("recall_is_enough")).withColumn("reads_less", F.lit(less))


def near_index(spark, sf_dir: str) -> str:
    """Index rows with vectors, in lists."""
    return once(spark, "near", sf_dir, lambda path: vectors.build(with_vectors(spark, sf_dir).drop("textual_representation"), "entity_id", "dense_embedding", path))


@reg("search_semantic_page_probed", f"with {_NEAR} select entity_id, round(semantic, 5) as score from sem order by semantic desc, entity_id limit 10 offset 3")
def _(spark, sf_dir):
    plan = plans.SearchPlan("", vectors=[_vector(spark, sf_dir, 0), _vector(spark, sf_dir, 1)], strategy="neural", limit=10, offset=3, groups=_OTHERS, exact=True)
    return plans.run(plan, index(spark, sf_dir), stores=plans.Stores(vectors=near_index(spark, sf_dir))).select("entity_id", F.round("score", 5).alias("score"))


@reg("j18_lists_after_changes", f"with {_NEAREST.replace('from embeddings x', 'from (select * from embeddings where vec_id % 7 <> 3) x')} select query_id, vec_id, round(score, 5) as score from n where rank <= 10")
def _(spark, sf_dir):
    """Vectors that come later go to the lists that are there; some go, of which a part comes back."""
    rows, path = table(spark, sf_dir, "embeddings"), new_folder(spark)
    vectors.build(rows.where("vec_id % 3 <> 0"), "vec_id", "embedding", path)
    vectors.add(rows.where("vec_id % 3 = 0"), "embedding", path)
    vectors.remove(rows.where("vec_id % 7 in (3, 4)").select(F.col("vec_id")), path)
    vectors.add(rows.where("vec_id % 7 = 4"), "embedding", path)
    ids, asked = _asked(spark, sf_dir)
    found = vectors.nearest(spark, path, "vec_id", "embedding", asked, 10, exact=True)
    return found.select(F.array(*map(F.lit, ids)).cast("array<bigint>")[F.col("query")].alias("query_id"), "vec_id", F.round("score", 5).alias("score"))
