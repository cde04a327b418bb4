"""Scores, fusion, paging, navigation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import hierarchy, lookups, search
from ..operators.filters import Condition
from ..plans import search as plans
from ..sources.scratch import new_folder
from .base import CHUNKS, IDX, Register, chunks, index, table

reg = Register()
QUERY = "the and reerhan"
_TERMS = ["the", "and", "reerhan"]
_TOK = "tok as (select doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as t from documents)"
KEYWORD = f"{_TOK}, tf as (select doc_id, t, count(*) as n from tok where t in ('the', 'and', 'reerhan') group by all), kw as (select doc_id, sum(ln(1 + n)) as keyword from tf group by doc_id)"
_Q0 = "q as (select embedding as e from embeddings where vec_id = 0)"
_COS = "greatest(least(list_cosine_similarity(x.embedding::double[], q.e::double[]), 1.0), -1.0)"


def _vector(spark, sf_dir, vec_id: int) -> list[float]:
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]


@reg("r01_closeness", f"with {_Q0} select vec_id, round(1 / (1 + acos({_COS})), 5) as score from embeddings x, q where vec_id <> 0 order by 1 / (1 + acos({_COS})) desc, vec_id limit 20")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").where("vec_id <> 0")
    return scoring.nearest(rows, "embedding", [_vector(spark, sf_dir, 0)], 20, "vec_id").select("vec_id", F.round("score", 5).alias("score"))


@reg("r01_closest_of_several", "with q as (select embedding as e from embeddings where vec_id in (0, 1, 2)), s as (select vec_id, max(1 / (1 + acos(greatest(least(list_cosine_similarity(x.embedding::double[], q.e::double[]), 1.0), -1.0)))) as s from embeddings x, q where vec_id > 2 group by vec_id) select vec_id, round(s, 5) as score from s order by s desc, vec_id limit 20")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").where("vec_id > 2")
    return scoring.nearest(rows, "embedding", [_vector(spark, sf_dir, i) for i in (0, 1, 2)], 20, "vec_id").select("vec_id", F.round("score", 5).alias("score"))


@reg("r02_keyword_scores", f"with {KEYWORD} select doc_id, round(keyword, 6) as keyword from kw")
def _(spark, sf_dir):
    out = search.keyword_scores(table(spark, sf_dir, "documents"), "doc_id", "text", QUERY)
    return out.select("doc_id", F.round("keyword", 6).alias("keyword"))


@reg("j17_sparse_dot", f"with {_TOK}, w as (select doc_id, t, ln(1 + count(*)) as w from tok group by all), q(t, q) as (values ('the', 0.5), ('of', 0.25), ('die', 1.0)) select doc_id, round(sum(w * q), 6) as keyword from w join q using (t) group by doc_id")
def _(spark, sf_dir):
    weights = {"the": 0.5, "of": 0.25, "die": 1.0}
    t = search.term_table(table(spark, sf_dir, "documents"), "doc_id", "text", list(weights)).withColumn("weight", F.log1p(F.col("tf").cast("double")))
    q = spark.createDataFrame([*weights.items()], "term string, q double")
    return search.sparse_scores(t, q, "doc_id").select("doc_id", F.round("keyword", 6).alias("keyword"))


@reg("r11_term_weights", f"with {_TOK} select doc_id, t as term, round(ln(1 + count(*)), 6) as weight from tok group by all")
def _(spark, sf_dir):
    t = search.term_table(table(spark, sf_dir, "documents"), "doc_id", "text")
    return t.select("doc_id", "term", F.round(F.log1p(F.col("tf").cast("double")), 6).alias("weight"))


@reg("r09_blank_query", "select 0::bigint as n")
def _(spark, sf_dir):
    return search.keyword_scores(table(spark, sf_dir, "documents"), "doc_id", "text", " . ?!").agg(F.count(F.lit(1)).alias("n"))


_HYBRID = f"""{KEYWORD}, {_Q0}, sem as (select vec_id as doc_id, 1 / (1 + acos({_COS})) as semantic from embeddings x, q),
c as (select doc_id, coalesce(keyword, 0) as k, coalesce(semantic, 0) as s from kw full join sem using (doc_id)),
t as (select * from c order by round(k + s, 9) desc, doc_id limit 100),
n as (select doc_id, (k - min(k) over ()) / (max(k) over () - min(k) over ()) + (s - min(s) over ()) / (max(s) over () - min(s) over ()) as score from t)"""


@reg("r04_hybrid", f"with {_HYBRID} select doc_id, round(score, 4) as score from n")
def _(spark, sf_dir):
    q = _vector(spark, sf_dir, 0)
    words = search.keyword_scores(table(spark, sf_dir, "documents"), "doc_id", "text", QUERY)
    near = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), scoring.closeness(F.col("embedding"), F.array(*map(F.lit, q))).alias("semantic"))
    both = words.join(near, "doc_id", "full_outer").fillna(0.0, ["keyword", "semantic"])
    top = both.orderBy(F.desc(F.round(F.col("keyword") + F.col("semantic"), 9)), "doc_id").limit(100)
    return scoring.hybrid(top, "keyword", "semantic", "doc_id").select("doc_id", F.round("score", 4).alias("score"))


_LISTS = f"{KEYWORD}, a as (select doc_id, row_number() over (order by round(keyword, 9) desc, doc_id) as rank from kw), b as (select doc_id, row_number() over (order by length(text) desc, doc_id) as rank from documents)"


@reg("a17_rank_fusion", f"with {_LISTS}, u as (select * from a where rank <= 50 union all select * from b where rank <= 50) select doc_id, round(sum(1.0 / (60 + rank)), 8) as score from u group by doc_id")
def _(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    words = search.keyword_scores(d, "doc_id", "text", QUERY).withColumn("keyword", F.round("keyword", 9))
    one = scoring.ranked(words, "keyword", "doc_id", 50)
    two = scoring.ranked(d.select("doc_id", F.length("text").alias("n")), "n", "doc_id", 50)
    return scoring.reciprocal_rank_fusion([one, two], "doc_id").select("doc_id", F.round("score", 8).alias("score"))


@reg("t01_page", f"with {KEYWORD} select doc_id from kw order by round(keyword, 9) desc, doc_id limit 20 offset 10")
def _(spark, sf_dir):
    words = search.keyword_scores(table(spark, sf_dir, "documents"), "doc_id", "text", QUERY)
    return search.page(words, [F.desc(F.round("keyword", 9)), F.col("doc_id")], 10, 20).select("doc_id")


@reg("t06_newest_page", "select o_orderkey from orders order by o_orderdate desc, o_orderkey limit 25 offset 50")
def _(spark, sf_dir):
    return search.page(table(spark, sf_dir, "orders"), [F.desc("o_orderdate"), F.col("o_orderkey")], 50, 25).select("o_orderkey")


@reg("t08_reranked", "select o_orderkey, n::bigint as n from (values (3, 0), (1, 1), (0, 2), (2, 3), (4, 4)) t(place, n) join (select o_orderkey, row_number() over (order by o_orderkey) - 1 as place from orders) using (place)")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    rows = scoring.ranked(rows.select("o_orderkey", (-F.col("o_orderkey")).alias("s")), "s", "o_orderkey", 10).withColumn("place", F.col("rank") - 1)
    out = scoring.permuted(rows, [3, 1, 3, 0], 5)
    order = F.create_map(*[F.lit(x) for p in ((3, 0), (1, 1), (0, 2), (2, 3), (4, 4)) for x in p])
    return out.select("o_orderkey", order[F.col("place").cast("int")].cast("bigint").alias("n"))


@reg("w08_budget_prefix", "with r as (select doc_id, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) as n from documents), s as (select doc_id, sum(n) over (order by doc_id) as t from r) select doc_id from s where t <= 20000")
def _(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    sized = d.select("doc_id", F.size(F.array_remove(F.split("text", "[\\x20\\x09-\\x0D]+"), "")).alias("n"))
    return scoring.within_budget_by_ranges(sized, "n", "doc_id", 20000).select("doc_id")


@reg("a14_best_by_id", "select l_partkey as id, round(max(l_extendedprice), 4) as score from lineitem group by l_partkey")
def _(spark, sf_dir):
    return lookups.best_by_id(table(spark, sf_dir, "lineitem"), "l_partkey", "l_extendedprice").withColumn("score", F.round("score", 4))


@reg("a15_first_by_id", "select l_orderkey as id, min_by(l_partkey, (l_linenumber, l_partkey)) as part from lineitem group by l_orderkey")
def _(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("part"))
    return lookups.first_by_id(l, "l_orderkey", ["l_linenumber", "part"]).select("id", "part")


@reg("q15_best_chunk_per_parent", f"with {CHUNKS} select original_entity_id, max_by(entity_id, (length(text), entity_id)) as entity_id from chunks group by original_entity_id")
def _(spark, sf_dir):
    c = chunks(spark, sf_dir).withColumn("score", F.length("text"))
    return search.best_per_parent(c).select("original_entity_id", "entity_id")


@reg("u03_candidates", f"with {KEYWORD}, a as (select doc_id from kw order by round(keyword, 9) desc, doc_id limit 30), b as (select doc_id from documents order by length(text) desc, doc_id limit 30) select doc_id from a union select doc_id from b")
def _(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    words = search.keyword_scores(d, "doc_id", "text", QUERY).select("doc_id", F.round("keyword", 9).alias("score"))
    return search.candidates([words, d.select("doc_id", F.length("text").alias("score"))], "doc_id", 30)


@reg("search_keyword_page", f"""with {IDX}, f as (select * from idx where collection_id = 'en' and chunk_index in (1, 2, 3) and (coalesce(access_is_public, false) or coalesce(list_has_any(access_viewers, ['user:u3']), false))),
tok as (select entity_id, unnest(regexp_extract_all(lower(textual_representation), '[\\p{{L}}\\p{{N}}]+')) as t from f), tf as (select entity_id, t, count(*) as n from tok where t in ('the', 'and', 'reerhan') group by all)
select entity_id, round(sum(ln(1 + n)), 6) as score from tf group by entity_id order by round(sum(ln(1 + n)), 9) desc, entity_id limit 15 offset 5""")
def _(spark, sf_dir):
    plan = plans.SearchPlan(QUERY, strategy="keyword", limit=15, offset=5, collection_id="en", principals=["user:u3"], groups=[[Condition("chunk_index", "in", [1, 2, 3])]])
    found = plans.ranked(plan, index(spark, sf_dir), plans.Stores(terms(spark, sf_dir)))
    return search.page(found, [F.desc("score"), F.col("entity_id")], 5, 15).select("entity_id", F.round("score", 6).alias("score"))


_TERMS_AT: dict[tuple[str, str], str] = {}


def terms(spark, sf_dir):
    """The stored table of terms of `documents`, written once a session and folder, as an ingest run would."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _TERMS_AT:
        path = new_folder(spark)
        search.write_terms(index(spark, sf_dir), "entity_id", "textual_representation", path)
        _TERMS_AT[at] = path
    return spark.read.parquet(_TERMS_AT[at])


@reg("search_index", f"with {_TOK} select doc_id || '__chunk_0' as entity_id, t as term, count(*) as tf from tok group by all")
def _(spark, sf_dir):
    return terms(spark, sf_dir).select("entity_id", "term", "tf")


def vectors(spark, sf_dir):
    """Index rows with the vectors that `embeddings` has for them."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("dense_embedding"))
    return index(spark, sf_dir).join(v, "doc_id", "left")


_NEAR = f"""{IDX}, q as (select embedding as e from embeddings where vec_id in (0, 1)), f as (select idx.*, embedding from idx left join embeddings on vec_id = doc_id where source_name <> 'src1'),
sem as (select entity_id, max(1 / (1 + acos({_COS.replace("x.embedding", "f.embedding")}))) as semantic from f, q where f.embedding is not null group by entity_id)"""
_OTHERS = [[Condition("source_name", "not_equals", "src1")]]


@reg("search_semantic_page", f"with {_NEAR} select entity_id, round(semantic, 5) as score from sem order by semantic desc, entity_id limit 10 offset 3")
def _(spark, sf_dir):
    plan = plans.SearchPlan("", vectors=[_vector(spark, sf_dir, 0), _vector(spark, sf_dir, 1)], strategy="neural", limit=10, offset=3, groups=_OTHERS)
    return plans.run(plan, vectors(spark, sf_dir)).select("entity_id", F.round("score", 5).alias("score"))


@reg("search_hybrid_page", f"""with {_NEAR}, tok as (select entity_id, unnest(regexp_extract_all(lower(textual_representation), '[\\p{{L}}\\p{{N}}]+')) as t from f), tf as (select entity_id, t, count(*) as n from tok where t in ('the', 'and', 'reerhan') group by all),
kw as (select entity_id, round(sum(ln(1 + n)), 9) as keyword from tf group by entity_id), ka as (select * from kw order by keyword desc, entity_id limit 5000), sa as (select * from sem order by semantic desc, entity_id limit 5000),
c as (select entity_id, coalesce(keyword, 0) as k, coalesce(semantic, 0) as s from ka full join sa using (entity_id)), t as (select * from c order by k + s desc, entity_id limit 100),
n as (select entity_id, (k - min(k) over ()) / (max(k) over () - min(k) over ()) + (s - min(s) over ()) / (max(s) over () - min(s) over ()) as score from t)
select entity_id, round(score, 4) as score from n order by score desc, entity_id limit 12 offset 2""")
def _(spark, sf_dir):
    plan = plans.SearchPlan(QUERY, vectors=[_vector(spark, sf_dir, 0), _vector(spark, sf_dir, 1)], limit=12, offset=2, groups=_OTHERS)
    return plans.run(plan, vectors(spark, sf_dir), stores=plans.Stores(terms(spark, sf_dir))).select("entity_id", F.round("score", 4).alias("score"))


@reg("search_best_of_parents", f"""with {CHUNKS}, tok as (select entity_id, original_entity_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) as t from chunks), tf as (select entity_id, original_entity_id, t, count(*) as n from tok where t in ('the', 'and', 'reerhan') group by all),
kw as (select entity_id, original_entity_id, sum(ln(1 + n)) as keyword from tf group by all), b as (select original_entity_id, max(round(keyword, 9)) as score, max_by(entity_id, (round(keyword, 9), entity_id)) as entity_id from kw group by all)
select entity_id, round(score, 6) as score from b order by score desc, entity_id limit 20""")
def _(spark, sf_dir):
    rows = chunks(spark, sf_dir).select("entity_id", "original_entity_id", F.col("text").alias("textual_representation"))
    path = new_folder(spark)
    search.write_terms(rows, "entity_id", "textual_representation", path)
    plan = plans.SearchPlan(QUERY, strategy="keyword", limit=20, dedupe_by_entity=True)
    return plans.run(plan, rows, stores=plans.Stores(spark.read.parquet(path))).select("entity_id", F.round("score", 6).alias("score"))


@reg("s03_federated_page", f"""with {KEYWORD}, a as (select doc_id || '__chunk_0' as entity_id, row_number() over (order by round(keyword, 9) desc, doc_id || '__chunk_0') as rank from kw), b as (select 'b' || item_id as entity_id, row_number() over (order by item_id) as rank from benchmark),
u as (select * from a where rank <= 14 union all select * from b where rank <= 14), s as (select entity_id, sum(1.0::double / (60 + rank)) as score from u group by entity_id)
select entity_id, round(score, 8) as score from s order by s.score desc, entity_id limit 10 offset 4""")
def _(spark, sf_dir):
    """A query-time source beside the index: both lists are read down to the page's end and fused by rank."""
    fetch = lambda query, need: table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("entity_id"), (F.col("item_id") + 1).alias("place")).orderBy("place").limit(need)
    plan = plans.SearchPlan(QUERY, strategy="keyword", limit=10, offset=4)
    return plans.run(plan, index(spark, sf_dir), [plans.retrying(fetch)], plans.Stores(terms(spark, sf_dir))).select("entity_id", F.round("score", 8).alias("score"))


@reg("t09_reranked_by_model", f"with {KEYWORD}, c as (select doc_id, text from kw join documents using (doc_id) order by round(keyword, 9) desc, doc_id limit 30), r as (select doc_id, row_number() over (order by length(text), doc_id) as k from c) select doc_id from r order by k limit 10 offset 5")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = search.keyword_scores(docs, "doc_id", "text", QUERY).select("doc_id", F.round("keyword", 9).alias("score")).join(docs, "doc_id")
    ids = lambda query, texts: sorted(range(len(texts)), key=lambda i: len(texts[i]))
    return search.reranked(found, QUERY, "text", ids, 5, 10).select("doc_id")


@reg("n01_children", f"with {IDX} select entity_id from idx where breadcrumbs[-1].entity_id = 'src4' order by entity_id limit 20")
def _(spark, sf_dir):
    return hierarchy.children(index(spark, sf_dir), "src4", 20).select("entity_id")


@reg("n02_siblings", f"with {IDX} select entity_id from idx where breadcrumbs[-1].entity_id = (select breadcrumbs[-1].entity_id from idx where entity_id = '7__chunk_0') order by entity_id limit 50")
def _(spark, sf_dir):
    return hierarchy.siblings(index(spark, sf_dir), "7__chunk_0").select("entity_id")


@reg("n03_parents", "select 'n' || n_nationkey as entity_id, 'r' || n_regionkey || '__chunk_0' as parent_id from nation")
def _(spark, sf_dir):
    up = table(spark, sf_dir, "region").selectExpr("concat('r', r_regionkey, '__chunk_0') as entity_id", "concat('r', r_regionkey) as original_entity_id", "0 as chunk_index", "cast(null as array<struct<entity_id:string,name:string,entity_type:string>>) as breadcrumbs")
    rows = table(spark, sf_dir, "nation").selectExpr("concat('n', n_nationkey) as entity_id", "concat('n', n_nationkey) as original_entity_id", "0 as chunk_index", "array(named_struct('entity_id', concat('r', n_regionkey), 'name', 'r', 'entity_type', 'RegionEntity')) as breadcrumbs")
    return hierarchy.parents(up.unionByName(rows))


@reg("n04_surrounding", f"with {CHUNKS}, m as (select original_entity_id, min(chunk_index) as lo, max(chunk_index) as hi, list(chunk_index) as l from chunks where length(text) % 5 = 0 group by all) select c.entity_id, list_contains(l, chunk_index) as is_match from chunks c join m using (original_entity_id) where chunk_index between lo - 2 and hi + 2")
def _(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return hierarchy.surrounding(c, c.where(F.length("text") % 5 == 0)).select("entity_id", "is_match")


@reg("n05_rendered", f"with {CHUNKS}, r as (select original_entity_id, string_agg((case when length(text) % 5 = 0 then '>> ' else '   ' end) || '[' || chunk_index || '] ' || text, chr(10) order by chunk_index, text) as rendered from chunks group by all) select * from r")
def _(spark, sf_dir):
    return hierarchy.rendered(chunks(spark, sf_dir).withColumn("is_match", F.length("text") % 5 == 0))


@reg("n08_collected", "select o_custkey::varchar as entity_id from orders where o_custkey % 7 = 0 union select o_custkey::varchar from orders where o_custkey % 5 = 0 and o_custkey % 3 <> 0 except select o_custkey::varchar from orders where o_custkey % 35 = 0")
def _(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c"), F.col("o_custkey").cast("string").alias("entity_id"))
    return hierarchy.collected(o.where("c % 7 = 0"), o.where("c % 5 = 0 and c % 3 <> 0"), o.where("c % 35 = 0"))
