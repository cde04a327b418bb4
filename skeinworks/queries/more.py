"""Further sources, sinks, joins and limits (S2-S8, K5, K12, K13, J3, J11, J12, A5, A6, A24, W2, W9, T2-T5, U1, U4, U5, R3, R10, R13, R15, R22, C5-C9, C20, ST7, ST15, ST17, M3, M10)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import charset, convert, scoring, text
from ..operators import embed, lookups, metadata, search
from ..operators import rows as projections
from ..sources import stores
from ..sources.scratch import new_folder
from .base import IDX, JOBS, Register, index, jobs, table
from .stores import tree

reg = Register()


@reg("s04_browse_children", "select 'n' || n_nationkey as node_id from nation where n_regionkey = 1")
def _(spark, sf_dir):
    return stores.browse_children(tree(spark, sf_dir), "r1").select("node_id")


@reg("s08_snapshot_source", "select doc_id, 'snapshot:' || source as source_name from documents")
def _(spark, sf_dir):
    root = new_folder(spark)
    table(spark, sf_dir, "documents").select("doc_id", "source").write.json(root)
    return stores.snapshot(spark.read.schema("doc_id long, source string").json(root).withColumnRenamed("source", "source_name"))


@reg("k12_selections_replaced", "select c_nationkey as part, c_custkey as node_id from customer where c_nationkey <> 3 union all select 3, -1")
def _(spark, sf_dir):
    root = new_folder(spark)
    stores.replace_selections(table(spark, sf_dir, "customer").selectExpr("c_nationkey as connection_id", "c_custkey as node_id"), root)
    stores.replace_selections(spark.createDataFrame([(3, -1)], "connection_id int, node_id long"), root)
    return spark.read.parquet(root).selectExpr("cast(connection_id as int) as part", "node_id")


@reg("k13_index_rows", f"with {IDX} select entity_type || '_' || entity_id as document_id, collection_id, 'base_entity' as schema_name, created_at from idx")
def _(spark, sf_dir):
    rows = index(spark, sf_dir)
    return projections.index_ids(rows).select("document_id", "collection_id", "schema_name", "created_at")


@reg("k05_delete_by_selection", f"with {IDX} select entity_id from idx where not coalesce(source_name = 'src2' and chunk_index > 1, false)")
def _(spark, sf_dir):
    return lookups.deleted_by_selection(index(spark, sf_dir), (F.col("source_name") == "src2") & (F.col("chunk_index") > 1)).select("entity_id")


@reg("j03_stale_paths", "select doc_id from documents where doc_id % 9 = 0")
def _(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    return lookups.stale(d, d.where("doc_id % 9 <> 0"), ["doc_id"])


@reg("j11_connections_with_collection", "select c_custkey, n_name as collection from customer left join (select * from nation where n_nationkey < 20) on n_nationkey = c_nationkey")
def _(spark, sf_dir):
    n = table(spark, sf_dir, "nation").where("n_nationkey < 20").selectExpr("n_nationkey as collection_id", "n_name as name")
    return lookups.with_collection(table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "collection_id"), n).select("c_custkey", "collection")


@reg("j12_sync_connections", "select s_suppkey, n_name from supplier join nation on s_nationkey = n_nationkey")
def _(spark, sf_dir):
    links = table(spark, sf_dir, "nation").selectExpr("n_nationkey as connection_id", "n_name as name")
    return lookups.sync_connections(table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "connection_id"), links).select("s_suppkey", F.col("connection").alias("n_name"))


@reg("a05_organisation_members", "select c_nationkey as org_id, count(*) as n_users, round(max(c_acctbal), 4) as last_active from customer group by all")
def _(spark, sf_dir):
    c = table(spark, sf_dir, "customer").selectExpr("c_nationkey as org_id", "c_acctbal as last_active")
    return lookups.members(c).withColumn("last_active", F.round("last_active", 4))


@reg("a24_operation_sums", "select user_id, (count_if(event_id % 7 < 3) + count_if(event_id % 7 = 5))::bigint as n from events group by all")
def _(spark, sf_dir):
    return lookups.operation_sum(jobs(spark, sf_dir), ["completed", "running"]).withColumnRenamed("sync_id", "user_id")


@reg("w02_latest_with_error", f"with {JOBS}, l as (select *, row_number() over (partition by sync_id order by created_at desc, job_id desc) as rn from jobs) select sync_id, case when status = 'failed' then event_type end as error_category from l where rn = 1")
def _(spark, sf_dir):
    last = metadata.latest(jobs(spark, sf_dir))
    return last.select("sync_id", F.when(F.col("status") == "failed", F.col("event_type")).alias("error_category"))


@reg("t02_over_fetched_page", "with a as (select doc_id as id, length(text) as s from documents order by s desc, id limit 30), b as (select item_id + 1000000 as id, length(text) as s from benchmark order by s desc, id limit 30) select id from (select * from a union all select * from b) order by s desc, id limit 20 offset 10")
def _(spark, sf_dir):
    a = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.length("text").alias("s"))
    b = table(spark, sf_dir, "benchmark").select((F.col("item_id") + 1000000).alias("id"), F.length("text").alias("s"))
    top = lambda x: x.orderBy(F.desc("s"), "id").limit(30)
    return search.page(top(a).unionByName(top(b)), [F.desc("s"), F.col("id")], 10, 20).select("id")


@reg("u05_common_principals", f"with {IDX} select entity_id, array_to_string(list_sort(list_intersect(access_viewers, ['user:u1', 'group:g1', 'group:g2'])), ',') as both from idx where list_has_any(access_viewers, ['user:u1', 'group:g1', 'group:g2'])")
def _(spark, sf_dir):
    return lookups.common_principals(index(spark, sf_dir), ["user:u1", "group:g1", "group:g2"]).select("entity_id", F.array_join("both", ",").alias("both"))


@reg("r10_any_term", "select doc_id from documents where list_has_any(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ['theaou', 'reerhan', 'worthless'])")
def _(spark, sf_dir):
    return search.keyword_scores(table(spark, sf_dir, "documents"), "doc_id", "text", "theaou, reerhan; worthless").select("doc_id")


@reg("r13_hashed_vectors")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return embed.checked(embed.hashing(rows, "text"), "dense_embedding", 64)


@reg("r22_keywords_fused", "with k(w) as (values ('the'), ('of'), ('and')), c as (select doc_id, w, len(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda t: t = w)) as n from documents, k), r as (select doc_id, w, row_number() over (partition by w order by n desc, doc_id) as rank from c where n > 0) select doc_id, round(sum(1.0 / (60 + rank)), 8) as score from r where rank <= 25 group by doc_id")
def _(spark, sf_dir):
    d, lists = table(spark, sf_dir, "documents"), []
    for w in ("the", "of", "and"):
        lists.append(scoring.ranked(_count(d, w).where("n > 0"), "n", "doc_id", 25))
    return scoring.reciprocal_rank_fusion(lists, "doc_id").select("doc_id", F.round("score", 8).alias("score"))


def _count(d, word):
    return d.select("doc_id", F.size(F.filter(search.terms(F.col("text")), lambda t: t == word)).alias("n"))


@reg("c05_routes", "select page_id, case when ends_with(url, '.html') then 'html' end as kind from pages")
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", convert.route(F.col("url")).alias("kind")).withColumn("kind", F.when(F.col("kind") == "html", F.col("kind")))


@reg("c06_markdown")
def _(spark, sf_dir):
    return convert.html_to_markdown(table(spark, sf_dir, "pages")).select("page_id", "markdown")


@reg("c07_files_decoded", "select doc_id, text from documents where length(trim(text)) > 0")
def _(spark, sf_dir):
    return _decoded(table(spark, sf_dir, "documents"))


@reg("c07_files_decoded_all", "select doc_id, text from documents where length(trim(text)) > 0")
def _(spark, sf_dir):
    return _decoded(table(spark, sf_dir, "documents"))


def _decoded(d):
    d = d.select("doc_id", F.lit("a.txt").alias("path"), F.col("text").cast("binary").alias("content"))
    return convert.convert_files(d).select("doc_id", "text")


#: Charsets that hold all letters of the documents.
_WRITTEN = ("cp1252", "cp850", "mac_roman", "utf_16_le", "utf_16_be", "utf_8", "iso8859_15", "gb18030")


def written_in(texts, charsets=_WRITTEN):
    """(doc_id, charset, content): each text in a charset by its id; in UTF-8 where that one lacks a character."""

    @F.pandas_udf("binary")
    def encode(found: pd.Series, names: pd.Series) -> pd.Series:
        out = []
        for t, name in zip(found, names, strict=True):
            try:
                out.append(t.encode(name))
            except UnicodeEncodeError:
                out.append(t.encode())
        return pd.Series(out, dtype=object)

    name = F.element_at(F.array(*map(F.lit, charsets)), (F.col("doc_id") % len(charsets) + 1).cast("int"))
    return texts.where("text is not null").select("doc_id", encode("text", name).alias("content"))


@reg("c07_charsets", "select doc_id, text from documents where text is not null")
def _(spark, sf_dir):
    """All texts, written in eight charsets, come back by what the corpus's pairs of characters are, and its words where these leave a text open."""
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    return charset.decoded(written_in(texts), charset.learn(texts), known=charset.contexts(texts)).select("doc_id", "text")


@reg("c08_json_fenced", "select event_id, '```json' || chr(10) || '{' || chr(10) || '  \"k\": ' || (props->>'$.k') || chr(10) || '}' || chr(10) || '```' as text from events where props is not null")
def _(spark, sf_dir):
    return _fenced(table(spark, sf_dir, "events"))


@reg("c08_json_fenced_all", "select event_id, '```json' || chr(10) || '{' || chr(10) || '  \"k\": ' || (props->>'$.k') || chr(10) || '}' || chr(10) || '```' as text from events where props is not null")
def _(spark, sf_dir):
    return _fenced(table(spark, sf_dir, "events"))


def _fenced(e):
    e = e.select("event_id", F.lit("a.json").alias("path"), F.col("props").cast("binary").alias("content"))
    return convert.convert_files(e).select("event_id", "text")


@reg("c09_code_decoded", "select doc_id from documents where doc_id % 2 = 0 and length(trim(text)) > 0")
def _(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    content = F.when(F.col("doc_id") % 2 == 0, F.col("text").cast("binary")).otherwise(F.unhex(F.lit("fffe00d8")))
    return convert.convert_files(d.select("doc_id", F.lit("a.py").alias("path"), content.alias("content"))).select("doc_id")


@reg("c20_file_hash", "select page_id, sha256(html) as file_hash from pages")
def _(spark, sf_dir):
    return stores.hashed_files(table(spark, sf_dir, "pages").select("page_id", F.col("html").cast("binary").alias("content"))).select("page_id", "file_hash")


@reg("st15_usage_flushed", "select user_id, event_type, sum(event_id % 3)::bigint as used from events group by all having sum(event_id % 3) >= 10")
def _(spark, sf_dir):
    return lookups.flushed(table(spark, sf_dir, "events"), ["user_id", "event_type"], F.col("event_id") % 3, lookups.FLUSH["queries"])


@reg("st17_errors_split", "select event_id, (props->>'$.k')::int as k from events where event_id % 5 <> 0")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    broken = F.when(F.col("event_id") % 5 == 0, F.lit("{broken")).otherwise(F.col("props"))
    read, _ = projections.errors_split(projections.flattened(e.withColumn("p", broken), "p", {"k": "int"}), F.col("k"))
    return read.select("event_id", "k")


@reg("m03_plan_limits", "select c_custkey, case c_custkey % 4 when 0 then 50000 when 1 then 2000000 when 2 then 10000000 end::bigint as entities from customer")
def _(spark, sf_dir):
    names = F.array(*map(F.lit, lookups.PLANS))
    return lookups.plan_limits(table(spark, sf_dir, "customer").select("c_custkey", names[(F.col("c_custkey") % 4).cast("int")].alias("plan"))).select("c_custkey", "entities")


@reg("m10_definitions", f"with {IDX} select source_name, string_agg(distinct entity_type, ',' order by entity_type) as types from idx group by all")
def _(spark, sf_dir):
    return lookups.definitions(index(spark, sf_dir)).select("source_name", F.array_join("types", ",").alias("types"))


@reg("w09_numbered_with_gaps", "with l as (select doc_id, string_split(text, '. ') as l from documents), c as (select doc_id, generate_subscripts(l, 1) - 1 as i, unnest(l) as chunk from l) select doc_id::varchar as original_entity_id, max(i)::int as last_index, count(*) as n from c where length(trim(chunk)) > 0 group by all")
def _(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("entity_id"), "text")
    c = text.exploded_chunks(d, F.split("text", "[.] ", -1))
    return c.groupBy("original_entity_id").agg(F.max("chunk_index").alias("last_index"), F.count(F.lit(1)).alias("n"))
