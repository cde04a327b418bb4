"""Sources and sinks (S1, S6-S10, S13-S15, K1, K3, K8): what is written is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import stores
from ..sources.scratch import new_folder
from .base import Register, index, table

reg = Register()


@reg("s10_stub_source")
def _(spark, sf_dir):
    stores.register(spark)
    return spark.read.format("skein_stub").option("seed", 42).option("count", 1000).load()


@reg("s02_stub_memberships", "select case when i between 1 and 9 then 'group-' || i else 'user-' || i end as member_id, case when i between 1 and 9 then 'group-' || (i - 1) else 'group-' || (i % 10) end as group_id from range(50) t(i)")
def _(spark, sf_dir):
    stores.register(spark)
    return spark.read.format("skein_stub").option("table", "memberships").option("count", 50).load().select("member_id", "group_id")


@reg("s09_incremental", "select o_orderkey from orders where o_orderkey > 1000")
def _(spark, sf_dir):
    return stores.since(table(spark, sf_dir, "orders"), "o_orderkey", 1000).select("o_orderkey")


@reg("s13_selected_nodes", "select c_custkey from customer where c_nationkey in (1, 5, 7)")
def _(spark, sf_dir):
    nodes = spark.createDataFrame([(1,), (5,), (7,)], "node_id int")
    return stores.selected(table(spark, sf_dir, "customer").withColumn("node_id", F.col("c_nationkey")), nodes).select("c_custkey")


@reg("s14_unprocessed", "select c_custkey from customer where c_custkey % 3 <> 0")
def _(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return stores.unprocessed(c, c.where("c_custkey % 3 = 0"), "c_custkey")


@reg("s06_raw_round_trip", "select doc_id::varchar as entity_id, case when doc_id % 2 = 0 then 'job10' else 'job9' end as sync_job_id, text from documents where doc_id % 5 <> 3")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    root = new_folder(spark)
    rows = docs.selectExpr("cast(doc_id as string) as entity_id", "text")
    stores.write_raw(rows.withColumn("text", F.lit("old")), root, "s1", "job8")
    stores.write_raw(rows, root, "s1", "job9")
    stores.write_raw(rows.where("entity_id % 2 = 0"), root, "s1", "job10")
    stores.delete_raw(rows.where("entity_id % 5 = 3"), root, "s1", "job11")
    target = new_folder(spark)
    stores.compact_raw(spark, root, "s1", stores.raw_schema(rows.schema), target)
    return stores.read_raw(spark, target, "s1", stores.raw_schema(rows.schema)).select("entity_id", "sync_job_id", "text")


@reg("s07_raw_entity", "select min(doc_id)::varchar as entity_id, 'job2' as sync_job_id, arg_min(text, doc_id) as text from documents")
def _(spark, sf_dir):
    root = new_folder(spark)
    rows = table(spark, sf_dir, "documents").selectExpr("cast(doc_id as string) as entity_id", "text")
    for job in ("job1", "job2"):
        stores.write_raw(rows, root, "s1", job)
    first = table(spark, sf_dir, "documents").agg(F.min("doc_id")).first()[0]
    return stores.raw_entity(spark, root, "s1", stores.raw_schema(rows.schema), str(first)).select("entity_id", "sync_job_id", "text")


@reg("s06_raw_round_trip_all", "select doc_id::varchar as entity_id, case when doc_id % 2 = 0 then 'job2' else 'job1' end as sync_job_id, text from documents")
def _(spark, sf_dir):
    return _round_trip(spark, table(spark, sf_dir, "documents"))


def _round_trip(spark, docs):
    root = new_folder(spark)
    d = docs.selectExpr("cast(doc_id as string) as entity_id", "text", "doc_id")
    stores.write_raw(d.drop("doc_id"), root, "s1", "job1")
    stores.write_raw(d.where("doc_id % 2 = 0").drop("doc_id"), root, "s1", "job2")
    return stores.read_raw(spark, root, "s1", stores.raw_schema(d.drop("doc_id").schema)).select("entity_id", "sync_job_id", "text")


@reg("k01_index_round_trip", "select lang as collection_id, doc_id || '__chunk_0' as entity_id from documents where doc_id % 7 <> 0")
def _(spark, sf_dir):
    root = new_folder(spark)
    rows = index(spark, sf_dir).withColumn("schema_name", F.lit("base_entity"))
    stores.write_index(rows, root)
    stores.delete_from_index(rows.where("doc_id % 7 = 0"), root, ["entity_id"])
    return stores.read_index(spark, root).select("collection_id", "entity_id")


@reg("k03_deleted_then_written", "select doc_id || '__chunk_0' as entity_id, case when doc_id % 21 = 0 then 'new' else 'old' end as written from documents where 'sync-' || doc_id % 10 <> 'sync-4' and (doc_id % 7 <> 0 or doc_id % 21 = 0)")
def _(spark, sf_dir):
    root, target = new_folder(spark), new_folder(spark)
    rows = index(spark, sf_dir).withColumns({"schema_name": F.lit("base_entity"), "written": F.lit("old")})
    stores.write_index(rows, root)
    stores.delete_from_index(rows.where("sync_id = 'sync-4'"), root, ["sync_id"])
    stores.delete_from_index(rows.where("doc_id % 7 = 0"), root, ["original_entity_id"])
    stores.write_index(rows.where("doc_id % 21 = 0 and sync_id <> 'sync-4'").withColumn("written", F.lit("new")), root)
    stores.compact_index(spark, root, target)
    return stores.read_index(spark, target).select("entity_id", "written")


@reg("s15_browsed_subtree", "select 'c' || c_custkey as node_id from customer join nation on c_nationkey = n_nationkey where n_regionkey = 2 union all select 'n' || n_nationkey from nation where n_regionkey = 2 union all select 'r2'")
def _(spark, sf_dir):
    return stores.subtree(tree(spark, sf_dir), spark.createDataFrame([("r2",)], "node_id string"))


def tree(spark, sf_dir):
    """Regions, nations and customers as a source's tree of nodes."""
    regions = table(spark, sf_dir, "region").selectExpr("concat('r', r_regionkey) as node_id", "cast(null as string) as parent_id", "r_name as title")
    nations = table(spark, sf_dir, "nation").selectExpr("concat('n', n_nationkey)", "concat('r', n_regionkey)", "n_name")
    return regions.union(nations).union(table(spark, sf_dir, "customer").selectExpr("concat('c', c_custkey)", "concat('n', c_nationkey)", "c_name"))


@reg("s15_parsed_nodes", "select 'site:id=' || n_nationkey || ';title=' || n_name as node_id, 'site' as node_type, n_nationkey::varchar as id, n_name as title from nation")
def _(spark, sf_dir):
    nodes = table(spark, sf_dir, "nation").select(F.concat(F.lit("site:id="), "n_nationkey", F.lit(";title="), "n_name").alias("node_id"))
    return stores.parsed_nodes(nodes).select("node_id", "node_type", F.col("node_metadata")["id"].alias("id"), F.col("node_metadata")["title"].alias("title"))
