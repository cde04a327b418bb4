"""Change capture over two snapshots of `documents` (A1, A10-A16, C19, J1-J4, K6-K11, P11, ST5, ST6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cdc, counts, lookups
from ..plans import sync
from ..sources.scratch import new_folder, stored
from ..streaming import pipelines
from .base import Register, index, stream, table

reg = Register()


def old_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("doc_id % 10 <> 0")
    return d.selectExpr("'s1' as sync_id", "cast(doc_id as string) as entity_id", "source as entity_type", "concat('Doc ', doc_id) as name", "if(doc_id % 7 = 0, concat(text, ' old'), text) as text", "'2024-01-01' as created_at", "doc_id as seq")


def new_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a run; every 13th comes twice, every 19th is reported as removed."""
    d = table(spark, sf_dir, "documents").where("doc_id % 11 <> 0")
    rows = d.selectExpr("'s1' as sync_id", "cast(doc_id as string) as entity_id", "source as entity_type", "concat('Doc ', doc_id) as name", "text", "'2024-02-01' as created_at", "doc_id as seq", "if(doc_id % 19 = 0, 'removed', null) as deletion_status", "doc_id")
    again = rows.where("doc_id % 13 = 0").withColumns({"text": F.concat("text", F.lit(" twin")), "seq": F.col("seq") + 1_000_000_000})
    return rows.unionByName(again).drop("doc_id")


_H2 = "sha256('entity_id:' || length(entity_id) || ':' || entity_id || '|entity_type:' || length(entity_type) || ':' || entity_type || '|name:' || length(name) || ':' || name || '|sync_id:2:s1|text:' || length(text) || ':' || text)"
BOTH = f"""old0 as (select doc_id::varchar as entity_id, source as entity_type, 'Doc ' || doc_id as name, case when doc_id % 7 = 0 then text || ' old' else text end as text, '2024-01-01' as created_at, doc_id as seq from documents where doc_id % 10 <> 0),
old as (select *, {_H2} as hash from old0),
new0 as (select doc_id::varchar as entity_id, source as entity_type, 'Doc ' || doc_id as name, text, '2024-02-01' as created_at, doc_id as seq, doc_id % 19 = 0 as gone from documents where doc_id % 11 <> 0),
new as (select *, {_H2} as hash from new0),
chg as (select new.*, case when gone then 'DELETE' when old.entity_id is null then 'INSERT' when old.hash <> new.hash then 'UPDATE' else 'KEEP' end as action from new left join old using (entity_id, entity_type))"""


def _hashed(rows: DataFrame) -> DataFrame:
    return cdc.hashed(rows, ["created_at"])


def _changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    old = _hashed(old_rows(spark, sf_dir))
    new = _hashed(cdc.keep_first(new_rows(spark, sf_dir), ["entity_type", "entity_id"], ["seq"]))
    return old, cdc.classified(new, old)


@reg("c19_content_hash", f"with {BOTH} select entity_id, hash from new")
def _(spark, sf_dir):
    return _hashed(cdc.keep_first(new_rows(spark, sf_dir), ["entity_type", "entity_id"], ["seq"])).select("entity_id", "hash")


@reg("a12_keep_first", "select doc_id::varchar as entity_id, text from documents where doc_id % 11 <> 0")
def _(spark, sf_dir):
    return cdc.keep_first(new_rows(spark, sf_dir), ["entity_type", "entity_id"], ["seq"]).select("entity_id", "text")


@reg("a13_keep_last", "select doc_id::varchar as entity_id, case when doc_id % 13 = 0 then text || ' twin' else text end as text, doc_id as seq from documents where doc_id % 11 <> 0")
def _(spark, sf_dir):
    return cdc.keep_last(new_rows(spark, sf_dir).select("entity_id", "text", "seq"), ["entity_id"], "seq")


@reg("st5_classified", f"with {BOTH} select entity_id, action from chg")
def _(spark, sf_dir):
    return _changes(spark, sf_dir)[1].select("entity_id", "action")


@reg("st6_force_inserts", f"with {BOTH} select entity_id, case when gone then 'DELETE' else 'INSERT' end as action from new")
def _(spark, sf_dir):
    old = _hashed(old_rows(spark, sf_dir))
    new = _hashed(cdc.keep_first(new_rows(spark, sf_dir), ["entity_type", "entity_id"], ["seq"]))
    return cdc.classified(new, old, force=True).select("entity_id", "action")


@reg("p11_deletions", "select count_if(doc_id % 19 <> 0) as kept, count_if(doc_id % 19 = 0) as removed from documents where doc_id % 11 <> 0")
def _(spark, sf_dir):
    kept, gone = cdc.split_deletions(cdc.keep_first(new_rows(spark, sf_dir), ["entity_type", "entity_id"], ["seq"]))
    return kept.agg(F.count(F.lit(1)).alias("kept")).crossJoin(gone.agg(F.count(F.lit(1)).alias("removed")))


@reg("j02_orphans", f"with {BOTH} select entity_id, entity_type from old where entity_id not in (select entity_id from new)")
def _(spark, sf_dir):
    old, new = _changes(spark, sf_dir)
    return cdc.orphans(old, new).select("entity_id", "entity_type")


_AFTER = """select coalesce(new.entity_id, old.entity_id) as entity_id, coalesce(new.hash, old.hash) as hash, coalesce(old.created_at, new.created_at) as created_at
from old full join (select * from new where not gone) new using (entity_id, entity_type) where coalesce(new.entity_id, old.entity_id) not in (select entity_id from new where gone)"""


@reg("k06_upserted", f"with {BOTH} {_AFTER}")
def _(spark, sf_dir):
    old, new = _changes(spark, sf_dir)
    state = old.select("sync_id", "entity_id", "entity_type", "hash", "created_at")
    return cdc.upserted(state, new, cdc.KEYS).select("entity_id", "hash", "created_at")


@reg("k07_hash_updated", f"with {BOTH} select entity_id, coalesce(n.hash, old.hash) as hash from old left join (select entity_id, hash from new where entity_id like '1%') n using (entity_id)")
def _(spark, sf_dir):
    old, new = _changes(spark, sf_dir)
    return cdc.hash_updated(old.select("entity_id", "hash"), new.where("entity_id like '1%'"), ["entity_id"])


@reg("k04_without_parents", "select doc_id || '__chunk_0' as entity_id from documents where not (lang = 'en' and doc_id % 3 = 1)")
def _(spark, sf_dir):
    rows = index(spark, sf_dir)
    gone = rows.where("collection_id = 'en' and doc_id % 3 = 1")
    return cdc.without_parents(rows, gone).select("entity_id")


@reg("a01_entity_counts", "select 'sync-' || doc_id % 10 as sync_id, case when doc_id % 3 = 0 then 'WebPageEntity' else 'DocumentEntity' end as entity_type, count(*) as n from documents group by all")
def _(spark, sf_dir):
    return cdc.counts(index(spark, sf_dir))


@reg("a01_counts_after_deltas", """with c as (select doc_id % 10 as s, source as t, count(*) as n from documents where doc_id % 4 = 3 group by all),
d as (select doc_id % 10 as s, source as t, doc_id * 2 + o as seq, case when doc_id % 3 = 0 then -1 else 1 end as delta from documents, (values (0), (1)) v(o) where o = 0 or doc_id % 3 = 0),
l as (select s, t, list(delta order by seq) as steps from d where t is not null group by all)
select 'sync-' || s as sync_id, t as entity_type, list_reduce([coalesce(n, 0)::bigint] || coalesce(steps, []), lambda x, y: greatest(x + y, 0)) as n
from (select * from c where t is not null) c full join l using (s, t) where list_reduce([coalesce(n, 0)::bigint] || coalesce(steps, []), lambda x, y: greatest(x + y, 0)) > 0""")
def _(spark, sf_dir):
    """Every step is clipped: a third of the documents take two, the others add one, in order of their ids, whatever the order of arrival."""
    rows = index(spark, sf_dir).withColumn("entity_type", F.col("source_name"))
    times = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    steps = rows.select("sync_id", "entity_type", "doc_id", F.explode(times).alias("o")).repartition(7, "doc_id")
    deltas = steps.select("sync_id", "entity_type", (F.col("doc_id") * 2 + F.col("o")).alias("seq"), F.when(F.col("doc_id") % 3 == 0, -1).otherwise(1).cast("long").alias("delta"))
    return counts.counts_after(cdc.counts(rows.where("doc_id % 4 = 3")), deltas)


@reg("a01_counts_of_moves", """with h as (select doc_id, 'INSERT' as op, doc_id % 10 as s, source as t, null as os, null as ot, 0 as k from documents union all select doc_id, 'UPDATE', (doc_id + 1) % 10, case when doc_id % 5 = 0 then null else lang end, doc_id % 10, source, 1 from documents where doc_id % 2 = 0
union all select doc_id, 'DELETE', null, null, (doc_id + 1) % 10, lang, 2 from documents where doc_id % 6 = 0),
d as (select s, t, doc_id * 4 + k as seq, 1 as delta from h where op = 'INSERT' and t is not null union all select os, ot, doc_id * 4 + k, -1 from h where op = 'DELETE' and ot is not null
union all select os, ot, doc_id * 4 + k, -1 from h where op = 'UPDATE' and t is not null and ot is not null and (s <> os or t <> ot) union all select s, t, doc_id * 4 + k, 1 from h where op = 'UPDATE' and t is not null and ot is not null and (s <> os or t <> ot)),
l as (select s, t, list(delta order by seq, delta) as steps from d group by all)
select s::bigint as sync_id, t as entity_type, list_reduce([0::bigint] || steps, lambda x, y: greatest(x + y, 0)) as n from l where list_reduce([0::bigint] || steps, lambda x, y: greatest(x + y, 0)) > 0""")
def _(spark, sf_dir):
    """Inserts, updates that move a row to another sync and type, and deletions, as a trigger on the table would count them."""
    d = table(spark, sf_dir, "documents")
    inserts = d.selectExpr("'INSERT' as op", "doc_id % 10 as sync_id", "source as entity_type", "cast(null as bigint) as old_sync_id", "cast(null as string) as old_entity_type", "doc_id * 4 as seq")
    moves = d.where("doc_id % 2 = 0").selectExpr("'UPDATE' as op", "(doc_id + 1) % 10 as sync_id", "if(doc_id % 5 = 0, null, lang) as entity_type", "doc_id % 10 as old_sync_id", "source as old_entity_type", "doc_id * 4 + 1 as seq")
    gone = d.where("doc_id % 6 = 0").selectExpr("'DELETE' as op", "cast(null as bigint) as sync_id", "cast(null as string) as entity_type", "(doc_id + 1) % 10 as old_sync_id", "lang as old_entity_type", "doc_id * 4 + 2 as seq")
    none = spark.createDataFrame([], "sync_id bigint, entity_type string, n bigint")
    return counts.counts_after(none, counts.steps_of(inserts.unionByName(moves).unionByName(gone)))


@reg("a10_action_counts", f"with {BOTH} select entity_type, count_if(action = 'INSERT') as insert, count_if(action = 'UPDATE') as update, count_if(action = 'KEEP') as keep, count_if(action = 'DELETE') as delete from chg group by entity_type")
def _(spark, sf_dir):
    return cdc.action_counts(_changes(spark, sf_dir)[1])


@reg("a11_job_counters", f"with {BOTH} select action, count(*) as n from chg group by action")
def _(spark, sf_dir):
    return _changes(spark, sf_dir)[1].groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@reg("k11_memberships", "select 'c' || c_custkey as member_id, 'user' as member_type, 'n' || c_nationkey as group_id from customer where c_custkey % 5 <> 0 and c_nationkey <> 3 union select 'x' || c_custkey, 'user', 'n3' from customer where c_custkey % 50 = 0")
def _(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    state = c.selectExpr("concat('c', c_custkey) as member_id", "'user' as member_type", "concat('n', c_nationkey) as group_id")
    gone = c.where("c_custkey % 5 = 0").selectExpr("concat('c', c_custkey) as member_id", "'user' as member_type", "concat('n', c_nationkey) as group_id", "'REMOVE' as op", "1L as seq")
    group = spark.range(1).selectExpr("cast(null as string) as member_id", "'group' as member_type", "'n3' as group_id", "'REMOVE_GROUP' as op", "2L as seq")
    back = c.where("c_custkey % 50 = 0").selectExpr("concat('x', c_custkey) as member_id", "'user' as member_type", "'n3' as group_id", "'ADD' as op", "3L as seq")
    return cdc.memberships_after(state, gone.unionByName(group).unionByName(back))


@reg("j04_membership_orphans", "select c_custkey as member_id from customer where c_custkey % 4 = 0")
def _(spark, sf_dir):
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey as member_id", "'user' as member_type", "c_nationkey as group_id")
    return lookups.stale(c, c.where("member_id % 4 <> 0"), ["member_id", "member_type", "group_id"]).select("member_id")


@reg("a16_membership_dedup", "select distinct o_custkey as member_id, o_orderstatus as group_id from orders")
def _(spark, sf_dir):
    return lookups.distinct_pairs(table(spark, sf_dir, "orders").selectExpr("o_custkey as member_id", "o_orderstatus as group_id"), "member_id", "group_id")


def _applied(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list]:
    """What a stream of the new rows, in batches, gives against the stored state, and the cursors that it saved."""
    out, saved = new_folder(spark), []
    state = stored(_hashed(old_rows(spark, sf_dir)).select(*cdc.KEYS, "hash"))
    rows = stream(spark, sf_dir, "documents").where("doc_id % 11 <> 0").selectExpr("'s1' as sync_id", "cast(doc_id as string) as entity_id", "source as entity_type", "concat('Doc ', doc_id) as name", "text", "doc_id as seq", "if(doc_id % 19 = 0, 'removed', null) as deletion_status")

    def write(batch: DataFrame, number: int) -> None:
        batch.select("entity_id", "action").write.mode("overwrite").parquet(f"{out}/batch={number}")

    pipelines.apply_changes(rows, lambda: state, write, new_folder(spark), cdc.KEYS, saved.append).awaitTermination()
    return spark.read.schema("entity_id string, action string").parquet(f"{out}/*"), saved


@reg("st07_stream_of_changes", f"with {BOTH} select entity_id, action from chg")
def _(spark, sf_dir):
    return _applied(spark, sf_dir)[0]


@reg("st08_cursor", "select max(doc_id) as cursor from documents where doc_id % 11 <> 0")
def _(spark, sf_dir):
    return spark.range(1).select(F.lit(_applied(spark, sf_dir)[1][-1]).cast("long").alias("cursor"))


#: Three syncs that share entity ids: the second sees a third of the documents and loses some, the third does not run.
_OF_OLD = {"s1": "true", "s2": "doc_id % 3 = 0", "s3": "doc_id % 2 = 0"}
_OF_NEW = {"s1": "true", "s2": "doc_id % 3 <> 1 and doc_id % 5 <> 0"}


def _several(rows: DataFrame, shares: dict[str, str]) -> DataFrame:
    """rows, once for each sync that has them."""
    doc_id = F.col("entity_id").cast("long")
    mine = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(s)) for s, c in shares.items()]))
    return rows.drop("sync_id").withColumn("doc_id", doc_id).withColumn("sync_id", F.explode(mine)).drop("doc_id")


_H3 = _H2.replace("|sync_id:2:s1|", "|sync_id:2:' || sync_id || '|")
_VALUES = {k: ", ".join(f"('{s}')" for s in x) for k, x in (("old", _OF_OLD), ("new", _OF_NEW))}
_WHERE = {k: " or ".join(f"sync_id = '{s}' and {c}" for s, c in x.items()) for k, x in (("old", _OF_OLD), ("new", _OF_NEW))}
SEVERAL = f"""old0 as (select sync_id, doc_id::varchar as entity_id, source as entity_type, 'Doc ' || doc_id as name, case when doc_id % 7 = 0 then text || ' old' else text end as text from documents, (values {_VALUES["old"]}) v(sync_id) where doc_id % 10 <> 0 and ({_WHERE["old"]})),
old as (select *, {_H3} as hash from old0),
new0 as (select sync_id, doc_id::varchar as entity_id, source as entity_type, 'Doc ' || doc_id as name, text, doc_id % 19 = 0 as gone from documents, (values {_VALUES["new"]}) v(sync_id) where doc_id % 11 <> 0 and ({_WHERE["new"]})),
new as (select *, {_H3} as hash from new0),
chg as (select new.*, case when gone then 'DELETE' when old.entity_id is null then 'INSERT' when old.hash <> new.hash then 'UPDATE' else 'KEEP' end as action from new left join old using (sync_id, entity_id, entity_type)),
orphan as (select * from old where sync_id <> 's3' and (sync_id, entity_id) not in (select (sync_id, entity_id) from new))"""


@reg("j02_orphans_of_syncs", f"with {SEVERAL} select sync_id, entity_id, entity_type from orphan")
def _(spark, sf_dir):
    old, new = _several(old_rows(spark, sf_dir), _OF_OLD), _several(new_rows(spark, sf_dir), _OF_NEW)
    return cdc.orphans(old, new).select("sync_id", "entity_id", "entity_type")


@reg("sync_state_after", f"with {SEVERAL} select sync_id, entity_id, entity_type, hash from new where not gone union all select sync_id, entity_id, entity_type, hash from old where sync_id = 's3'")
def _(spark, sf_dir):
    return _synced(spark, sf_dir).state.select("sync_id", "entity_id", "entity_type", "hash")


@reg("sync_index_after", f"with {SEVERAL} select sync_id, entity_id as original_entity_id, case when action = 'KEEP' then 'old' else 'new' end as written from chg where action <> 'DELETE' and length(trim(text)) > 0 and len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) > 0 union all select sync_id, entity_id, 'old' from old where sync_id = 's3'")
def _(spark, sf_dir):
    """Parents in the index after a run: kept ones with their old chunk, new and updated ones with theirs."""
    found = _synced(spark, sf_dir).index
    return found.groupBy("sync_id", "original_entity_id").agg(F.max(F.when(F.col("textual_representation") == "old chunk", "old").otherwise("new")).alias("written"))


def _synced(spark: SparkSession, sf_dir: str) -> sync.SyncResult:
    old = _hashed(_several(old_rows(spark, sf_dir), _OF_OLD)).drop("created_at")
    before = old.select("sync_id", F.concat("entity_id", F.lit("__chunk_0")).alias("entity_id"), F.col("entity_id").alias("original_entity_id"), "entity_type", "name", F.lit(0).alias("chunk_index"), F.lit("old chunk").alias("textual_representation"))
    new = _several(new_rows(spark, sf_dir), _OF_NEW).drop("created_at")
    return sync.run(new, old.select("sync_id", "entity_id", "entity_type", "hash"), before)


@reg("sync_run", f"with {SEVERAL} select sync_id, entity_id, action from chg union all select sync_id, entity_id, 'ORPHAN' from orphan")
def _(spark, sf_dir):
    found = _synced(spark, sf_dir)
    return found.changes.select("sync_id", "entity_id", "action").unionByName(found.orphans.select("sync_id", "entity_id", F.lit("ORPHAN").alias("action")))
