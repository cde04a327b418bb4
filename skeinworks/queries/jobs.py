"""Analytics over jobs, connections, organisations and usage (W1-W6, A2-A8, A19-A23, J9-J15, M1-M9, ST13, ST16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lookups, metadata
from ..operators import rows as projections
from ..sources import stores
from .base import IDX, JOBS, Register, index, jobs, table

reg = Register()
_LATEST = f"{JOBS}, latest as (select * from jobs qualify row_number() over (partition by sync_id order by created_at desc, job_id desc) = 1)"


@reg("w01_latest_job", f"with {_LATEST} select sync_id, job_id, status from latest")
def _(spark, sf_dir):
    return metadata.latest(jobs(spark, sf_dir)).select("sync_id", "job_id", "status")


@reg("w03_latest_status_filter", f"with {_LATEST} select sync_id from latest where status = 'failed'")
def _(spark, sf_dir):
    return metadata.latest(jobs(spark, sf_dir)).where("status = 'failed'").select("sync_id")


@reg("w04_newest_jobs", f"with {JOBS} select sync_id, job_id, rn::int as rn from (select sync_id, job_id, row_number() over (partition by sync_id order by created_at desc, job_id desc) as rn from jobs where status in ('completed', 'failed')) where rn <= 3")
def _(spark, sf_dir):
    done = jobs(spark, sf_dir).where(~F.col("status").isin(metadata.UNFINISHED))
    return metadata.newest(done, 3).select("sync_id", "job_id", "rn")


@reg("a07_ghost_syncs", f"with {JOBS}, r as (select sync_id, status, row_number() over (partition by sync_id order by created_at desc, job_id desc) as rn from jobs where status in ('completed', 'failed')) select sync_id, count(*) as n_failed from r where rn <= 2 group by sync_id having count(*) >= 2 and count(*) filter (status = 'failed') = count(*)")
def _(spark, sf_dir):
    return metadata.ghosts(jobs(spark, sf_dir), 2)


@reg("m08_jobs_of_sync", f"with {JOBS} select job_id, status from jobs where sync_id = (select min(user_id) from events) and status in ('running', 'pending', 'cancelling') order by created_at desc, job_id desc limit 5")
def _(spark, sf_dir):
    j = jobs(spark, sf_dir)
    first = j.agg(F.min("sync_id")).first()[0]
    return metadata.jobs_of(j, first, metadata.ACTIVE, 5).select("job_id", "status")


@reg("st13_stuck_jobs", f"with {JOBS}, t as (select max(ts) as now from events), a as (select event_id - 1 as job_id, max(ts) as seen from events where event_id % 3 = 0 group by all) select job_id, status from jobs left join a using (job_id), t where (status = 'pending' and epoch(now) - epoch(created_at) > 180) or (status = 'running' and epoch(now) - epoch(coalesce(seen, created_at)) > 900)")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts")).first()[0]
    activity = e.where("event_id % 3 = 0").select((F.col("event_id") - 1).alias("job_id"), F.col("ts").alias("created_at"))
    return metadata.stuck(jobs(spark, sf_dir), activity, F.lit(now)).select("job_id", "status")


@reg("w06_delivery_health", """with d as (select user_id as endpoint, event_id, ts, case when event_id % 5 < 3 then 200 else 500 end as code from events), r as (select *, sum((code between 200 and 299)::int) over (partition by endpoint order by ts desc, event_id desc) as ok from d),
h as (select endpoint, count_if(ok = 0) as n, bool_and(code between 200 and 299) as good from r group by endpoint) select endpoint, n as n_leading, case when n >= 3 then 'failing' when good then 'healthy' else 'degraded' end as health from h""")
def _(spark, sf_dir):
    d = table(spark, sf_dir, "events").selectExpr("user_id as endpoint", "event_id as delivery_id", "ts as at", "if(event_id % 5 < 3, 200, 500) as code")
    return metadata.health(d)


@reg("m01_connection_status", """with c as (select c_custkey, c_custkey % 5 <> 0 as a, c_custkey % 7 <> 0 as i, case c_custkey % 4 when 0 then 'running' when 1 then 'failed' when 2 then 'completed' end as j, case when c_custkey % 3 = 0 then 'auth' end as e from customer)
select c_custkey, case when not a then 'pending_auth' when not i then 'inactive' when j = 'running' then 'syncing' when j = 'failed' and e = 'auth' then 'needs_reauth' when j = 'failed' then 'error' else 'active' end as status from c""")
def _(spark, sf_dir):
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_custkey % 5 <> 0 as authenticated", "c_custkey % 7 <> 0 as is_active", "case c_custkey % 4 when 0 then 'running' when 1 then 'failed' when 2 then 'completed' end as job_status", "if(c_custkey % 3 = 0, 'auth', null) as error_category")
    return c.select("c_custkey", metadata.connection_status().alias("status"))


@reg("a04_connections_by_status", "select c_mktsegment as status, count(*) as n from customer group by all")
def _(spark, sf_dir):
    return lookups.counts(table(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "status"), ["status"])


@reg("a21_collection_status", "with c as (select n_nationkey as collection_id, c_custkey % 3 <> 0 and n_regionkey <> 1 as a, coalesce(n_regionkey = 2 or c_custkey % 2 = 0, false) as f from nation left join customer on c_nationkey = n_nationkey) select collection_id, case when count_if(a) = 0 then 'NEEDS SOURCE' when count_if(a) = count_if(a and f) then 'ERROR' else 'ACTIVE' end as status from c group by all")
def _(spark, sf_dir):
    c = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    rows = c.selectExpr("n_nationkey as collection_id", "c_custkey % 3 <> 0 and n_regionkey <> 1 as authenticated", "if(n_regionkey = 2 or c_custkey % 2 = 0, 'failed', 'completed') as job_status")
    return metadata.collection_status(rows)


@reg("j09_organisations", """with u as (select c_nationkey as org_id, count(*) as n_users, max(c_acctbal) as last_active from customer group by all), s as (select s_nationkey as org_id, count(*) as n_connections from supplier group by all),
e as (select c_nationkey as org_id, count(*) as n_entities from orders join customer on o_custkey = c_custkey group by all)
select n_nationkey as org_id, n_name as name, coalesce(n_users, 0) as n_users, round(last_active, 4) as last_active, coalesce(n_connections, 0) as n_connections, coalesce(n_entities, 0) as n_entities from nation left join u on org_id = n_nationkey left join s on s.org_id = n_nationkey left join e on e.org_id = n_nationkey where contains(lower(n_name), 'a')""")
def _(spark, sf_dir):
    orgs = table(spark, sf_dir, "nation").selectExpr("n_nationkey as org_id", "n_name as name")
    people = table(spark, sf_dir, "customer").selectExpr("c_nationkey as org_id", "c_acctbal as last_active", "c_custkey")
    links = table(spark, sf_dir, "supplier").selectExpr("s_nationkey as org_id")
    used = table(spark, sf_dir, "orders").join(people, F.col("o_custkey") == F.col("c_custkey")).groupBy("org_id").agg(F.count(F.lit(1)).alias("entities"))
    return metadata.organisations(orgs, people, links, used, "A", "entity_count").withColumn("last_active", F.round("last_active", 4))


@reg("j09_organisations_billed", """with p as (select c_nationkey as org_id, o_orderkey as period_id, o_orderdate as s, case o_orderstatus when 'O' then 'active' when 'P' then 'trial' else 'ended' end as status from orders join customer on o_custkey = c_custkey),
h as (select org_id, arg_max(period_id, (s, period_id)) as period_id from p where s <= timestamp '1997-06-01' and s + interval 40 day > timestamp '1997-06-01' and status in ('active', 'trial', 'grace') group by org_id),
u as (select l_orderkey as period_id, sum(l_quantity)::bigint as entities from lineitem group by all)
select n_nationkey as org_id, period_id, entities from nation left join h on org_id = n_nationkey left join u using (period_id)""")
def _(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    status = F.expr("case o_orderstatus when 'O' then 'active' when 'P' then 'trial' else 'ended' end")
    periods = orders.select(F.col("c_nationkey").alias("org_id"), F.col("o_orderkey").alias("period_id"), F.col("o_orderdate").alias("period_start"), F.expr("o_orderdate + interval 40 days").alias("period_end"), status.alias("status"))
    used = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("period_id")).agg(F.sum("l_quantity").cast("long").alias("entities"))
    at = F.lit("1997-06-01").cast(periods.schema["period_start"].dataType)
    orgs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("org_id"))
    return metadata.organisations_by_usage(orgs, periods, used, at).select("org_id", "period_id", "entities")


@reg("j10c_period_at", "with p as (select o_custkey as k, o_orderkey as period_id, o_orderdate as s, o_orderdate + interval 200 day as e from orders), r as (select c_custkey as k, timestamp '1996-06-01' as t from customer) select k, period_id from (select k, period_id, row_number() over (partition by k order by s desc, period_id desc) as n from r join p using (k) where s <= t and e > t) where n = 1")
def _(spark, sf_dir):
    periods = table(spark, sf_dir, "orders").selectExpr("o_custkey as k", "o_orderkey as period_id", "o_orderdate as period_start", "o_orderdate + interval 200 days as period_end")
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey as k", "timestamp_ntz '1996-06-01' as at" if dict(periods.dtypes)["period_start"] == "timestamp_ntz" else "timestamp '1996-06-01' as at")
    return metadata.period_at(rows, periods, "at", "k").select("k", "period_id")


@reg("j13_in_subquery", "select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 300000)")
def _(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return lookups.having(table(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey", F.col("o_totalprice") > 300000)


@reg("j14_without_connection", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 250000)")
def _(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_totalprice > 250000").withColumnRenamed("o_custkey", "c_custkey")
    return lookups.lacking(table(spark, sf_dir, "customer").select("c_custkey"), o, "c_custkey")


@reg("j15_type_counts", "select n_name as entity_type, coalesce(n, 0)::bigint as n from nation left join (select s_nationkey, count(*) as n from supplier group by all) on s_nationkey = n_nationkey")
def _(spark, sf_dir):
    n = lookups.counts(table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "n_nationkey"), ["n_nationkey"])
    return lookups.type_counts(table(spark, sf_dir, "nation"), n, "n_nationkey").select(F.col("n_name").alias("entity_type"), "n")


@reg("a02_entities_per_sync", f"with {IDX} select sync_id, count(*) as n, max(created_at) as last_at from idx group by all")
def _(spark, sf_dir):
    return lookups.counts(index(spark, sf_dir), ["sync_id"], "created_at")


@reg("a03_counts_per_type", f"with {IDX} select sync_id, entity_type, count(*) as n, regexp_replace(entity_type, 'Entity$', '') as display_name from idx group by all")
def _(spark, sf_dir):
    return lookups.counts_by_type(index(spark, sf_dir))


@reg("a08_tags", "select user_id as sync_id, array_to_string(list_sort(list_distinct(list(event_type))), ',') as tags from events group by all")
def _(spark, sf_dir):
    t = metadata.tags(table(spark, sf_dir, "events").select(F.col("user_id").alias("sync_id"), F.array("event_type").alias("tags")))
    return t.select("sync_id", F.array_join("tags", ",").alias("tags"))


@reg("a19_usage", "select user_id, count(*) as n, round(sum(value), 4) as total, (count(*) // greatest(datediff('day', min(ts), max(ts)), 1))::bigint as per_day from events group by all")
def _(spark, sf_dir):
    return lookups.usage(table(spark, sf_dir, "events"), "user_id", "ts", "value").withColumn("total", F.round("total", 4))


@reg("a20_trend", "with m as (select date_trunc('month', o_orderdate) as m, count(*) as n from orders group by all), l as (select m, n, lag(n) over (order by m) as p from m), q as (select m, n, case when coalesce(p, 0) = 0 then case when n > 0 then 100.0 else 0.0 end else round((n - p) / p * 100, 1) end as percent from l) select strftime(m, '%Y-%m') as month, n, percent, case when percent > 5 then 'up' when percent < -5 then 'down' else 'stable' end as direction from q")
def _(spark, sf_dir):
    from pyspark.sql import Window

    m = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(F.lit(0)).orderBy("month")  # one row per month
    direction, percent = metadata.trend(F.col("n"), F.lag("n").over(w))
    return m.withColumns({"percent": percent}).withColumn("direction", F.when(F.col("percent") > 5, "up").when(F.col("percent") < -5, "down").otherwise("stable"))


@reg("m02_usage_allowed", "select c_custkey, case when c_custkey % 9 = 0 then false when c_custkey % 4 = 0 then true else c_custkey % 100 + 10 <= 60 end as allowed from customer")
def _(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    limit, status = F.when(F.col("c_custkey") % 4 != 0, F.lit(60)), F.when(F.col("c_custkey") % 9 == 0, "cancelled").otherwise("active")
    return c.select("c_custkey", metadata.usage_allowed(F.col("c_custkey") % 100, F.lit(10), limit, status).alias("allowed"))


@reg("m04_normalized_tokens", "select event_id, trunc(event_id * 0.25 + user_id * 1.5)::bigint as n from events")
def _(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", metadata.normalized_tokens(F.col("event_id"), F.col("user_id"), 0.25, 1.5).alias("n"))


@reg("m05_layered_config", "select c_custkey, case when c_custkey % 3 = 0 then 'job' when c_custkey % 2 = 0 then 'sync' else 'collection' end as a, 'collection' as b from customer")
def _(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    one = F.create_map(F.lit("a"), F.lit("collection"), F.lit("b"), F.lit("collection"))
    two = F.create_map(F.lit("a"), F.when(F.col("c_custkey") % 2 == 0, "sync"), F.lit("b"), F.lit(None).cast("string"))
    three = F.create_map(F.lit("a"), F.when(F.col("c_custkey") % 3 == 0, "job"))
    out = metadata.layered(one, two, three)
    return c.select("c_custkey", out["a"].alias("a"), out["b"].alias("b"))


@reg("m07_search_history", "select event_id from events where user_id = (select min(user_id) from events) order by ts desc, event_id desc limit 10")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return lookups.search_history(e, "user_id", e.agg(F.min("user_id")).first()[0], 10).select("event_id")


@reg("m06_props_flattened", "select event_id, (props->>'$.k')::int as k from events")
def _(spark, sf_dir):
    return projections.flattened(table(spark, sf_dir, "events"), "props", {"k": "int"}).select("event_id", "k")


@reg("k09_manifest", f"with {JOBS} select sync_id, string_agg(job_id, ',' order by created_at, job_id) as sync_jobs from jobs group by all")
def _(spark, sf_dir):
    return stores.manifest(jobs(spark, sf_dir)).select("sync_id", F.array_join("sync_jobs", ",").alias("sync_jobs"))


@reg("st16_bad_transitions", f"with {JOBS}, s as (select job_id, sync_id, status, lag(status) over (partition by sync_id order by created_at, job_id) as before from jobs) select job_id, before, status from s where before is not null and not ((before = 'pending' and status in ('running', 'failed')) or (before = 'running' and status in ('completed', 'failed')))")
def _(spark, sf_dir):
    h = jobs(spark, sf_dir).select(F.col("sync_id").alias("job_id"), F.col("job_id").alias("step_id"), "status", F.col("created_at").alias("at"))
    return metadata.bad_transitions(h).select(F.col("step_id").alias("job_id"), "before", "status")


@reg("a22_collections_like", f"with {IDX} select count(*) as n from (select distinct source_name from idx) where lower(source_name) like '%rc1%'")
def _(spark, sf_dir):
    return lookups.matching_collections(index(spark, sf_dir), "source_name", "RC1")


@reg("a23_syncs_per_collection", f"with {IDX} select distinct collection_id, sync_id from idx")
def _(spark, sf_dir):
    return lookups.distinct_pairs(index(spark, sf_dir), "collection_id", "sync_id")
