"""Analytics over syncs, jobs, connections, usage and organisations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACTIVE = ["pending", "running", "cancelling"]
#: States that do not count among a sync's last jobs; one that is being cancelled does.
UNFINISHED = ["pending", "running"]
#: Ways to sort the organisation list.
SORTS = {"name": "name", "created_at": "created_at", "user_count": "n_users", "entity_count": "n_entities", "last_active": "last_active"}


def latest(jobs: DataFrame, key: str = "sync_id", order: str = "created_at", tie: str = "job_id") -> DataFrame:
    """The newest job of each sync: an aggregate, so one row per key and task is moved, not a sort of all jobs."""
    rest = [c for c in jobs.columns if c != key]
    return jobs.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order, tie)).alias("_r")).select(key, "_r.*")


def newest(jobs: DataFrame, n: int, key: str = "sync_id") -> DataFrame:
    """The newest n jobs of each key."""
    w = Window.partitionBy(key).orderBy(F.desc("created_at"), F.desc("job_id"))
    return jobs.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def ghosts(jobs: DataFrame, n: int) -> DataFrame:
    """Syncs whose newest n jobs, but for pending and running ones, all failed."""
    done = newest(jobs.where(~F.col("status").isin(UNFINISHED)), n)
    counted = done.groupBy("sync_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "failed").alias("failed"))
    return counted.where((F.col("n") >= n) & (F.col("n") == F.col("failed"))).select("sync_id", F.col("n").alias("n_failed"))


def jobs_of(jobs: DataFrame, sync_id, statuses: list[str] | None = None, limit: int = 100) -> DataFrame:
    out = jobs.where(F.col("sync_id") == sync_id)
    if statuses:
        out = out.where(F.col("status").isin(statuses))
    return out.orderBy(F.desc("created_at"), F.desc("job_id")).limit(limit)


def stuck(jobs: DataFrame, activity: DataFrame, now: Column) -> DataFrame:
    """Jobs cancelling or pending over 3 minutes, or running over 15 without newer activity; jobs that only fill the raw
    store (`raw_only`, if there is such a column) may run as long as they like."""
    last = activity.groupBy("job_id").agg(F.max("created_at").alias("last_at"))
    old = jobs.join(last, "job_id", "left")
    minutes = lambda t: (F.unix_timestamp(now) - F.unix_timestamp(t)) / 60
    waiting = F.col("status").isin("cancelling", "pending") & (minutes(F.col("created_at")) > 3)
    idle = (F.col("status") == "running") & (minutes(F.coalesce("last_at", "created_at")) > 15)
    if "raw_only" in jobs.columns:
        idle = idle & ~F.coalesce("raw_only", F.lit(False))
    return old.where(waiting | idle)


def health(deliveries: DataFrame, threshold: int = 3, endpoints: DataFrame | None = None) -> DataFrame:
    """Status per endpoint from its deliveries, newest first: failing, healthy or degraded; unknown for one of `endpoints`
    without deliveries."""
    w = Window.partitionBy("endpoint").orderBy(F.desc("at"), F.desc("delivery_id")).rowsBetween(Window.unboundedPreceding, 0)
    run = deliveries.withColumn("ok", F.col("code").between(200, 299)).withColumn("_ok", F.sum(F.col("ok").cast("int")).over(w))
    found = run.groupBy("endpoint").agg(F.count_if(F.col("_ok") == 0).alias("n_leading"), F.every("ok").alias("all_ok"))
    if endpoints is not None:
        found = endpoints.select("endpoint").distinct().join(found, "endpoint", "left").fillna(0, ["n_leading"])
    state = F.when(F.col("all_ok").isNull(), "unknown").when(F.col("n_leading") >= threshold, "failing").when(F.col("all_ok"), "healthy").otherwise("degraded")
    return found.select("endpoint", "n_leading", state.alias("health"))


def connection_status(listed: bool = False) -> Column:
    """Status of a connection row (authenticated, is_active, job_status, error_category)."""
    out = F.when(~F.col("authenticated"), "pending_auth")
    if not listed:
        out = out.when(~F.col("is_active"), "inactive")
    out = out.when(F.col("job_status").isin("running", "cancelling", "pending"), "syncing")
    if not listed:
        out = out.when((F.col("job_status") == "failed") & F.col("error_category").isin("auth", "credentials"), "needs_reauth")
    return out.when(F.col("job_status") == "failed", "error").otherwise("active")


def collection_status(connections: DataFrame) -> DataFrame:
    """NEEDS SOURCE, ACTIVE or ERROR from the states of a collection's connections."""
    found = connections.groupBy("collection_id").agg(
        F.count_if(F.col("authenticated")).alias("n"),
        F.count_if(F.col("authenticated") & F.coalesce(F.col("job_status") == "failed", F.lit(False))).alias("failed"),
    )
    return found.select("collection_id", F.when(F.col("n") == 0, "NEEDS SOURCE").when(F.col("n") == F.col("failed"), "ERROR").otherwise("ACTIVE").alias("status"))


def trend(now: Column, before: Column) -> tuple[Column, Column]:
    """(direction, percent) against the period before; over 5 % either way counts as a change."""
    percent = F.when(F.coalesce(before, F.lit(0)) == 0, F.when(now > 0, F.lit(100.0)).otherwise(F.lit(0.0))).otherwise(F.round((now - before) / before * 100, 1))
    return F.when(percent > 5, "up").when(percent < -5, "down").otherwise("stable"), percent


def usage_allowed(current: Column, amount: Column, limit: Column, status: Column) -> Column:
    """False where a plan's status blocks use or the limit would be passed; no limit allows all."""
    return F.when(status.isin("past_due", "cancelled"), False).when(limit.isNull(), True).otherwise(current + amount <= limit)


def normalized_tokens(prompt: Column, completion: Column, prompt_factor: float, completion_factor: float) -> Column:
    return (prompt * prompt_factor + completion * completion_factor).cast("long")


def layered(*configs: Column) -> Column:
    """Maps merged from outer to inner; the inner value wins unless it is null."""
    out = configs[0]
    for c in configs[1:]:
        out = F.map_zip_with(out, c, lambda k, a, b: F.coalesce(b, a))
    return out


def period_at(rows: DataFrame, periods: DataFrame, at: str, key: str) -> DataFrame:
    """Each row with the newest period of its key that holds its time: start <= at < end."""
    joined = rows.join(periods, key).where((F.col("period_start") <= F.col(at)) & (F.col("period_end") > F.col(at)))
    names = rows.columns
    w = Window.partitionBy(*names).orderBy(F.desc("period_start"), F.desc("period_id"))
    return joined.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def organisations(orgs: DataFrame, users: DataFrame, connections: DataFrame, usage: DataFrame, search: str | None = None, sort: str = "created_at", descending: bool = True) -> DataFrame:
    """Organisations with counts of users, connections and entities; each side is aggregated before it is joined."""
    if sort not in SORTS:
        sort = "created_at"
    people = users.groupBy("org_id").agg(F.count(F.lit(1)).alias("n_users"), F.max("last_active").alias("last_active"))
    links = connections.groupBy("org_id").agg(F.count(F.lit(1)).alias("n_connections"))
    used = usage.groupBy("org_id").agg(F.sum("entities").alias("n_entities"))
    out = orgs if search is None else orgs.where(F.lower("name").contains(search.lower()))
    for side in (people, links, used):
        out = out.join(side, "org_id", "left")
    out = out.fillna(0, ["n_users", "n_connections", "n_entities"])
    column = F.col(SORTS[sort])
    return out.orderBy(column.desc_nulls_last() if descending else column.asc_nulls_last(), "org_id")


#: States of a billing period in which its usage counts.
OPEN_PERIODS = ["active", "trial", "grace"]


def organisations_by_usage(orgs: DataFrame, periods: DataFrame, usage: DataFrame, at: Column) -> DataFrame:
    """orgs with the usage of the billing period that holds the time, start <= at < end, in an open state; of several the
    newest. Organisations without one have nulls. The most used come first.

    periods: org_id, period_id, period_start, period_end, status; usage: period_id and counts.
    """
    held = periods.where((F.col("period_start") <= at) & (F.col("period_end") > at) & F.col("status").isin(OPEN_PERIODS))
    one = held.groupBy("org_id").agg(F.max_by("period_id", F.struct("period_start", "period_id")).alias("period_id"))
    out = orgs.join(one, "org_id", "left").join(usage, "period_id", "left")
    return out.orderBy(F.col("entities").desc_nulls_last(), "org_id")


def tags(jobs: DataFrame) -> DataFrame:
    """Sorted distinct tags of each sync."""
    return jobs.select("sync_id", F.explode("tags").alias("tag")).groupBy("sync_id").agg(F.sort_array(F.collect_set("tag")).alias("tags"))


#: The states that may follow a job's state; from the others no step leads on.
TRANSITIONS = {
    "pending": ["running", "cancelled", "failed"],
    "running": ["completed", "failed", "cancelling"],
    "cancelling": ["cancelled"],
}


def bad_transitions(history: DataFrame) -> DataFrame:
    """Steps of jobs that the state machine does not allow."""
    w = Window.partitionBy("job_id").orderBy("at", "step_id")
    steps = history.withColumn("before", F.lag("status").over(w)).where(F.col("before").isNotNull())
    allowed = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return steps.where(~F.coalesce(F.array_contains(allowed[F.col("before")], F.col("status")), F.lit(False)))
