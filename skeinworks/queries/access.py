"""Memberships and visibility for many users."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import access, lookups
from .base import IDX, Register, index, table

reg = Register()


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users in nations, nations in regions, and a cycle of two regions."""
    users = table(spark, sf_dir, "customer").selectExpr("concat('u', c_custkey) as member_id", "'user' as member_type", "concat('n', c_nationkey) as group_id")
    nested = table(spark, sf_dir, "nation").selectExpr("concat('n', n_nationkey) as member_id", "'group' as member_type", "concat('r', n_regionkey) as group_id")
    cycle = spark.createDataFrame([("r0", "group", "r1"), ("r1", "group", "r0")], "member_id string, member_type string, group_id string")
    return users.unionByName(nested).unionByName(cycle)


_REACHED = """m as (select 'u' || c_custkey as member_id, 'user' as member_type, 'n' || c_nationkey as group_id from customer union all select 'n' || n_nationkey, 'group', 'r' || n_regionkey from nation union all values ('r0', 'group', 'r1'), ('r1', 'group', 'r0')),
g as (select member_id, group_id from m where member_type = 'user' union select g.member_id, m.group_id from g join m on m.member_type = 'group' and m.member_id = g.group_id)"""


@reg("j07_groups_expanded", f"with recursive {_REACHED} select member_id, group_id from g")
def _(spark, sf_dir):
    return access.expanded(memberships(spark, sf_dir)).select("member_id", "group_id")


@reg("j07_principals", f"with recursive {_REACHED} select member_id, 'user:' || member_id || ',' || string_agg('group:' || group_id, ',' order by group_id) as principals from g group by member_id")
def _(spark, sf_dir):
    named = access.principals(access.expanded(memberships(spark, sf_dir)))
    rest = F.array_join(F.array_except("principals", F.array(F.concat(F.lit("user:"), "member_id"))), ",")
    return named.select("member_id", F.concat(F.lit("user:"), "member_id", F.lit(","), rest).alias("principals"))


def layers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers in groups that halve from level to level: memberships, those removed, and those added, some of which close cycles."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    half = "cast(floor(c_custkey / 2) as bigint)"
    users = c.selectExpr("concat('u', c_custkey) as member_id", "'user' as member_type", f"concat('g', {half}) as group_id")
    nested = c.where("c_custkey > 1").selectExpr("concat('g', c_custkey) as member_id", "'group' as member_type", f"concat('g', {half}) as group_id")
    gone = nested.where("substr(member_id, 2) % 97 = 3").unionByName(users.where("substr(member_id, 2) % 31 = 5"))
    down = c.where("c_custkey % 89 = 1").selectExpr("concat('g', c_custkey) as member_id", "'group' as member_type", "concat('g', 2 * c_custkey) as group_id")
    across = c.where("c_custkey % 101 = 7").selectExpr("concat('g', c_custkey) as member_id", "'group' as member_type", "concat('g', c_custkey % 50) as group_id")
    late = c.where("c_custkey % 41 = 9").selectExpr("concat('u', c_custkey) as member_id", "'user' as member_type", "'g0' as group_id")
    return users.unionByName(nested), gone, down.unionByName(across).unionByName(late)


_LAYERS = """b as (select 'u' || c_custkey as member_id, 'user' as member_type, 'g' || c_custkey // 2 as group_id, c_custkey as k from customer union all select 'g' || c_custkey, 'group', 'g' || c_custkey // 2, c_custkey from customer where c_custkey > 1),
a as (select member_id, member_type, group_id from b where case member_type when 'group' then k % 97 <> 3 else k % 31 <> 5 end union select 'g' || c_custkey, 'group', 'g' || 2 * c_custkey from customer where c_custkey % 89 = 1
union select 'g' || c_custkey, 'group', 'g' || c_custkey % 50 from customer where c_custkey % 101 = 7 union select 'u' || c_custkey, 'user', 'g0' from customer where c_custkey % 41 = 9),
o as (select member_id, group_id from b where member_type = 'user' union select o.member_id, b.group_id from o join b on b.member_type = 'group' and b.member_id = o.group_id),
n as (select member_id, group_id from a where member_type = 'user' union select n.member_id, a.group_id from n join a on a.member_type = 'group' and a.member_id = n.group_id)"""


def _changed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, access.ClosureChange]:
    rows, gone, new = layers(spark, sf_dir)
    closure = access.expanded(rows)
    return closure, access.closure_change(rows, closure, gone, new)


@reg("st11_closure_after_changes", f"with recursive {_LAYERS} select member_id, group_id from n")
def _(spark, sf_dir):
    return access.closure_after(*_changed(spark, sf_dir))


@reg("st11_closure_changes", f"with recursive {_LAYERS} select member_id, group_id, 'REMOVE' as op from (from o except from n) union all select member_id, group_id, 'ADD' from (from n except from o)")
def _(spark, sf_dir):
    change = _changed(spark, sf_dir)[1]
    return change.removed.withColumn("op", F.lit("REMOVE")).unionByName(change.added.withColumn("op", F.lit("ADD")))


@reg("j08_visible_to", f"with {IDX}, v as (select entity_id, unnest(access_viewers) as p from idx), u as (select 'm' || i as member_id, unnest(['user:u' || i % 7, 'group:g' || i % 3]) as p from range(12) t(i)) select distinct member_id, entity_id from v join u using (p)")
def _(spark, sf_dir):
    named = spark.range(12).selectExpr("concat('m', id) as member_id", "array(concat('user:u', id % 7), concat('group:g', id % 3)) as principals")
    return access.visible_to(index(spark, sf_dir), named)


@reg("j05_memberships_of_collection", "select c_custkey as member_id from customer join nation on c_nationkey = n_nationkey where n_regionkey = 2")
def _(spark, sf_dir):
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("member_id"), F.col("c_nationkey").alias("connection_id"))
    links = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("connection_id"), F.col("n_regionkey").alias("collection_id"))
    return lookups.memberships_of(own, links, 2).select("member_id")


@reg("j06_has_controlled_sources", f"with {IDX} select collection_id, bool_or(access_is_public is not null) as controlled from idx group by all")
def _(spark, sf_dir):
    return lookups.has_controlled_sources(index(spark, sf_dir))
