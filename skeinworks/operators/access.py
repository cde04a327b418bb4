"""Access control: predicates over viewers, and the groups a member belongs to."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored


def visible(principals: Sequence[str] | None) -> Column:
    """Public rows and those a principal may view; None: no restriction, empty: public rows only.

    Null where neither is known, which a filter drops.
    """
    if principals is None:
        return F.lit(True)
    public = F.col("access_is_public")
    if not principals:
        return public
    return public | F.arrays_overlap("access_viewers", F.array(*map(F.lit, principals)))


def visible_in_memory(principals: Sequence[str]) -> Column:
    """As for rows of query-time sources: rows without access data pass."""
    return F.col("access_is_public").isNull() | visible(principals)


def may_open(principals: Sequence[str] | None) -> Column:
    """Check of one row: no access data, public, no context, or empty viewers let it pass."""
    if principals is None:
        return F.lit(True)
    viewers = F.col("access_viewers")
    return (
        F.when(F.col("access_is_public").isNull() & viewers.isNull(), True)
        .when(F.coalesce(F.col("access_is_public"), F.lit(False)), True)
        .when(F.coalesce(F.size(viewers), F.lit(0)) <= 0, True)
        .otherwise(F.coalesce(F.arrays_overlap(viewers, F.array(*map(F.lit, principals or [""]))), F.lit(False)))
    )


def default_access(supports_acl: Column) -> Column:
    """is_public of a row written without access data: closed if its source has access control, else public."""
    return F.when(F.col("access_is_public").isNotNull(), F.col("access_is_public")).otherwise(~supports_acl)


def expanded(memberships: DataFrame, most_depth: int | None = None) -> DataFrame:
    """(member_id, group_id, depth): groups of each user, over groups that are members of groups.

    memberships: member_id, member_type (user or group), group_id. Cycles end at what was seen. Ways between groups are found
    first, by doubling their length, and joined with the direct groups of users once, so what moves follows the ways and the pairs found and not
    their number times the levels. All levels are followed unless most_depth limits them.
    """
    edges = memberships.where("member_id is not null and group_id is not null").select("member_id", "member_type", "group_id").distinct()
    direct = stored(_direct(edges))
    ways = _ways(_nested(edges), direct, None if most_depth is None else most_depth - 1)
    over = direct.join(ways, "group_id").select("member_id", F.col("parent").alias("group_id"), (F.col("steps") + 1).alias("depth"))
    pairs = direct.withColumn("depth", F.lit(1)).unionByName(over)
    return stored(pairs.groupBy(*_PAIR).agg(F.min("depth").alias("depth")))


def _ways(nested: DataFrame, starts: DataFrame, most: int | None) -> DataFrame:
    """(group_id, parent, steps): the shortest ways of at most `most` steps from groups to those they are in.

    Starts (group_id) are the groups with users: edges from groups with neither users nor groups in them are left out. Each round joins the
    longest ways, of n steps, with all that begin where they end; a way of up to 2 n steps has such a point, so rounds are few.
    """
    edges = nested.where("group_id <> parent")
    begun = starts.select("group_id").unionByName(edges.select(F.col("parent").alias("group_id"))).distinct()
    found = stored(edges.join(begun, "group_id", "left_semi").select("group_id", "parent", F.lit(1).alias("steps")))
    ways, longest, n = found, found, 1
    while (most is None or n < most) and not longest.isEmpty():
        ends = stored(longest.select("parent").distinct())
        more = ways.select(F.col("group_id").alias("middle"), F.col("parent").alias("end"), F.col("steps").alias("more"))
        more = more.join(ends.select(F.col("parent").alias("middle")), "middle", "left_semi")
        step = longest.join(more, F.col("parent") == F.col("middle")).where("group_id <> end")
        step = step.groupBy("group_id", F.col("end").alias("parent")).agg(F.min(F.col("steps") + F.col("more")).alias("steps"))
        found = stored(step.join(ways.select("group_id", "parent"), ["group_id", "parent"], "left_anti"))
        n *= 2
        ways, longest = ways.unionByName(found), found.where(F.col("steps") == n)
    return ways if most is None else ways.where(F.col("steps") <= most)


class ClosureChange(NamedTuple):
    """What a change of memberships does to stored (member_id, group_id) pairs."""

    removed: DataFrame
    added: DataFrame
    examined: int  # pairs in doubt and pairs found, which is what the change cost


_PAIR = ["member_id", "group_id"]


def _direct(edges: DataFrame) -> DataFrame:
    return edges.where("member_type = 'user'").select(*_PAIR)


def _nested(edges: DataFrame) -> DataFrame:
    return edges.where("member_type = 'group'").select(F.col("member_id").alias("group_id"), F.col("group_id").alias("parent"))


def _up(pairs: DataFrame, nested: DataFrame) -> DataFrame:
    """Pairs one level above, not yet each once."""
    return pairs.join(nested, "group_id").select("member_id", F.col("parent").alias("group_id"))


def _above(pairs: DataFrame, nested: DataFrame) -> DataFrame:
    """Stored pairs with all pairs above them: levels are followed for their groups only, and joined with the members once."""
    front = stored(pairs.select("group_id").distinct().join(nested, "group_id").distinct())
    found = front
    while not front.isEmpty():
        step = front.select(F.col("group_id").alias("start"), F.col("parent").alias("group_id")).join(nested, "group_id")
        step = step.select(F.col("start").alias("group_id"), "parent").distinct()
        front = stored(step.join(found, ["group_id", "parent"], "left_anti"))
        found = found.unionByName(front)
    return pairs.unionByName(_up(pairs, found)).distinct()


def closure_change(memberships: DataFrame, closure: DataFrame, removed: DataFrame, added: DataFrame) -> ClosureChange:
    """Pairs that leave and enter the closure of memberships when some rows are removed and others added.

    memberships, removed, added: member_id, member_type, group_id; closure: the pairs of `expanded(memberships)`. A row
    removed and added stays; one removed that is not there, or added that is, changes nothing. First every pair with a way over a
    removed row is put in doubt. Then those are found again to which the memberships afterwards still lead, with all that the
    added rows lead to. Levels are followed between the groups that the change touches; the closure is joined a fixed number of
    times, whatever the levels, and never found anew. Cycles end at what was seen.
    """
    keys = ["member_id", "member_type", "group_id"]
    edges = [df.where("member_id is not null and group_id is not null").select(*keys).distinct() for df in (memberships, removed, added)]
    before = stored(edges[0])
    gone = stored(edges[1].join(edges[2], keys, "left_anti").join(before, keys, "left_semi"))
    new = stored(edges[2].join(before, keys, "left_anti"))
    after = stored(before.join(gone, keys, "left_anti").unionByName(new))
    held, nested = closure.select(*_PAIR), _nested(after)

    begun = stored(_direct(gone).unionByName(_up(held, _nested(gone))).distinct())
    doubted = stored(_above(begun, _nested(before)))
    sure = stored(held.join(doubted, _PAIR, "left_anti"))

    # Ways to a pair in doubt: a direct membership, or a group inside that group that its user holds beyond doubt. They are looked for from
    # what is sure upwards: a group may have any number of groups inside it, of which its user holds few.
    into = stored(nested.join(doubted.select(F.col("group_id").alias("parent")).distinct(), "parent", "left_semi").select("group_id", "parent"))
    again = _up(sure, into).unionByName(_direct(after)).join(doubted, _PAIR, "left_semi")
    reached = _direct(new).unionByName(_up(sure, _nested(new)))
    # Only those that are not held beyond doubt are followed and found.
    begun = stored(again.unionByName(reached.join(sure, _PAIR, "left_anti")).distinct())
    found = stored(_above(begun, nested).join(sure, _PAIR, "left_anti"))
    return ClosureChange(doubted.join(found, _PAIR, "left_anti"), found.join(doubted, _PAIR, "left_anti"), doubted.count() + found.count())


def closure_after(closure: DataFrame, change: ClosureChange) -> DataFrame:
    """The pairs of the closure after a change."""
    return closure.select(*_PAIR).join(change.removed, _PAIR, "left_anti").unionByName(change.added)


def principals(groups: DataFrame) -> DataFrame:
    """(member_id, principals): `user:x` and one `group:y` for each group."""
    out = groups.groupBy("member_id").agg(F.collect_set(F.concat(F.lit("group:"), "group_id")).alias("g"))
    return out.select("member_id", F.sort_array(F.array_union(F.array(F.concat(F.lit("user:"), "member_id")), "g")).alias("principals"))


def visible_to(rows: DataFrame, named: DataFrame) -> DataFrame:
    """(member_id, entity_id) for many users: a join on the exploded viewers; public rows are left to the caller."""
    seen = rows.select("entity_id", F.explode("access_viewers").alias("principal")).distinct()
    who = named.select("member_id", F.explode("principals").alias("principal"))
    return who.join(seen, "principal").select("member_id", "entity_id").distinct()
