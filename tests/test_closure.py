"""A stored closure of groups after changes of memberships, against the closure found anew."""

import random

import pytest

from skeinworks.operators import access

SCHEMA = "member_id string, member_type string, group_id string"


def pairs(df):
    return sorted((r.member_id, r.group_id) for r in df.collect())


def changed(spark, rows, gone, new):
    frame = lambda x: spark.createDataFrame(x, SCHEMA)
    closure = access.expanded(frame(rows))
    change = access.closure_change(frame(rows), closure, frame(gone), frame(new))
    after = [x for x in rows if x not in gone or x in new] + list(new)
    want = pairs(access.expanded(frame(after)))
    assert pairs(access.closure_after(closure, change)) == want
    assert set(pairs(change.removed)) == set(pairs(closure)) - set(want)
    assert set(pairs(change.added)) == set(want) - set(pairs(closure))
    return change


@pytest.mark.parametrize("seed", range(2))
def test_random_changes_with_cycles(spark, seed):
    rng = random.Random(seed)
    groups = [f"g{i}" for i in range(9)]
    user = lambda: (f"u{rng.randrange(6)}", "user", rng.choice(groups))
    nest = lambda: (rng.choice(groups), "group", rng.choice(groups))
    rows = sorted({user() for _ in range(8)} | {nest() for _ in range(12)})
    gone = rng.sample(rows, 6) + [("nobody", "user", "g1")]
    new = sorted({user() for _ in range(2)} | {nest() for _ in range(3)}) + [gone[0]]
    changed(spark, rows, gone, new)


def test_a_cycle_that_loses_its_entry_holds_nobody(spark):
    rows = [("u", "user", "a"), ("a", "group", "b"), ("b", "group", "c"), ("c", "group", "b")]
    change = changed(spark, rows, [("a", "group", "b")], [])
    assert pairs(change.removed) == [("u", "b"), ("u", "c")]


def test_a_second_way_keeps_a_pair(spark):
    rows = [("u", "user", "a"), ("u", "user", "b"), ("a", "group", "top"), ("b", "group", "top")]
    assert pairs(changed(spark, rows, [("a", "group", "top")], []).removed) == []


def test_an_added_way_from_a_lost_group_gives_nothing(spark):
    rows = [("u", "user", "a"), ("a", "group", "b")]
    change = changed(spark, rows, [("u", "user", "a")], [("b", "group", "c")])
    assert pairs(change.added) == [] and pairs(change.removed) == [("u", "a"), ("u", "b")]


def test_cost_follows_the_change(spark):
    rows = [(f"u{i}", "user", f"g{i}") for i in range(300)] + [(f"g{i}", "group", "all") for i in range(300)]
    assert changed(spark, rows, [("u7", "user", "g7")], [("u8", "user", "g9")]).examined == 3


def test_nulls_and_empty_tables(spark):
    rows = [("u", "user", "a"), (None, "user", "a"), ("a", "group", None)]
    frame = lambda x: spark.createDataFrame(x, SCHEMA)
    closure = access.expanded(frame(rows))
    change = access.closure_change(frame(rows), closure, frame([(None, "user", "a")]), frame([]))
    assert pairs(access.closure_after(closure, change)) == [("u", "a")] and change.examined == 0


def written(spark, monkeypatch, run):
    """Rows of all tables that run stores."""
    counts = []

    def counting(df):
        kept = real(df)
        counts.append(kept.count())
        return kept

    real = access.stored
    monkeypatch.setattr(access, "stored", counting)
    run()
    monkeypatch.setattr(access, "stored", real)
    return counts


def test_levels_are_doubled(spark, monkeypatch):
    """A chain of 40 groups takes few tables, with the depths of a walk."""
    rows = [("u", "user", "g0"), ("v", "user", "g30"), *[(f"g{i}", "group", f"g{i + 1}") for i in range(39)], ("g39", "group", "g20"), ("g3", "group", "g30")]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert len(written(spark, monkeypatch, lambda: access.expanded(frame))) < 20
    got = {(r.member_id, r.group_id): r.depth for r in access.expanded(frame).collect()}
    up, want = {}, {}
    for m, _, g in rows:
        up.setdefault(m, []).append(g)
    for user in ("u", "v"):
        front, depth = up[user], 1
        while front:
            for g in front:
                want[user, g] = depth
            front, depth = sorted({p for g in front for p in up.get(g, []) if (user, p) not in want}), depth + 1
    assert got == want
    for most in (1, 2, 3, 7):
        assert {(r.member_id, r.group_id): r.depth for r in access.expanded(frame, most).collect()} == {k: d for k, d in want.items() if d <= most}


def test_a_group_of_many_groups_is_not_paired_with_all_users(spark):
    """Groups inside a group in doubt are not tried for every user that has the doubt."""
    rows = [(f"u{i}", "user", f"g{i % 20}") for i in range(60)] + [(f"g{i}", "group", "all") for i in range(20)] + [("all", "group", "top"), ("g3", "group", "top")]
    change = changed(spark, rows, [("all", "group", "top"), ("g5", "group", "all")], [(f"h{i}", "group", "top") for i in range(500)])
    assert len(pairs(change.removed)) == 57 + 3 and change.examined == 57 + 3 + 3 + 3


def test_joins_with_the_closure_do_not_grow_with_levels(spark, monkeypatch):
    """However deep the groups, the closure and the pairs in doubt are compared once: tables of members are few."""

    def tables(depth):
        rows = [(f"u{i}", "user", "g0") for i in range(50)] + [(f"g{i}", "group", f"g{i + 1}") for i in range(depth)]
        closure = access.expanded(spark.createDataFrame(rows, SCHEMA))
        frame = lambda x: spark.createDataFrame(x, SCHEMA)
        return sum(n >= 50 for n in written(spark, monkeypatch, lambda: access.closure_change(frame(rows), closure, frame([("g0", "group", "g1")]), frame([("g0", "group", "g2")]))))

    assert tables(4) == tables(9)
