"""Keyed tables: rows are made by a rule here, and what is expected follows from them in plain Python."""

from collections import Counter

import pytest

from marketframe.functions.columns import intersection, require, stat_name, sym_diff, union
from marketframe.keyed import KeyedTable
from marketframe.plans.pipeline import Pipeline

KEY = ("site", "probe")
SCHEMA = "site string, probe int, taken int, level double"
#: Every probe of every site once; and with each probe p read p times, at times that fall.
ONCE = [(f"s{s}", p, 100 * s + p, s / (p + 1)) for s in range(3) for p in range(1, 5)]
OFTEN = [(f"s{s}", p, 50 - 7 * k - s, k + p / 10) for s in range(3) for p in range(1, 5) for k in range(p)]


@pytest.fixture
def once(spark):
    return KeyedTable(spark.createDataFrame(ONCE, SCHEMA), KEY)


@pytest.fixture
def often(spark):
    return KeyedTable(spark.createDataFrame(OFTEN, SCHEMA).repartition(3), KEY, order_by=("taken",))


def test_column_lists():
    assert intersection(["a", "b", "c"], ["c", "b"]) == ["b", "c"]
    assert intersection() == union() == sym_diff() == []
    assert union(["a", "b"], ["b", "c"]) == ["a", "b", "c"]
    assert sym_diff(["a", "b"], ["b", "c"], ["b", "d"]) == ["a", "b", "c", "d"]
    assert stat_name("p", "yards", "mean") == "p_yards_mean"
    assert stat_name("p", "yards", "mean", "curr") == "p_curr_yards_mean"
    with pytest.raises(KeyError, match="z"):
        require(["a"], ["a", "z"])


@pytest.mark.parametrize("key", [KEY, ("site",), ("site", "probe", "taken"), ("taken", "level"), ("level",)])
def test_keys(spark, rows, key):
    for made in (ONCE, OFTEN):
        table = KeyedTable(spark.createDataFrame(made, SCHEMA), key)
        place = [SCHEMA.split(", ").index(next(c for c in SCHEMA.split(", ") if c.startswith(k + " "))) for k in key]
        of = lambda r, place=place: tuple(r[i] for i in place)
        seen = Counter(map(of, made))
        repeated = sorted(r for r in made if seen[of(r)] > 1)
        assert table.is_key() == (not repeated) and rows(table.duplicate_rows()) == repeated
        if repeated:
            with pytest.raises(AssertionError):
                table.assert_key()
        else:
            table.assert_key()


def test_null_is_a_value_of_a_key(spark):
    made = [(None, 1), (None, 2), (7, 1)]
    assert KeyedTable(spark.createDataFrame(made, "a int, b int"), ("a", "b")).is_key()
    assert not KeyedTable(spark.createDataFrame([*made, (None, 2)], "a int, b int"), ("a", "b")).is_key()


def test_deduped(often, once, rows):
    groups: dict = {}
    for r in OFTEN:
        groups.setdefault(r[:2], []).append(r)
    for keep, pick in (("first", min), ("last", max)):
        assert rows(often.deduped(keep).df) == sorted(pick(g, key=lambda r: r[2]) for g in groups.values())
    assert rows(often.deduped("none").df) == sorted(g[0] for g in groups.values() if len(g) == 1)
    some = rows(often.deduped("any").df)
    assert sorted(r[:2] for r in some) == sorted(groups) and set(some) <= set(OFTEN)
    assert rows(once.deduped_key().df) == sorted(ONCE)
    with pytest.raises(TypeError):
        often.deduped("some")


def test_construction(once):
    with pytest.raises(ValueError):
        KeyedTable(once.df, ())
    with pytest.raises(TypeError):
        KeyedTable(ONCE, KEY)
    with pytest.raises(KeyError):
        KeyedTable(once.df, ("depth",))
    assert KeyedTable(once.df, KEY, (*KEY, "taken")).measures == ("level",)


def test_nulls(spark, rows):
    t = KeyedTable(spark.createDataFrame([(1, None, float("nan")), (2, "x", 1.0)], "n bigint, s string, v double"), ("n",))
    assert t.null_columns() == ["s"]
    assert [r[0] for r in rows(t.null_rows())] == [1]
    t.check_nulls(["n", "v"])
    with pytest.raises(ValueError, match="s"):
        t.check_nulls()


def test_foreign_key(spark, once):
    sites = KeyedTable(spark.createDataFrame([], "probe int, kind string"), ("probe", "kind"))
    wide = KeyedTable(once.df, KEY, (*KEY, "taken"))
    assert wide.foreign_key(sites) == ["probe"]
    assert wide.column_difference(sites) == ["site", "taken", "level", "kind"]


@pytest.mark.parametrize("lag", [None, ("taken", 1), ("taken", 100)])
def test_joined_stats(spark, rows, lag):
    """Each row gets the stats of its probe and time, or of a time earlier; without any, null."""
    base = KeyedTable(spark.createDataFrame(ONCE, SCHEMA), KEY, ("site", "probe", "taken"), ("level",))
    facts = {(p, t): p * 1000 + t for p in range(1, 5) for t in range(0, 260, 3)}
    stats = KeyedTable(spark.createDataFrame([(p, t, x) for (p, t), x in facts.items()], "probe int, taken int, drift int"), ("probe", "taken"))
    got = rows(base.joined_stats(stats, lag=lag, check=True).df)
    assert got == sorted((*r, facts.get((r[1], r[2] - (lag[1] if lag else 0)))) for r in ONCE)
    assert any(r[-1] is None for r in got) and any(r[-1] is not None for r in got)


def test_fan_out_is_seen(spark, once):
    twice = KeyedTable(spark.createDataFrame([(1, 5), (1, 6)], "probe int, more int"), ("probe",))
    with pytest.raises(AssertionError):
        once.joined_stats(twice, check=True)


def test_completeness(spark, once, rows):
    asked = [("s0", 1), ("s2", 9), (None, 1), ("s9", None)]
    other = KeyedTable(spark.createDataFrame(asked, "site string, probe int"), KEY)
    held = {r[:2] for r in ONCE}
    assert set(rows(once.missing_from(other))) == {r for r in asked if r not in held}
    with pytest.raises(ValueError, match="s2"):
        once.check_completeness(other)
    once.check_completeness(once)


def test_pipeline(once):
    assert Pipeline([]).execute(once) is once
    out = Pipeline([lambda t: t.pipe(lambda d: d.where("probe > 1"))]).then(lambda t: t.pipe(lambda d: d.where("probe < 4"))).execute(once)
    assert out.df.count() == sum(1 < r[1] < 4 for r in ONCE)
