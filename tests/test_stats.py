import math
import statistics

import pytest

from marketframe.keyed import KeyedTable
from marketframe.operators import stats

VALUES = {2030: [3, 8, 4, 9], 2029: [5, 1, 1, 6]}


@pytest.fixture
def season(spark):
    rows = [(4, s, w, v, 2 * v) for s, values in VALUES.items() for w, v in enumerate(values)]
    return KeyedTable(spark.createDataFrame(rows, "id bigint, season bigint, week bigint, stat1 bigint, stat2 bigint"), ("id", "season", "week"))


def by_season(f):
    """``f(values so far)`` for every row, in the order of season and week."""
    return [f(VALUES[s][: i + 1]) for s in sorted(VALUES) for i in range(len(VALUES[s]))]


def same(got, want):
    assert [r[0] for r in got] == [None if x is None else pytest.approx(x) for x in want]


def mean(x):
    return statistics.mean(x) if x else None


def std(x):
    return statistics.stdev(x) if len(x) > 1 else None


def ordered(df, *cols):
    return [tuple(r) for r in df.orderBy("season", "week").select(*cols).collect()]


def test_grouped_sums(season, spark):
    total = sum(map(sum, VALUES.values()))
    assert stats.grouped_sums(season, ["id"], ["stat1", "stat2"]).df.first()[1:] == (total, 2 * total)
    empty = KeyedTable(spark.createDataFrame([(1, None)], "id bigint, v double"), ("id",))
    assert stats.grouped_sums(empty, ["id"], ["v"]).df.first().v == 0.0


def test_summary(season):
    got = stats.summary_stats(season, ["id"], ["stat1"], "p").df.first()
    every = [v for values in VALUES.values() for v in values]
    assert got.p_stat1_mean == mean(every) and got.p_stat1_std == pytest.approx(std(every)) and got.p_count_n == len(every)


def test_shifted(season):
    got = stats.shifted(season, ["id", "season"], ["stat1"], 2).df
    for n in (1, 2):
        same(ordered(got, f"shifted_stat1_{n}"), by_season(lambda x, n=n: x[-1 - n] if len(x) > n else None))


def test_cumulative(season):
    got = stats.cumulative_stats(season, ["id", "season"], ["stat1"], "p").df
    same(ordered(got, "p_stat1_cuml_mean"), by_season(mean))
    same(ordered(got, "p_stat1_cuml_std"), by_season(std))
    same(ordered(got, "p_count_cuml_n"), by_season(len))


def test_offset(season):
    got = stats.offset_stats(season, ["id", "season"], ["stat1"], "p").df
    same(ordered(got, "p_shifted_stat1_1_cuml_mean"), by_season(lambda x: mean(x[:-1])))
    same(ordered(got, "p_shifted_stat1_1_cuml_std"), by_season(lambda x: std(x[:-1])))
    same(ordered(got, "p_count_cuml_n"), by_season(lambda x: len(x) - 1))


def test_cumulative_stats_join_beside_summaries(season):
    """The names of running and of whole statistics differ, so both can be joined."""
    both = season.joined_stats(stats.summary_stats(season, ["id", "season"], ["stat1"], "p")).joined_stats(stats.cumulative_stats(season, ["id", "season"], ["stat1"], "p"))
    assert {"p_stat1_mean", "p_stat1_cuml_mean", "p_count_n", "p_count_cuml_n"} <= set(both.df.columns)


def test_cumulative_null(spark):
    t = KeyedTable(spark.createDataFrame([(1, 1, 2.0), (1, 2, None), (1, 3, 4.0)], "g bigint, i bigint, v double"), ("g", "i"))
    got = stats.cumulative_stats(t, ["g"], ["v"], "p").df.orderBy("i").collect()
    assert [(r.p_v_cuml_mean, r.p_count_cuml_n) for r in got] == [(2.0, 1), (None, 1), (3.0, 2)]


def test_rolling(season):
    got = stats.rolling_stats(season, ["id", "season"], ["stat1"], "p", 2).df
    before = lambda f: by_season(lambda x: f(x[-3:-1]) if len(x) > 2 else None)
    same(ordered(got, "p_rolling_2_stat1_mean"), before(mean))
    grouped = stats.grouped_rolling_stats(season, ["id", "season"], ["id"], ["stat1"], "p", 2).df.first()
    means, stds = ([x for x in before(f) if x is not None] for f in (mean, std))
    assert grouped.group_p_rolling_2_stat1_mean == pytest.approx(mean(means))
    assert grouped.group_p_rolling_2_stat1_std == pytest.approx(math.sqrt(mean([x * x for x in stds]) / len(stds)))


def test_no_groups(season):
    with pytest.raises(ValueError):
        stats.shifted(season, [], ["stat1"])


def test_fill(spark):
    t = KeyedTable(spark.createDataFrame([(1, None, 2.0, 3.0, None)], "id bigint, p_curr_ssn_x_mean double, p_prev_ssn_x_mean double, p_curr_ssn_x_std double, p_prev_ssn_x_std double"), ("id",))
    assert stats.fill_current_season(t, ["x"], "p").df.select("p_curr_ssn_x_mean", "p_curr_ssn_x_std").first()[:] == (2.0, 3.0)
    with pytest.raises(KeyError):
        stats.fill_current_season(t, ["y"], "p")
