"""Results do not depend on how a series is cut, and the rows are shuffled once."""

import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from marketframe.keyed import KeyedTable
from marketframe.operators import blocks, indicators, signals, stats

ORDER = ["day", "id"]


def rows():
    rng = random.Random(12)
    out = [(i, g, rng.randrange(40) if g != "late" else rng.randrange(30, 40), rng.choice([None, 1e6 + rng.random(), 1e6 - 3 * rng.random()])) for i, g in enumerate(rng.choice(["a", "b", None, "late"]) for _ in range(400))]
    return [*out, (900, "one", 3, 2.0), (901, "none", 3, None), (902, "a", None, 1e6)]


CUTS = {"one": "0", "days": "coalesce(day, -1)", "weeks": "floor(coalesce(day, -1) / 7)"}


@pytest.fixture
def df(spark):
    return spark.createDataFrame(rows(), "id bigint, g string, day int, v double").repartition(3)


def by_series():
    out = {}
    for r in sorted(rows(), key=lambda r: (r[2] is not None, r[2] or 0, r[0])):
        out.setdefault(r[1], []).append(r)
    return out


def of(df, *cols):
    return {r.id: tuple(r[c] for c in cols) for r in df.collect()}


@pytest.mark.parametrize("cut", CUTS)
def test_rows_before(df, cut):
    got = of(blocks.rows_before(df, ["g"], ORDER, F.expr(CUTS[cut]), ["id", "v"], 5, "last"), "last")
    for series in by_series().values():
        for i, r in enumerate(series):
            assert [tuple(x) for x in got[r[0]][0]] == [(x[0], x[3]) for x in series[max(0, i - 5) : i]]


@pytest.mark.parametrize("cut", CUTS)
def test_carried(df, cut):
    sums = of(blocks.running_sums(df, ["g"], ORDER, F.expr(CUTS[cut]), {"s": "v"}), "s")
    last = of(blocks.last_values(df, ["g"], ORDER, F.expr(CUTS[cut]), {"x": "v"}, own_too=True), "x")
    before = of(blocks.last_values(df, ["g"], ORDER, F.expr(CUTS[cut]), {"x": "v"}, own_too=False), "x")
    moments = of(blocks.running_moments(df, ["g"], ORDER, F.expr(CUTS[cut]), {"m": "v"}), "m")
    for series in by_series().values():
        for i, r in enumerate(series):
            held = [x[3] for x in series[: i + 1] if x[3] is not None]
            earlier = [x[3] for x in series[:i] if x[3] is not None]
            assert sums[r[0]][0] == (pytest.approx(sum(held)) if held else None)
            assert last[r[0]][0] == (held[-1] if held else None) and before[r[0]][0] == (earlier[-1] if earlier else None)
            n, mean, std = moments[r[0]][0]
            assert n == len(held) and mean == (pytest.approx(statistics.fmean(held), rel=1e-12) if held else None)
            assert std == (pytest.approx(statistics.stdev(held), rel=1e-6) if len(held) > 1 else None)


def test_operators_are_the_same_in_any_blocks(df):
    table = KeyedTable(df, ("id",), ("id", "g"), ("v",), tuple(ORDER))
    price = df.withColumn("v", F.coalesce("v", F.lit(5.0)))
    every = {
        "shifted": lambda b: stats.shifted(table, ["g"], ["v"], 3, b).df,
        "cumulative": lambda b: stats.cumulative_stats(table, ["g"], ["v"], "p", block=b).df,
        "offset": lambda b: stats.offset_stats(table, ["g"], ["v"], "p", block=b).df,
        "rolling": lambda b: stats.rolling_stats(table, ["g"], ["v"], "p", 4, b).df,
        "changes": lambda b: indicators.changes(df, "v", ["g"], ORDER, b),
        "rsi": lambda b: indicators.rsi(price, "v", 6, ["g"], ORDER, block=b),
        "crossover": lambda b: indicators.crossover(df, "v", 1e6, ["g"], ORDER, "x", b),
        "filled": lambda b: signals.forward_filled(df, ["v"], ["g"], ORDER, b),
        "change": lambda b: signals.pct_change(price, "v", ["g"], ORDER, "x", b),
        "returns": lambda b: signals.strategy_returns(price.withColumn("at", F.lit(1)), "v", "at", ["g"], ORDER, lag_position=True, block=b),
    }
    for name, of_block in every.items():
        whole, cut = of_block(None), of_block(F.expr(CUTS["days"]))
        cols = [c for c in whole.columns if c != "id"]
        assert whole.columns == cut.columns
        a, b = of(whole, *cols), of(cut, *cols)
        close = lambda x, y: x == y or pytest.approx(x, rel=1e-6, abs=1e-6) == y
        assert a.keys() == b.keys() and all(close(x, y) for k in a for x, y in zip(a[k], b[k], strict=True)), name


def test_rows_are_shuffled_once(spark, df):
    """What carries the rows' own columns goes through one exchange, by series and block."""
    wide = df.withColumn("wide", F.lit("x").cast("string")).withColumn("wide", F.concat("wide", F.col("id").cast("string")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for made in (
            blocks.running_moments(wide, ["g"], ORDER, F.expr(CUTS["days"]), {"m": "v"}), blocks.rows_before(wide, ["g"], ORDER, F.expr(CUTS["days"]), ["v"], 3, "last"),
            blocks.last_values(wide, ["g"], ORDER, F.expr(CUTS["days"]), {"x": "v"}, own_too=True),
        ):
            plan = made._jdf.queryExecution().executedPlan().toString()
            parts = re.split(r"(?=Exchange )", plan)
            carrying = [p for p in parts[1:] if re.search(r"Exchange hashpartitioning", p) and "wide#" in p.split("Exchange", 2)[1]]
            assert len(carrying) == 1 and "__at" in carrying[0], plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
