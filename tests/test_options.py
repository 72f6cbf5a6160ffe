import math
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketframe.functions.dates import day_start_text
from marketframe.functions.math import log_factorial, log_sum_exp, with_norm_cdf
from marketframe.operators import options


def test_norm_cdf(spark):
    xs = [x / 7 for x in range(-60, 61)] + [-30.0, 30.0, 0.0]
    got = with_norm_cdf(spark.createDataFrame([(x,) for x in xs], "x double"), {"n": "x"}).collect()
    for r in got:
        assert r.n == pytest.approx(0.5 * math.erfc(-r.x / math.sqrt(2)), rel=1e-12, abs=1e-300)


def test_log_functions(spark):
    got = spark.range(0, 400, 7).select("id", log_factorial(F.col("id")).alias("f")).collect()
    assert all(r.f == pytest.approx(math.lgamma(r.id + 1), rel=1e-10) for r in got)
    assert spark.range(1).select(log_sum_exp(F.array(F.lit(1000.0), F.lit(1000.0)))).first()[0] == pytest.approx(1000 + math.log(2))


def test_tickers(spark):
    df = spark.createDataFrame([("O:AAPL230616C00150000",), ("O:BRKB1230616P00012500",)], "ticker string")
    got = options.parse_tickers(df).orderBy("ticker").collect()
    assert got[0][1:] == ("AAPL", date(2023, 6, 16), "c", 150.0)
    assert got[1][1:] == ("BRKB1", date(2023, 6, 16), "p", 12.5)
    bad = spark.createDataFrame([("O:nonsense",), (None,)], "ticker string")
    assert [r[1:] for r in options.parse_tickers(bad, strict=False).collect()] == [(None,) * 4] * 2
    with pytest.raises(Exception, match="malformed"):
        options.parse_tickers(bad).collect()


def test_times(spark):
    noon = int(datetime(2023, 6, 15, 12).timestamp() - datetime(1970, 1, 1).timestamp()) * 10**9
    df = spark.createDataFrame([(noon, date(2023, 6, 16))], "window_start bigint, expiration_date date")
    got = options.add_times(df).first()
    assert got.DTE == 0.5 and got.t == 0.5 / 365 and got.window_start_dt == datetime(2023, 6, 15, 12)


CHAIN = [(kind, s, k, t, v) for kind in "cp" for s in (80.0, 100.0) for k in (90.0, 100.0) for t in (0.1, 1.0) for v in (0.15, 0.6)]
CHAIN_SCHEMA = "opt_type string, stock_close double, strike_price double, t double, sigma double"


def test_implied_vol_inverts_price(spark):
    df = options.add_price(spark.createDataFrame(CHAIN, CHAIN_SCHEMA), sigma="sigma", to="close")
    for r in options.add_implied_vol(df).collect():
        discounted = r.strike_price * math.exp(-0.01 * r.t)
        low = max(r.stock_close - discounted if r.opt_type == "c" else discounted - r.stock_close, 0)
        if r.close - low > 1e-4:
            assert r.implied_vol == pytest.approx(r.sigma, abs=1e-6)


def test_put_call_parity(spark):
    df = options.add_price(spark.createDataFrame(CHAIN, CHAIN_SCHEMA), sigma="sigma", to="close").toPandas()
    both = df.pivot(index=["stock_close", "strike_price", "t", "sigma"], columns="opt_type", values="close").reset_index()
    gap = both.c - both.p - both.stock_close + both.strike_price * np.exp(-0.01 * both.t)
    assert np.abs(gap).max() < 1e-9


def test_no_vol_outside_bounds(spark):
    df = spark.createDataFrame([("c", 100.0, 90.0, 1.0, 5.0), ("c", 100.0, 90.0, 0.0, 15.0), ("c", None, 90.0, 1.0, 15.0), ("x", 100.0, 90.0, 1.0, 15.0)], "opt_type string, stock_close double, strike_price double, t double, close double")
    assert [r.implied_vol for r in options.add_implied_vol(df).collect()] == [None] * 4


def test_greeks(spark):
    df = spark.createDataFrame([("c", 100.0, 100.0, 1.0, 0.2), ("p", 100.0, 100.0, 1.0, 0.2), ("c", 100.0, 100.0, 0.0, 0.2)], "opt_type string, stock_close double, strike_price double, t double, implied_vol double")
    call, put, dead = options.add_greeks(df, 0.05).collect()
    assert call.delta == pytest.approx(0.6368306512) and call.gamma == pytest.approx(0.0187620173)
    assert call.theta == pytest.approx(-6.4140275464 / 365) and call.vega == pytest.approx(0.3752403469)
    assert put.delta == pytest.approx(call.delta - 1) and dead.delta is None


def test_join_and_portfolio(spark):
    opts = spark.createDataFrame([("A", 1, 5.0), ("B", 1, 6.0)], "underlying string, window_start bigint, close double")
    stocks = spark.createDataFrame([("A", 1, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0)], "ticker string, window_start bigint, volume double, open double, close double, high double, low double, transactions double")
    got = {r.underlying: r.stock_close for r in options.join_stocks(opts, stocks).collect()}
    assert got == {"A": 3.0, "B": None}
    legs = spark.createDataFrame([("x", "c", 100.0, 0.5, 0.2, 5.0), ("x", "c", 100.0, 0.5, 0.2, -5.0)], "p string, opt_type string, strike_price double, t double, implied_vol double, quantity double")
    net = options.portfolio_greeks(legs, spark.createDataFrame([(90.0,), (110.0,)], "spot double"), ["p"]).collect()
    assert len(net) == 2 and all(r.delta == 0 and r.vega == 0 for r in net)


def test_hedge(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 2))
    y = -(x @ [1.5, -2.0]) + rng.normal(size=40) * 0.01
    df = spark.createDataFrame([("p", float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "p string, x1 double, x2 double, y double")
    got = options.hedge_weights(df, ["p"], "x1", "x2", "y").first()
    want = np.linalg.lstsq(x, -y, rcond=None)[0]
    assert (got.w1, got.w2) == pytest.approx(tuple(want))
    flat = options.hedge_weights(df.withColumn("x2", F.col("x1")), ["p"], "x1", "x2", "y").first()
    assert flat.w1 is None


def test_adjusted_vol(spark):
    got = spark.range(1).select(options.adjusted_vol(F.lit(0.2), F.lit(110.0), F.lit(100.0), F.lit(-0.1), F.lit(0.5)).alias("v")).first().v
    assert got == pytest.approx(0.2 - 0.01 + 0.21 * 0.5)


def test_day_text(spark):
    assert spark.range(1).select(day_start_text(F.lit("2024-03-01"))).first()[0] == "2024-03-01T00:00:00Z"
    with pytest.raises(Exception):
        spark.range(1).select(day_start_text(F.lit("March"))).collect()
