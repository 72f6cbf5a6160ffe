"""The registered queries: each operator on the supplied tables, beside the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.functions import dates
from marketframe.functions import math as fm
from marketframe.keyed import KeyedTable
from marketframe.operators import bars, indicators, mixture, nested, options, signals, stats
from marketframe.operators.blocks import haloed, own
from marketframe.plans.pipeline import Pipeline
from marketframe.sources import lake, tables
from marketframe.sources.scratch import scratch, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL if SQL can express it."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of additions doesn't show, and without negative zeros."""
    return df.select(*[(F.round(c, places) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# -- keys and nulls

LINE_KEY, LINE_ORDER = ("l_orderkey", "l_linenumber"), ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def lines(spark, sf_dir) -> KeyedTable:
    return KeyedTable(table(spark, sf_dir, "lineitem"), LINE_KEY, order_by=LINE_ORDER)


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def k1_duplicate_keys(spark, sf_dir):
    return lines(spark, sf_dir).duplicate_keys().withColumnRenamed("count", "n")


@query("SELECT * FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1")
def k2_duplicate_rows(spark, sf_dir):
    return lines(spark, sf_dir).duplicate_rows()


_FIRST = "SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey {0}, l_suppkey {0}, l_quantity {0}, l_extendedprice {0}) = 1"


@query(_FIRST.format("ASC"))
def k3_dedupe_first(spark, sf_dir):
    return lines(spark, sf_dir).deduped("first").df


@query(_FIRST.format("DESC"))
def k3_dedupe_last(spark, sf_dir):
    return lines(spark, sf_dir).deduped("last").df


@query("SELECT * FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) = 1")
def k3_dedupe_none(spark, sf_dir):
    return lines(spark, sf_dir).deduped("none").df


@query("SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def k3_dedupe_any(spark, sf_dir):
    return lines(spark, sf_dir).deduped("any").df.select(*LINE_KEY)


@query(_FIRST.format("ASC"))
def k4_dedupe_if_needed(spark, sf_dir):
    return lines(spark, sf_dir).deduped_key().df


@query("SELECT DISTINCT date_trunc('day', ts)::TIMESTAMP AS day FROM events")
def k5_trading_days(spark, sf_dir):
    return bars.trading_days(table(spark, sf_dir, "events"), "ts")


@query("SELECT DISTINCT hour(ts)::INTEGER AS hour FROM events")
def k5_trading_hours(spark, sf_dir):
    return bars.trading_hours(table(spark, sf_dir, "events"), "ts")


def gappy(spark, sf_dir) -> KeyedTable:
    """Events without a value where the type is error."""
    df = table(spark, sf_dir, "events").withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))
    return KeyedTable(df, ("event_id",), ("event_id", "user_id", "event_type"), ("value",), ("user_id", "ts", "event_id"))


GAPPY = "WITH e AS (SELECT event_id, ts, user_id, event_type, CASE WHEN event_type <> 'error' THEN value END AS value, props FROM events) "


@query(GAPPY + "SELECT * FROM (SELECT unnest(['event_id', 'event_type', 'value']) AS name, unnest([count(*) - count(event_id), count(*) - count(event_type), count(*) - count(value)]) AS nulls FROM e) WHERE nulls > 0")
def p3_null_columns(spark, sf_dir):
    found = gappy(spark, sf_dir).null_counts(["event_id", "event_type", "value"])
    return spark.createDataFrame([(c, n) for c, n in found.items() if n], "name string, nulls bigint")


def _passes(check: Callable[[], None]) -> bool:
    try:
        check()
    except ValueError:
        return False
    return True


@query(GAPPY + "SELECT * FROM (SELECT unnest(['event_id', 'user_id', 'value']) AS name, unnest([count(*) = count(event_id), count(*) = count(user_id), count(*) = count(value)]) AS passed FROM e)")
def p5_null_check(spark, sf_dir):
    """Which columns pass the check that raises for nulls."""
    checked = gappy(spark, sf_dir)
    return spark.createDataFrame([(c, _passes(lambda c=c: checked.check_nulls([c]))) for c in ("event_id", "user_id", "value")], "name string, passed boolean")


@query(GAPPY + "SELECT * FROM e WHERE value IS NULL OR user_id IS NULL")
def p4_null_rows(spark, sf_dir):
    return gappy(spark, sf_dir).null_rows(["value", "user_id"])


# -- joins


def daily(spark, sf_dir) -> KeyedTable:
    df = table(spark, sf_dir, "events").withColumn("day", F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")))
    return KeyedTable(df, ("event_id",), ("event_id", "user_id", "day", "event_type"), order_by=("ts", "event_id"))


DAILY = """WITH d AS (SELECT *, date_diff('day', DATE '2024-01-01', ts::DATE)::INTEGER AS day FROM events),
s AS (SELECT user_id, day, avg(value) AS u_value_mean, stddev_samp(value) AS u_value_std, count(value) AS u_count_n FROM d GROUP BY ALL) """


@query(DAILY + "SELECT d.event_id, d.user_id, d.day, round(u_value_mean, 6) AS u_value_mean, round(u_value_std, 6) AS u_value_std, u_count_n FROM d LEFT JOIN s USING (user_id, day)")
def j1_joined_stats(spark, sf_dir):
    base = daily(spark, sf_dir)
    found = stats.summary_stats(base, ["user_id", "day"], ["value"], "u")
    return rounded(base.joined_stats(found).df.select("event_id", "user_id", "day", "u_value_mean", "u_value_std", "u_count_n"))


@query(DAILY + "SELECT d.event_id, d.user_id, d.day, round(u_value_mean, 6) AS u_value_mean, u_count_n FROM d LEFT JOIN s ON s.user_id = d.user_id AND s.day + 1 = d.day")
def j2_prior_stats(spark, sf_dir):
    base = daily(spark, sf_dir)
    found = stats.summary_stats(base, ["user_id", "day"], ["value"], "u")
    return rounded(base.joined_stats(found, lag=("day", 1)).df.select("event_id", "user_id", "day", "u_value_mean", "u_count_n"))


@query("SELECT d.doc_id, d.lang, d.source FROM documents d ANTI JOIN labels l USING (doc_id)")
def j3_completeness(spark, sf_dir):
    labels = KeyedTable(table(spark, sf_dir, "labels"), ("doc_id",))
    docs = KeyedTable(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), ("doc_id",))
    return labels.missing_from(docs)


@query("""WITH t AS (SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS day, sum(o_totalprice) AS total FROM orders GROUP BY ALL)
SELECT a.day, round(a.total, 2) AS total, round(b.total, 2) AS future FROM t a LEFT JOIN t b ON b.day = a.day + INTERVAL 7 DAY""")
def j5_at_horizon(spark, sf_dir):
    totals = table(spark, sf_dir, "orders").groupBy(F.date_trunc("day", "o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("total"))
    return rounded(bars.at_horizon(totals, "day", "total", "7 DAYS"), 2)


# -- grouped and ordered statistics


@query("SELECT l_suppkey, l_returnflag, sum(l_quantity) AS l_quantity, sum(l_linenumber)::BIGINT AS l_linenumber FROM lineitem GROUP BY ALL")
def a1_grouped_sums(spark, sf_dir):
    return stats.grouped_sums(lines(spark, sf_dir), ["l_suppkey", "l_returnflag"], ["l_quantity", "l_linenumber"]).df


@query("""SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS line_all_l_quantity_mean, round(stddev_samp(l_quantity), 6) AS line_all_l_quantity_std,
round(avg(l_tax), 6) AS line_all_l_tax_mean, round(stddev_samp(l_tax), 6) AS line_all_l_tax_std, count(l_quantity) AS line_all_count_n FROM lineitem GROUP BY ALL""")
def a2_summary_stats(spark, sf_dir):
    return rounded(stats.summary_stats(lines(spark, sf_dir), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_tax"], "line", "all").df)


@query(GAPPY + """SELECT event_id, lag(value, 1) OVER w AS shifted_value_1, lag(value, 2) OVER w AS shifted_value_2, lag(value, 3) OVER w AS shifted_value_3
FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def w1_shifted(spark, sf_dir):
    return stats.shifted(gappy(spark, sf_dir), ["user_id"], ["value"], 3, day_block()).df.select("event_id", *[f"shifted_value_{i}" for i in (1, 2, 3)])


@query(GAPPY + """SELECT event_id, CASE WHEN value IS NOT NULL THEN round(avg(value) OVER w, 8) END AS u_value_cuml_mean,
CASE WHEN value IS NOT NULL THEN round(stddev_samp(value) OVER w, 8) END AS u_value_cuml_std, count(value) OVER w AS u_count_cuml_n
FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def w2_cumulative_stats(spark, sf_dir):
    return rounded(stats.cumulative_stats(gappy(spark, sf_dir), ["user_id"], ["value"], "u", block=day_block()).df, 8)


@query(GAPPY + """, s AS (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS x FROM e)
SELECT event_id, CASE WHEN x IS NOT NULL THEN round(avg(x) OVER w, 8) END AS u_shifted_value_1_cuml_mean,
CASE WHEN x IS NOT NULL THEN round(stddev_samp(x) OVER w, 8) END AS u_shifted_value_1_cuml_std, count(x) OVER w AS u_count_cuml_n
FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def w3_offset_stats(spark, sf_dir):
    return rounded(stats.offset_stats(gappy(spark, sf_dir), ["user_id"], ["value"], "u", block=day_block()).df, 8)


ROLLING = """, r AS (SELECT event_id, event_type, CASE WHEN count(value) OVER w = 5 THEN avg(value) OVER w END AS m, CASE WHEN count(value) OVER w = 5 THEN stddev_samp(value) OVER w END AS s
FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)) """


@query(GAPPY + ROLLING + "SELECT event_id, round(m, 6) AS u_rolling_5_value_mean, round(s, 6) AS u_rolling_5_value_std FROM r")
def w4_rolling_stats(spark, sf_dir):
    return rounded(stats.rolling_stats(gappy(spark, sf_dir), ["user_id"], ["value"], "u", 5, day_block()).df.select("event_id", "u_rolling_5_value_mean", "u_rolling_5_value_std"))


@query(GAPPY + ROLLING + "SELECT event_type, round(avg(m), 6) AS group_u_rolling_5_value_mean, round(sqrt(avg(s * s) / nullif(count(s), 0)), 6) AS group_u_rolling_5_value_std FROM r GROUP BY event_type")
def a3_grouped_rolling_stats(spark, sf_dir):
    return rounded(stats.grouped_rolling_stats(gappy(spark, sf_dir), ["user_id"], ["event_type"], ["value"], "u", 5, day_block()).df)


@query(DAILY + """, c AS (SELECT user_id, day, avg(value) AS m, stddev_samp(value) AS d FROM d GROUP BY ALL)
SELECT a.user_id, a.day, round(coalesce(a.d, b.d), 6) AS u_curr_ssn_value_std, round(coalesce(a.m, b.m), 6) AS u_curr_ssn_value_mean
FROM c a LEFT JOIN c b ON b.user_id = a.user_id AND b.day + 1 = a.day""")
def p9_fill_current(spark, sf_dir):
    base = daily(spark, sf_dir)
    now = stats.summary_stats(base, ["user_id", "day"], ["value"], "u", "curr_ssn")
    before = stats.summary_stats(base, ["user_id", "day"], ["value"], "u", "prev_ssn")
    filled = stats.fill_current_season(now.joined_stats(before, lag=("day", 1)), ["value"], "u")
    return rounded(filled.df.select("user_id", "day", "u_curr_ssn_value_std", "u_curr_ssn_value_mean"))


# -- bars


@query("""SELECT event_type AS symbol, date_trunc('day', ts)::TIMESTAMP - INTERVAL 5 HOUR + INTERVAL 1 DAY AS label, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low,
arg_max(value, ts) AS close, round(sum(value), 6) AS volume FROM events GROUP BY event_type, date_trunc('day', ts)""")
def a5_daily_bars(spark, sf_dir):
    ticks = table(spark, sf_dir, "events").withColumnRenamed("event_type", "symbol")
    return rounded(bars.daily_bars(ticks, ["symbol"], "ts", **dict.fromkeys(("open", "high", "low", "close", "volume"), "value")))


BARS = """WITH RECURSIVE t AS (SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS day, ts, value, row_number() OVER (PARTITION BY event_type, date_trunc('day', ts) ORDER BY ts) AS i FROM events),
w AS (SELECT event_type, day, ts, value, i, CASE WHEN value > 500 THEN 1 ELSE 0 END::BIGINT AS bar, value AS total FROM t WHERE i = 1
UNION ALL SELECT t.event_type, t.day, t.ts, t.value, t.i, CASE WHEN w.total + t.value > 500 THEN w.bar + 1 ELSE w.bar END, CASE WHEN w.total + t.value > 500 THEN t.value ELSE w.total + t.value END
FROM w JOIN t ON t.event_type = w.event_type AND t.day = w.day AND t.i = w.i + 1) """


def ticks(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_type", F.date_trunc("day", "ts").alias("day"), "ts", "event_id", "value")


@query(BARS + "SELECT event_type, day, ts, bar FROM w")
def w14_volume_groups(spark, sf_dir):
    return bars.volume_groups(ticks(spark, sf_dir), ["event_type", "day"], ["ts", "event_id"], "value", 500).select("event_type", "day", "ts", "bar")


@query(BARS + """SELECT event_type, day, bar, max(ts) AS ts, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, round(sum(value), 6) AS volume
FROM w GROUP BY event_type, day, bar""")
def a4_volume_bars(spark, sf_dir):
    return rounded(bars.volume_bars(ticks(spark, sf_dir), ["event_type", "day"], "ts", 500, "value", "value", ["event_id"]))


@query("""SELECT unnest(['value']) AS "column", count(value) AS count, count(*) - count(value) AS null_count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min,
quantile_disc(value, 0.2) AS p20, quantile_disc(value, 0.4) AS p40, quantile_disc(value, 0.6) AS p60, quantile_disc(value, 0.8) AS p80, max(value) AS max FROM events""")
def a6_described(spark, sf_dir):
    out = bars.described(table(spark, sf_dir, "events"), ["value"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query("SELECT event_id, ts, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def o2_last_rows(spark, sf_dir):
    return bars.last_rows(table(spark, sf_dir, "events").select("event_id", "ts", "value"), ["ts", "event_id"], 100)


# -- indicators and signals

SERIES, ORDER = ["event_type"], ["ts", "event_id"]
OVER = "(PARTITION BY event_type ORDER BY ts, event_id)"


def series(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "value")


def day_block() -> Column:
    return F.date_trunc("day", "ts")


@query(f"""SELECT event_id, round(d, 6) + 0.0 AS delta, round(greatest(coalesce(d, 0), 0), 6) + 0.0 AS gain, round(greatest(coalesce(-d, 0), 0), 6) + 0.0 AS loss
FROM (SELECT event_id, value - lag(value) OVER {OVER} AS d FROM events)""")
def w5_changes(spark, sf_dir):
    return rounded(indicators.changes(series(spark, sf_dir), "value", SERIES, ORDER, day_block()).select("event_id", "delta", "gain", "loss"))


RSI = f"""WITH d AS (SELECT *, value - lag(value) OVER {OVER} AS d FROM events),
m AS (SELECT event_id, event_type, ts, value, avg(greatest(coalesce(d, 0), 0)) OVER w AS g, avg(greatest(coalesce(-d, 0), 0)) OVER w AS l, count(*) OVER w AS n
FROM d WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)),
r AS (SELECT event_id, event_type, ts, value, CASE WHEN n < 14 THEN NULL WHEN l > 0 THEN 100 - 100 / (1 + g / l) WHEN g > 0 THEN 100 END AS rsi FROM m) """


def with_rsi(spark, sf_dir) -> DataFrame:
    return indicators.rsi(series(spark, sf_dir), "value", 14, SERIES, ORDER, block=day_block())


@query(RSI + 'SELECT event_id, round(rsi, 6) AS "RSI" FROM r')
def w6_rsi(spark, sf_dir):
    return rounded(with_rsi(spark, sf_dir).select("event_id", "RSI"))


def _ewm(name: str, source: str, col: str, alpha: float) -> str:
    """A recursive CTE of an exponentially weighted mean over ``source`` (event_id, event_type, i, col)."""
    d = 1 - alpha
    return f"""{name}(event_id, event_type, i, s, w) AS (SELECT event_id, event_type, i, {col}::DOUBLE, 1.0::DOUBLE FROM {source} WHERE i = 1
UNION ALL SELECT t.event_id, t.event_type, t.i, e.s * {d!r}::DOUBLE + t.{col}, e.w * {d!r}::DOUBLE + 1 FROM {name} e JOIN {source} t ON t.event_type = e.event_type AND t.i = e.i + 1)"""


NUMBERED = f"WITH RECURSIVE t AS (SELECT *, row_number() OVER {OVER} AS i FROM events), "


@query(NUMBERED + _ewm("e", "t", "value", 0.2) + " SELECT event_id, round(s / w, 6) AS ewm FROM e")
def w7_ewm_mean(spark, sf_dir):
    return rounded(indicators.ewm_mean(series(spark, sf_dir), "value", 0.2, SERIES, ORDER, day_block(), "ewm").select("event_id", "ewm"))


MACD = NUMBERED + ", ".join(
    [
        _ewm("f", "t", "value", 2 / 13),
        _ewm("s", "t", "value", 2 / 27),
        'm AS (SELECT f.event_id, f.event_type, f.i, f.s / f.w AS ema_fast, s.s / s.w AS ema_slow, f.s / f.w - s.s / s.w AS "MACD" FROM f JOIN s USING (event_id))',
        _ewm("g", "m", '"MACD"', 2 / 10),
    ]
)


@query(MACD + ' SELECT event_id, round(ema_fast, 5) AS ema_fast, round(ema_slow, 5) AS ema_slow, round("MACD", 5) AS "MACD", round(g.s / g.w, 5) AS macd_signal FROM m JOIN g USING (event_id)')
def w8_macd(spark, sf_dir):
    out = indicators.macd(series(spark, sf_dir), "value", 12, 26, 9, SERIES, ORDER, day_block())
    return rounded(out.select("event_id", "ema_fast", "ema_slow", "MACD", "macd_signal"), 5)


CROSSED = RSI + f""", x AS (SELECT *, round(rsi, 4) AS q, lag(round(rsi, 4)) OVER {OVER} AS p, avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS a FROM r),
y AS (SELECT *, lag(value) OVER {OVER} AS v, lag(a) OVER {OVER} AS b FROM x),
c AS (SELECT *, CASE WHEN p <= 50 AND q > 50 THEN 1 WHEN p >= 50 AND q < 50 THEN -1 ELSE 0 END AS half, CASE WHEN v <= b AND value > a THEN 1 WHEN v >= b AND value < a THEN -1 ELSE 0 END AS own FROM y) """


def crossed(spark, sf_dir) -> DataFrame:
    df = stored(with_rsi(spark, sf_dir), "rsi").withColumn("RSI", F.round("RSI", 4))
    found, w = haloed(df, SERIES, ORDER, day_block(), ["value"], 9)
    df = stored(own(found.withColumn("mean", F.avg("value").over(w.rowsBetween(-9, 0)))), "rsi")
    df = indicators.crossover(df, "RSI", 50, SERIES, ORDER, "half", day_block())
    return indicators.crossover(df, "value", "mean", SERIES, ORDER, "own", day_block())


@query(CROSSED + "SELECT event_id, half, own FROM c")
def w9_crossover(spark, sf_dir):
    return crossed(spark, sf_dir).select("event_id", "half", "own")


@query("SELECT event_id, coalesce(value BETWEEN 20 AND 60, false) AS inside FROM events")
def p11_in_range(spark, sf_dir):
    return signals.in_range(series(spark, sf_dir), "value", 20, 60, "inside").select("event_id", "inside")


@query(CROSSED + "SELECT event_id, CASE WHEN half = 1 THEN ts END AS up_at, CASE WHEN own = -1 THEN ts END AS down_at FROM c")
def p14_fired_at(spark, sf_dir):
    return signals.fired_at(crossed(spark, sf_dir), {"up_at": ("half", 1), "down_at": ("own", -1)}, "ts").select("event_id", "up_at", "down_at")


FILLED = CROSSED + """, z AS (SELECT *, last_value(CASE WHEN half = 1 THEN ts END IGNORE NULLS) OVER w AS up_at, last_value(CASE WHEN own = 1 THEN ts END IGNORE NULLS) OVER w AS over_at,
last_value(CASE WHEN half = -1 THEN ts END IGNORE NULLS) OVER w AS down_at, last_value(CASE WHEN own = -1 THEN ts END IGNORE NULLS) OVER w AS under_at
FROM c WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) """
FIRES = {"up_at": ("half", 1), "over_at": ("own", 1), "down_at": ("half", -1), "under_at": ("own", -1)}


def filled(spark, sf_dir) -> DataFrame:
    return signals.forward_filled(signals.fired_at(stored(crossed(spark, sf_dir), "crossed"), FIRES, "ts"), list(FIRES), SERIES, ORDER, day_block())


@query(FILLED + "SELECT event_id, up_at, over_at, down_at, under_at FROM z")
def w10_forward_fill(spark, sf_dir):
    return filled(spark, sf_dir).select("event_id", *FIRES)


RECENT = FILLED + """, f AS (SELECT *, ts - up_at <= INTERVAL 120 MINUTE AS up, ts - over_at <= INTERVAL 120 MINUTE AS above, ts - down_at <= INTERVAL 120 MINUTE AS down, ts - under_at <= INTERVAL 120 MINUTE AS under FROM z) """


def entries(spark, sf_dir) -> DataFrame:
    near = signals.recent(filled(spark, sf_dir), "ts", {"up": "up_at", "above": "over_at", "down": "down_at", "under": "under_at"}, "120 MINUTES")
    return signals.both(near, {"go_long": ("up", "above"), "go_short": ("down", "under")})


@query(RECENT + "SELECT event_id, up, above, up AND above AS go_long, down AND under AS go_short FROM f")
def w11_recent_signals(spark, sf_dir):
    return entries(spark, sf_dir).select("event_id", "up", "above", "go_long", "go_short")


@query(GAPPY + f"""SELECT event_id, round(value / nullif(last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 1, 6) AS change FROM e""")
def w12_pct_change(spark, sf_dir):
    return rounded(signals.pct_change(gappy(spark, sf_dir).df, "value", ["user_id"], ["ts", "event_id"], "change", day_block()).select("event_id", "change"))


WALKED = RECENT.replace("WITH d AS", "WITH RECURSIVE d AS") + f""", n AS (SELECT event_id, event_type, ts, value, coalesce(up AND above, false) AS li, coalesce(down, false) AS lo, coalesce(down AND under, false) AS si, coalesce(up, false) AS so,
row_number() OVER {OVER} AS i FROM f),
p AS (SELECT event_id, event_type, ts, value, i, CASE WHEN li THEN CASE WHEN lo THEN 0 ELSE 1 END WHEN si THEN CASE WHEN so THEN 0 ELSE -1 END ELSE 0 END AS position FROM n WHERE i = 1
UNION ALL SELECT n.event_id, n.event_type, n.ts, n.value, n.i, CASE
WHEN p.position = 1 OR (p.position = 0 AND n.li) THEN CASE WHEN n.lo THEN 0 ELSE 1 END
WHEN p.position = -1 OR (p.position = 0 AND n.si) THEN CASE WHEN n.so THEN 0 ELSE -1 END ELSE 0 END
FROM p JOIN n ON n.event_type = p.event_type AND n.i = p.i + 1) """


def positioned(spark, sf_dir) -> DataFrame:
    return signals.positions(stored(entries(spark, sf_dir), "entries"), "go_long", "down", "go_short", "up", SERIES, ORDER, day_block())


@query(WALKED + "SELECT event_id, position FROM p")
def w15_positions(spark, sf_dir):
    return positioned(spark, sf_dir).select("event_id", "position")


@query(WALKED + f""", q AS (SELECT *, value / nullif(lag(value) OVER {OVER}, 0) - 1 AS r, lag(position) OVER {OVER} AS held FROM p), u AS (SELECT *, r * held AS g FROM q)
SELECT event_id, round(g, 6) + 0.0 AS strategy_return, CASE WHEN g IS NOT NULL THEN round(sum(g) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) + 0.0 END AS cumulative_return FROM u""")
def w13_strategy_returns(spark, sf_dir):
    moved = stored(signals.pct_change(stored(positioned(spark, sf_dir), "positions"), "value", SERIES, ORDER, "r", day_block()), "moved")
    return rounded(signals.strategy_returns(moved, "r", "position", SERIES, ORDER, lag_position=True, block=day_block()).select("event_id", "strategy_return", "cumulative_return"))


# -- options

CHAIN = """WITH o AS (SELECT 'O:' || chr((65 + l_partkey % 26)::INTEGER) || chr((65 + l_suppkey % 7)::INTEGER) || strftime(DATE '2029-01-15' + (30 * (l_suppkey % 24))::INTEGER, '%y%m%d')
|| CASE WHEN l_linenumber % 2 = 0 THEN 'C' ELSE 'P' END || lpad((50000 + 2500 * (l_partkey % 40))::VARCHAR, 8, '0') AS ticker,
(epoch(l_shipdate)::BIGINT + 946080000) * 1000000000 AS window_start, l_quantity AS quantity, l_extendedprice / 1000 AS close, l_discount AS vol, l_tax AS tax FROM lineitem),
x AS (SELECT *, substr(ticker, 3, length(ticker) - 17) AS underlying, strptime('20' || substr(ticker, length(ticker) - 14, 6), '%Y%m%d')::DATE AS expiration_date,
lower(substr(ticker, length(ticker) - 8, 1)) AS opt_type, right(ticker, 8)::DOUBLE / 1000 AS strike_price FROM o),
s AS (SELECT DISTINCT underlying, window_start, (80 + (window_start // 86400000000000) % 60)::DOUBLE AS stock_close FROM x WHERE (window_start // 86400000000000) % 5 <> 0) """


def contracts(spark, sf_dir) -> DataFrame:
    """Option trades made from order lines."""
    line = table(spark, sf_dir, "lineitem")
    letter = lambda col, n: F.char(65 + F.col(col) % n)
    expires = F.date_add(F.lit("2029-01-15").cast("date"), (30 * (F.col("l_suppkey") % 24)).cast("int"))
    kind = F.when(F.col("l_linenumber") % 2 == 0, "C").otherwise("P")
    strike = F.lpad((50000 + 2500 * (F.col("l_partkey") % 40)).cast("string"), 8, "0")
    ticker = F.concat(F.lit("O:"), letter("l_partkey", 26), letter("l_suppkey", 7), F.date_format(expires, "yyMMdd"), kind, strike)
    start = (F.unix_seconds(F.col("l_shipdate").cast("timestamp")) + 946080000) * 1000000000
    return line.select(
        ticker.alias("ticker"), start.alias("window_start"), F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") / 1000).alias("close"), F.col("l_discount").alias("vol"), F.col("l_tax").alias("tax")
    )


def stock_prices(trades: DataFrame) -> DataFrame:
    day = F.expr("window_start div 86400000000000")
    one = trades.select(F.col("underlying").alias("ticker"), "window_start").distinct().where(day % 5 != 0)
    price = (80 + day % 60).cast("double")
    return one.withColumns({c: price for c in ("open", "close", "high", "low")} | {"volume": F.lit(0), "transactions": F.lit(0)})


@query(CHAIN + "SELECT ticker, underlying, expiration_date, opt_type, strike_price FROM x GROUP BY ALL")
def x1_parse_tickers(spark, sf_dir):
    return options.parse_tickers(contracts(spark, sf_dir)).select("ticker", "underlying", "expiration_date", "opt_type", "strike_price").distinct()


_TIMES = "make_timestamp(window_start // 1000) AS window_start_dt, expiration_date::TIMESTAMP AS expiration_dt, round((epoch(expiration_date)::BIGINT * 1000000000 - window_start) / 86400000000000, 6) AS \"DTE\", round((epoch(expiration_date)::BIGINT * 1000000000 - window_start) / 86400000000000 / 365, 6) AS t"


@query(CHAIN + f"SELECT ticker, window_start, {_TIMES} FROM x GROUP BY ALL")
def x2_option_times(spark, sf_dir):
    timed = options.add_times(options.parse_tickers(contracts(spark, sf_dir)))
    return rounded(timed.select("ticker", "window_start", "window_start_dt", "expiration_dt", "DTE", "t").distinct())


def chain(spark, sf_dir) -> DataFrame:
    trades = options.add_times(options.parse_tickers(contracts(spark, sf_dir)))
    return options.moneyness(options.join_stocks(trades, stock_prices(trades)))


_JOINED = CHAIN + "SELECT x.ticker, x.window_start, x.quantity, x.close, s.stock_close, round(s.stock_close / x.strike_price, 6) AS moneyness FROM x LEFT JOIN s USING (underlying, window_start)"


@query(_JOINED)
def j4_join_stocks(spark, sf_dir):
    return rounded(chain(spark, sf_dir).select("ticker", "window_start", "quantity", "close", "stock_close", "moneyness"))


@query(_JOINED)
def j4_bucketed_join(spark, sf_dir):
    """The same join on tables in buckets: the prices are found, and the sides joined, without a shuffle."""
    stored = lambda df, name, by: tables.bucketed(df, f"{name}_{uuid.uuid4().hex}", by, BUCKETS, scratch(spark, name))
    trades = stored(options.parse_tickers(contracts(spark, sf_dir)), "trades", ["underlying", "window_start"])
    stocks = stored(stock_prices(trades), "stocks", ["ticker", "window_start"])
    joined = options.moneyness(options.join_stocks(trades, stocks))
    return rounded(joined.select("ticker", "window_start", "quantity", "close", "stock_close", "moneyness"))


#: Buckets of the registered query; a table takes as many as keep a bucket within a task's memory.
BUCKETS = 64


def _sql_horner(x: str, top: tuple, bottom: tuple) -> str:
    num, den = f"{top[-1]!r}::DOUBLE * {x}", x
    for p, q in zip(top[:-2], bottom[:-1], strict=True):
        num, den = f"({num} + {p!r}::DOUBLE) * {x}", f"({den} + {q!r}::DOUBLE) * {x}"
    return f"(({num} + {top[-2]!r}::DOUBLE) / ({den} + {bottom[-1]!r}::DOUBLE))"


def _sql_cdf(d: str) -> str:
    """The same rational approximation of the normal distribution function; needs columns a_d, q_d and r_d."""
    a, q, r = f"a_{d}", f"q_{d}", f"r_{d}"
    near = f"1 - {a} * {_sql_horner(q, fm.ERF_P, fm.ERF_Q)}"
    middle = f"exp(-{q}) * {_sql_horner(a, fm.ERFC_P, fm.ERFC_Q)}"
    far = f"exp(-{q}) / {a} * (1 / sqrt(pi()) - {r} * {_sql_horner(r, fm.FAR_P, fm.FAR_Q)})"
    up = f"(CASE WHEN {a} <= 0.46875 THEN {near} WHEN {a} <= 4 THEN {middle} ELSE {far} END)"
    return f"(CASE WHEN {d} > 0 THEN 1 - 0.5 * {up} ELSE 0.5 * {up} END)"


def _sql_greeks(source: str, spot: str, sigma: str, rate: float) -> str:
    """CTEs that end in ``g`` with delta, gamma, theta and vega for the rows of ``source``."""
    helper = lambda d: f"greatest(abs({d}) / sqrt(2), 1e-300) AS a_{d}, {d} * {d} / 2 AS q_{d}, 2 / greatest({d} * {d}, 1e-300) AS r_{d}"
    return f"""d1s AS (SELECT *, (ln({spot} / strike_price) + ({rate} + ({sigma}) * ({sigma}) / 2) * t) / (({sigma}) * sqrt(t)) AS d1 FROM {source} WHERE {spot} > 0 AND t > 0 AND ({sigma}) > 0),
d2s AS (SELECT *, d1 - ({sigma}) * sqrt(t) AS d2, exp(-d1 * d1 / 2) / sqrt(2 * pi()) AS pdf FROM d1s),
hs AS (SELECT *, {helper("d1")}, {helper("d2")} FROM d2s),
cs AS (SELECT *, {_sql_cdf("d1")} AS n1, {_sql_cdf("d2")} AS n2, -{spot} * pdf * ({sigma}) / (2 * sqrt(t)) AS decay, {rate} * strike_price * exp(-{rate} * t) AS carry FROM hs),
g AS (SELECT *, CASE WHEN opt_type = 'c' THEN n1 ELSE n1 - 1 END AS delta, pdf / ({spot} * ({sigma}) * sqrt(t)) AS gamma,
CASE WHEN opt_type = 'c' THEN decay - carry * n2 ELSE decay + carry * (1 - n2) END / 365 AS theta, {spot} * pdf * sqrt(t) / 100 AS vega FROM cs) """


_FULL = CHAIN + ", c AS (SELECT x.*, s.stock_close, (epoch(expiration_date)::BIGINT * 1000000000 - window_start) / 86400000000000 / 365 AS t, 0.1 + vol AS sigma FROM x LEFT JOIN s USING (underlying, window_start)), "


_INVALID = "NOT coalesce(stock_close > 0 AND t > 0 AND sigma > 0, false)"


@query(_FULL + _sql_greeks("c", "stock_close", "sigma", 0.01) + f"""SELECT ticker, window_start, quantity, round(delta, 6) + 0.0 AS delta, round(gamma, 6) + 0.0 AS gamma, round(theta, 6) + 0.0 AS theta, round(vega, 6) + 0.0 AS vega FROM g
UNION ALL SELECT ticker, window_start, quantity, NULL, NULL, NULL, NULL FROM c WHERE {_INVALID}""")
def x5_greeks(spark, sf_dir):
    known = chain(spark, sf_dir).withColumn("implied_vol", 0.1 + F.col("vol"))
    return rounded(options.add_greeks(known).select("ticker", "window_start", "quantity", "delta", "gamma", "theta", "vega"))


_PRICED = _FULL + _sql_greeks("c", "stock_close", "sigma", 0.01) + """, k AS (SELECT *, strike_price * exp(-0.01 * t) AS d FROM g),
v AS (SELECT *, CASE WHEN opt_type = 'c' THEN stock_close * n1 - d * n2 ELSE d * (1 - n2) - stock_close * (1 - n1) END AS price,
greatest(CASE WHEN opt_type = 'c' THEN stock_close - d ELSE d - stock_close END, 0) AS low FROM k) """


#: A volatility is compared if the price changes by more than this per unit of it: below, the price's own rounding hides it.
VEGA = 1e-5


@query(_PRICED + f"""SELECT ticker, window_start, quantity, round(price, 6) + 0.0 AS close, CASE WHEN vega * 100 > {VEGA} THEN round(sigma, 6) END AS implied_vol FROM v
UNION ALL SELECT ticker, window_start, quantity, NULL, NULL FROM c WHERE {_INVALID}""")
def x4_implied_vol(spark, sf_dir):
    """Prices at known volatilities, inverted; shown where the volatility moves the price."""
    priced = options.add_price(chain(spark, sf_dir).withColumn("sigma", 0.1 + F.col("vol")), sigma="sigma", to="close")
    found = options.add_implied_vol(priced.select("ticker", "window_start", "quantity", "close", "stock_close", "strike_price", "t", "opt_type", "sigma"))
    s, years, v = F.col("stock_close"), F.when(F.col("t") > 0, F.col("t")), F.col("sigma")
    d1 = F.try_divide(F.log(s / F.col("strike_price")) + (0.01 + v * v / 2) * years, v * F.sqrt(years))
    vega = s * fm.norm_pdf(d1) * F.sqrt(years)
    return rounded(found.select("ticker", "window_start", "quantity", "close", F.when(vega > VEGA, F.col("implied_vol")).alias("implied_vol")))


@query(CHAIN + "SELECT ticker, window_start, round(0.1 + vol + (strike_price / 100 - 1) * -0.2 + (strike_price / 100 * strike_price / 100 - 1) * 0.05, 6) AS vol FROM x")
def x7_adjusted_vol(spark, sf_dir):
    of = options.adjusted_vol(0.1 + F.col("vol"), F.col("strike_price"), F.lit(100.0), F.lit(-0.2), F.lit(0.05))
    return rounded(options.parse_tickers(contracts(spark, sf_dir)).select("ticker", "window_start", of.alias("vol")))


SPOTS = (70.0, 85.0, 100.0, 115.0, 130.0)
_LEGS = CHAIN + ", c AS (SELECT x.*, 0.1 + vol AS sigma, 0.5 AS t, unnest([70.0, 85.0, 100.0, 115.0, 130.0])::DOUBLE AS spot FROM x), " + _sql_greeks("c", "spot", "sigma", 0.01)


def net_greeks(spark, sf_dir) -> DataFrame:
    legs = options.parse_tickers(contracts(spark, sf_dir)).withColumns({"implied_vol": 0.1 + F.col("vol"), "t": F.lit(0.5)})
    grid = spark.createDataFrame([(s,) for s in SPOTS], "spot double")
    return options.portfolio_greeks(legs, grid, ["underlying"])


@query(_LEGS + "SELECT underlying, spot, round(sum(quantity * delta), 4) + 0.0 AS delta, round(sum(quantity * gamma), 4) + 0.0 AS gamma, round(sum(quantity * theta), 4) + 0.0 AS theta, round(sum(quantity * vega), 4) + 0.0 AS vega FROM g GROUP BY ALL")
def a8_portfolio_greeks(spark, sf_dir):
    return rounded(net_greeks(spark, sf_dir), 4)


@query(_LEGS + """, n AS (SELECT underlying, spot, sum(quantity * delta) AS y, spot AS x1, abs(spot - 100) AS x2 FROM g GROUP BY underlying, spot),
k AS (SELECT underlying, sum(x1 * x1) AS a, sum(x1 * x2) AS b, sum(x2 * x2) AS d, sum(x1 * y) AS e, sum(x2 * y) AS f FROM n GROUP BY underlying)
SELECT underlying, round((b * f - d * e) / (a * d - b * b), 5) AS w1, round((b * e - a * f) / (a * d - b * b), 5) AS w2 FROM k""")
def a7_hedge_weights(spark, sf_dir):
    grid = net_greeks(spark, sf_dir).select("underlying", F.col("spot").alias("x1"), F.abs(F.col("spot") - 100).alias("x2"), F.col("delta").alias("y"))
    return rounded(options.hedge_weights(grid, ["underlying"], "x1", "x2", "y"), 5)


@query(CHAIN + ", g AS (SELECT underlying, opt_type, count(*) AS n FROM x GROUP BY ALL) SELECT underlying, opt_type, n, unnest([90.0, 110.0])::DOUBLE AS spot FROM g")
def j7_scenarios(spark, sf_dir):
    legs = options.parse_tickers(contracts(spark, sf_dir)).groupBy("underlying", "opt_type").agg(F.count("*").alias("n"))
    return options.scenarios(legs, spark.createDataFrame([(90.0,), (110.0,)], "spot double"))


# -- dates


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT00:00:00Z') AS day_text, (o_orderdate - INTERVAL 3 HOUR)::TIMESTAMP AS local, strptime(strftime(o_orderdate, '%Y-%m-%d'), '%Y-%m-%d')::TIMESTAMP AS parsed FROM orders""")
def x8_x9_x10_dates(spark, sf_dir):
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    fixed = dates.in_zone(F.col("o_orderdate"), "-03:00")
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.day_start_text(text).alias("day_text"), fixed.alias("local"), dates.parsed_time(text, "string").alias("parsed"))


# -- nested records


def nested_orders(spark, sf_dir) -> DataFrame:
    """Orders with their lines as JSON."""
    line = F.struct(F.col("l_linenumber").alias("number"), F.struct(F.col("l_partkey").alias("key"), F.col("l_quantity").alias("quantity")).alias("part"))
    listed = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(line).alias("lines"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(listed, "o_orderkey", "left")


@query("SELECT o_orderkey, o_orderstatus, l_linenumber AS lines_number, l_partkey AS lines_part_key, l_quantity AS lines_part_quantity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey")
def x12_flattened(spark, sf_dir):
    return nested.flattened(nested_orders(spark, sf_dir))


@query("SELECT event_id, n::BIGINT AS n, a, b FROM (SELECT event_id, (event_id % 3) AS n FROM events) CROSS JOIN LATERAL (SELECT unnest(CASE WHEN n = 0 THEN [NULL] ELSE range(n) END)::BIGINT AS a) CROSS JOIN (VALUES ('x'), ('y')) t(b)")
def j6_record_product(spark, sf_dir):
    n = F.col("event_id") % 3
    some = F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    df = table(spark, sf_dir, "events").select("event_id", n.alias("n"), some.alias("a"), F.array(F.lit("x"), F.lit("y")).alias("b"))
    return nested.merged(df, ["a", "b"])


PROPS = nested.struct({"k": nested.DOUBLE}, {"note": nested.STRING})


@query("""SELECT event_id, CASE WHEN event_id % 7 = 2 THEN NULL ELSE CAST(json_extract(props, '$.k') AS DOUBLE) END AS k,
CASE WHEN event_id % 7 = 2 THEN 'missing k' WHEN event_id % 7 = 3 THEN 'wrong type note' ELSE '' END AS wrong FROM events""")
def x11_parsed(spark, sf_dir):
    """Some records lack the required field, some have a number for a text."""
    odd = F.when(F.col("event_id") % 7 == 2, F.lit('{"note": "no k"}')).when(F.col("event_id") % 7 == 3, F.regexp_replace("props", r"\}$", ', "note": 5}')).otherwise(F.col("props"))
    got = nested.parsed(table(spark, sf_dir, "events").select("event_id", odd.alias("json")), "json", PROPS)
    return got.select("event_id", F.col("record.k").alias("k"), F.array_join("violations", ", ").alias("wrong"))


@query("""SELECT 'e' || o_orderkey AS id, 'b' || l_linenumber AS bookmaker_key, 'm' || (l_partkey % 3) AS market_key, 's' || l_suppkey AS outcome_name, l_extendedprice AS outcome_price
FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def s14_landed_odds(spark, sf_dir):
    """Order lines as saved odds responses: written as JSON, read with the payload's schema, flattened."""
    text = lambda c: F.col(c).cast("string")
    outcome = F.struct(F.concat(F.lit("s"), text("l_suppkey")).alias("name"), F.col("l_extendedprice").alias("price"))
    market = F.struct(F.concat(F.lit("m"), (F.col("l_partkey") % 3).cast("string")).alias("key"), F.lit("").alias("last_update"), F.array(outcome).alias("outcomes"))
    book = F.struct(F.concat(F.lit("b"), text("l_linenumber")).alias("key"), F.lit("").alias("title"), F.array(market).alias("markets"))
    found = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(book).alias("bookmakers"))
    path = scratch(spark, "landing")
    found.join(table(spark, sf_dir, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("e"), text("l_orderkey")).alias("id"), "bookmakers").write.json(path)
    events = spark.read.schema(nested.nullable(nested.EVENT)).json(path)
    return nested.odds_table(events).select("id", "bookmaker_key", "market_key", "outcome_name", "outcome_price")


# -- sources


@query("SELECT event_id, event_type AS ticker, value FROM events WHERE ts::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-08'")
def s4_read_days(spark, sf_dir):
    """Events written as a lake of day files, of which a range is read."""
    return lake.read_days(spark, event_lake(spark, sf_dir), lake.STOCKS, "2024-01-05", "2024-01-08")


def event_lake(spark, sf_dir, categories: tuple[str, ...] = (lake.STOCKS,)) -> str:
    """A lake of day files of all events; in the options category under other ids."""
    root = scratch(spark, "lake")
    events = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("ticker"), "value", F.col("ts").cast("date").alias("date"))
    for category in categories:
        own = events if category == lake.STOCKS else events.withColumn("event_id", -F.col("event_id"))
        lake.write_days(own, root, category)
    return root


@query("SELECT event_id, event_type AS ticker, value FROM events WHERE ts::DATE = DATE '2024-01-09'")
def s1_read_day(spark, sf_dir):
    return lake.read_day(spark, event_lake(spark, sf_dir), lake.STOCKS, "2024-01-09")


@query("SELECT 'stock' AS kind, event_id, event_type AS ticker, value FROM events WHERE ts::DATE = DATE '2024-01-09' UNION ALL SELECT 'option', -event_id, event_type, value FROM events WHERE ts::DATE = DATE '2024-01-09'")
def s3_stocks_and_options(spark, sf_dir):
    root = event_lake(spark, sf_dir, (lake.STOCKS, lake.OPTIONS))
    stocks, options_ = lake.read_stocks_and_options_day(spark, root, "2024-01-09")
    return stocks.withColumn("kind", F.lit("stock")).unionByName(options_.withColumn("kind", F.lit("option")))


@query("SELECT o_orderkey, o_orderstatus AS ticker, o_totalprice AS amount, date_trunc('day', o_orderdate)::TIMESTAMP AS ex_dividend_date FROM orders WHERE o_orderstatus IN ('F', 'P')")
def s5_dividends(spark, sf_dir):
    """Orders as dividends of their status, a file for each; two of the statuses and one that has no file are read."""
    root = scratch(spark, "dividends")
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("ticker"), F.col("o_totalprice").alias("amount"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("ex_dividend_date"))
    lake.write_tickers(df, root, "dividends_by_ticker")
    return lake.read_dividends(spark, root, ["F", "P", "none"])


@query("SELECT c_custkey, c_mktsegment AS ticker, c_acctbal AS surprise FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def s6_earnings(spark, sf_dir):
    root = scratch(spark, "earnings")
    lake.write_tickers(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("ticker"), F.col("c_acctbal").alias("surprise")), root, "earnings_by_ticker")
    return lake.read_earnings(spark, root, ["BUILDING", "MACHINERY", "none"])


@query("SELECT p_partkey, p_name, p_size FROM part")
def s8_read_tree(spark, sf_dir):
    """Parts in a tree of folders by size, beside files of another suffix, read by suffix."""
    root = scratch(spark, "tree")
    df = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", (F.col("p_size") % 5).alias("a"), (F.col("p_size") % 3).alias("b"))
    df.write.partitionBy("a", "b").mode("append").parquet(root)
    df.select("p_partkey").write.mode("append").csv(f"{root}/other")
    return lake.read_tree(spark, root, ".parquet").select("p_partkey", "p_name", "p_size")


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def s10_s11_write_and_read(spark, sf_dir):
    """Suppliers written as CSV, read, written as parquet, read."""
    first, second = scratch(spark, "table") + ".csv", scratch(spark, "table") + ".parquet"
    tables.write_table(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), first)
    tables.write_table(tables.read_table(spark, first), second)
    return tables.read_table(spark, second).select(F.col("s_suppkey").cast("bigint").alias("s_suppkey"), "s_name", F.col("s_acctbal").cast("double").alias("s_acctbal"))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 0")
def s12_database_table(spark, sf_dir):
    """Customers in a database, appended and read over JDBC; the condition is the database's to check.

    The database is the one that comes with Spark, in the memory of a local
    master; on a cluster a ``Database`` names a server.
    """
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("the embedded database is within the driver; name a server on a cluster")
    base = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    found = tables.Database(f"jdbc:derby:memory:customers{uuid.uuid4().hex};create=true", "customers", base)
    found.write(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal").coalesce(2))
    read = found.query(spark, 'SELECT * FROM customers WHERE "c_acctbal" > 0')
    return read.select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name", "c_acctbal")


@query("SELECT event_type AS ticker, strftime(ts, '%Y-%m-%d')::DATE AS date, count(*) AS n FROM events GROUP BY ALL")
def s7_csv_to_lake(spark, sf_dir):
    """Events written as compressed CSV in a folder per day, then taken into a lake partitioned by date."""
    source, target = scratch(spark, "csv"), scratch(spark, "lake")
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("ticker"), "value", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    events.repartition("day").write.option("header", True).option("compression", "gzip").partitionBy("day").csv(source)
    taken = lake.csv_to_lake(spark, source, target, schema="ticker string, value double")
    return taken.groupBy("ticker", "date").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s9_copy_table(spark, sf_dir):
    first, second = tables.Files(scratch(spark, "copy"), "csv", {"inferSchema": False}), tables.Files(scratch(spark, "copy"), "parquet")
    tables.copy_table(spark, tables.Files(f"{sf_dir}/nation.parquet"), first)
    tables.copy_table(spark, first, second)
    return second.read(spark).select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))


@query("SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def s13_run_sql(spark, sf_dir):
    views = {n: table(spark, sf_dir, n) for n in ("customer", "nation")}
    return tables.run_sql(spark, "SELECT n_name, count(*) AS customers FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name", views)


# -- mixtures

_FOLD = "(('0x' || substr(md5('42:' || event_id), 1, 8))::UBIGINT % 5)::INTEGER"


@query(f"SELECT event_id, {_FOLD} AS fold FROM events")
def m1_folds(spark, sf_dir):
    return mixture.folds(table(spark, sf_dir, "events").select("event_id"), "event_id", 5)


def mixed(spark, sf_dir) -> DataFrame:
    """Two normal components for each event, from its columns."""
    df = mixture.folds(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), "event_id", 5)
    u = (F.col("user_id") % 10).cast("double")
    return df.withColumns({"logits": F.array(u / 10, F.lit(0.5)), "means": F.array(u, 50 - u), "scales": F.array(10 + u, F.lit(20.0))})


MIXED = f"""WITH p AS (SELECT event_id, user_id, value, {_FOLD} AS fold, (user_id % 10)::DOUBLE AS u FROM events),
w AS (SELECT *, exp(u / 10) / (exp(u / 10) + exp(0.5)) AS w1, u AS m1, 50 - u AS m2, 10 + u AS s1, 20.0 AS s2 FROM p),
z AS (SELECT *, ln(w1) - pow((value - m1) / s1, 2) / 2 - ln(s1) - ln(2 * pi()) / 2 AS la, ln(1 - w1) - pow((value - m2) / s2, 2) / 2 - ln(s2) - ln(2 * pi()) / 2 AS lb FROM w),
q AS (SELECT *, w1 * m1 + (1 - w1) * m2 AS pred, greatest(la, lb) + ln(1 + exp(-abs(la - lb))) AS log_prob FROM z) """


def with_likelihood(spark, sf_dir) -> DataFrame:
    df = mixed(spark, sf_dir)
    c = F.col
    return df.withColumns({"pred": mixture.mixture_mean(c("logits"), c("means")), "log_prob": mixture.mixture_log_prob(c("value"), c("logits"), c("means"), c("scales"))})


@query(MIXED + "SELECT event_id, round(pred, 5) AS pred, round(log_prob, 5) AS log_prob FROM q")
def x13_mixture(spark, sf_dir):
    return rounded(with_likelihood(spark, sf_dir).select("event_id", "pred", "log_prob"), 5)


@query(MIXED + "SELECT fold, round(avg(abs(value - pred)), 5) AS mae, round(-avg(log_prob), 5) AS nll FROM q GROUP BY fold")
def a9_fold_metrics(spark, sf_dir):
    return rounded(mixture.fold_metrics(with_likelihood(spark, sf_dir), "value", "pred", "log_prob"), 5)


@query(MIXED + "SELECT user_id, round(avg(pred), 5) AS pred, round(avg(u / 10), 5) AS logit_1, round(avg(m2), 5) AS mean_2 FROM q GROUP BY user_id")
def a10_ensemble(spark, sf_dir):
    """The events of a user stand for its models."""
    out = mixture.ensemble(with_likelihood(spark, sf_dir), "user_id")
    return rounded(out.select("user_id", "pred", F.col("logits")[0].alias("logit_1"), F.col("means")[1].alias("mean_2")), 5)


def labelled(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"), F.col("label").cast("double").alias("y"))


def _shape(df: DataFrame, family: str) -> mixture.Shape:
    return mixture.Shape(len(df.select("features").first()[0]), 8, 2, family)


HIDDEN, COMPONENTS = 3, 2


def _ruled(features: int, family: str, models: int = 1) -> mixture.Fitted:
    """Models whose parameters follow a rule that SQL can repeat: weight (i, c) of layer n of model j is sin(7n + 5j + 3i + c) / 8."""
    shape = mixture.Shape(features, HIDDEN, COMPONENTS, family)
    thetas = []
    for j in range(models):
        layers = [np.sin(7 * n + 5 * j + 3 * np.arange(a + 1)[:, None] + np.arange(b)) / 8 for n, (a, b) in enumerate(shape.layers().values())]
        thetas.append(np.concatenate([x.reshape(-1) for x in layers]))
    return mixture.Fitted(shape, thetas)


def _sql_mixture(family: str, model: int = 0) -> str:
    """CTEs that end in ``p``: vec_id, y, w1, w2, m1, m2 (s1, s2), pred and log_prob for the rows of ``f`` (vec_id, y, x)."""
    weight = lambda n, i, c: f"{float(np.sin(7 * n + 5 * model + 3 * i + c) / 8)!r}::DOUBLE"
    first = lambda c: f"list_dot_product(x, list_transform(range(64), lambda i: sin({5 * model + c} + 3 * i) / 8)) + {weight(0, 64, c)}"
    plain = lambda n, names, c: " + ".join([*(f"{x} * {weight(n, i, c)}" for i, x in enumerate(names)), weight(n, len(names), c)])
    names = lambda n: [f"h{n}{c}" for c in range(HIDDEN)]
    ctes = ["l1 AS (SELECT vec_id, y, " + ", ".join(f"{first(c)} AS h1{c}" for c in range(HIDDEN)) + " FROM f)"]
    for n in (1, 2):
        ctes.append(f"l{n + 1} AS (SELECT vec_id, y, " + ", ".join(f"{plain(n, names(n), c)} AS h{n + 1}{c}" for c in range(HIDDEN)) + f" FROM l{n})")
    ctes.append("z AS (SELECT vec_id, y, " + ", ".join(f"tanh(h3{c}) AS z{c}" for c in range(HIDDEN)) + " FROM l3)")
    soft = lambda x: f"(greatest({x}, 0) + ln(1 + exp(-abs({x}))) + 1e-6)"
    heads = ["logits", "means"] + (["scales"] if family == "normal" else [])
    raw = {(h, c): plain(3 + n, [f"z{i}" for i in range(HIDDEN)], c) for n, h in enumerate(heads) for c in range(COMPONENTS)}
    out = [f"{raw['logits', c]} AS a{c + 1}" for c in range(COMPONENTS)]
    out += [f"{raw['means', c] if family == 'normal' else soft('(' + raw['means', c] + ')')} AS m{c + 1}" for c in range(COMPONENTS)]
    if family == "normal":
        out += [f"{soft('(' + raw['scales', c] + ')')} AS s{c + 1}" for c in range(COMPONENTS)]
    ctes.append(f"r AS (SELECT vec_id, y, {', '.join(out)} FROM z)")
    ctes.append("w AS (SELECT *, 1 / (1 + exp(a2 - a1)) AS w1, 1 / (1 + exp(a1 - a2)) AS w2 FROM r)")
    if family == "normal":
        part = lambda c: f"ln(w{c}) - pow((y - m{c}) / s{c}, 2) / 2 - ln(s{c}) - ln(2 * pi()) / 2"
    else:
        part = lambda c: f"ln(w{c}) + y * ln(m{c}) - m{c} - lgamma(y + 1)"
    ctes.append(f"e AS (SELECT *, {part(1)} AS la, {part(2)} AS lb FROM w)")
    ctes.append("p AS (SELECT *, w1 * m1 + w2 * m2 AS pred, greatest(la, lb) + ln(1 + exp(-abs(la - lb))) AS log_prob FROM e)")
    return ", ".join(ctes) + " "


_VECTORS = "WITH f AS (SELECT vec_id, label::DOUBLE AS y, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings), "
_SHOWN = "SELECT vec_id, round(a1, 5) + 0.0 AS logit_1, round(m1, 5) + 0.0 AS mean_1, round(m2, 5) + 0.0 AS mean_2, round(pred, 5) + 0.0 AS pred FROM p"


def _parameters_of(df: DataFrame) -> DataFrame:
    return rounded(df.select("vec_id", F.col("logits")[0].alias("logit_1"), F.col("means")[0].alias("mean_1"), F.col("means")[1].alias("mean_2"), "pred"), 5)


@query(_VECTORS + _sql_mixture("normal") + _SHOWN)
def m2_normal_parameters(spark, sf_dir):
    return _parameters_of(mixture.scored(labelled(spark, sf_dir), _ruled(64, "normal")))


@query(_VECTORS + _sql_mixture("poisson") + _SHOWN)
def m3_poisson_parameters(spark, sf_dir):
    return _parameters_of(mixture.scored(labelled(spark, sf_dir), _ruled(64, "poisson")))


@query(_VECTORS + _sql_mixture("normal") + "SELECT vec_id, round(pred, 5) + 0.0 AS pred, round(log_prob, 5) + 0.0 AS log_prob FROM p")
def m6_predictions(spark, sf_dir):
    """Predictions and likelihoods of a model that was saved and loaded."""
    path = scratch(spark, "model")
    mixture.save(spark, _ruled(64, "normal"), path)
    fitted = mixture.load(spark, path)
    found = mixture.log_prob(mixture.scored(labelled(spark, sf_dir), fitted), fitted.shape)
    return rounded(found.select("vec_id", "pred", "log_prob"), 5)


@query(f"SELECT layer, i, c, round(value, 9) + 0.0 AS value FROM (VALUES {', '.join(f'({n}, {name!r}, {a}, {b})' for n, (name, (a, b)) in enumerate(mixture.Shape(64, HIDDEN, COMPONENTS).layers().items()))}) l(n, layer, a, b), LATERAL (SELECT unnest(range(a + 1)) AS i), LATERAL (SELECT unnest(range(b)) AS c), LATERAL (SELECT sin(7 * n + 3 * i + c) / 8 AS value) WHERE EXISTS (SELECT 1 FROM embeddings)")
def s15_saved_model(spark, sf_dir):
    """The parameters of a model as a table, after saving and loading it."""
    path = scratch(spark, "model")
    mixture.save(spark, _ruled(len(labelled(spark, sf_dir).first().features), "normal"), path)
    found = mixture.parameters(spark, mixture.load(spark, path))
    return found.select("layer", F.col("row").cast("bigint").alias("i"), F.col("col").cast("bigint").alias("c"), (F.round("value", 9) + 0.0).alias("value"))


MODELS = 3
_EACH = "".join(f", t{j} AS (WITH {_sql_mixture('normal', j)} SELECT {j} AS model, * FROM p)" for j in range(MODELS))
_MODELS = _VECTORS.rstrip(", ") + _EACH + f", t AS ({' UNION ALL '.join(f'SELECT * FROM t{j}' for j in range(MODELS))}) "
_VECTOR_FOLD = f"(('0x' || substr(md5('42:' || vec_id), 1, 8))::UBIGINT % {MODELS})"


@query(_MODELS + f"SELECT model AS fold, round(avg(abs(y - pred)), 5) AS mae, round(-avg(log_prob), 5) AS nll FROM t WHERE model = {_VECTOR_FOLD} GROUP BY model")
def m7_fold_errors(spark, sf_dir):
    """The errors of given models of a k-fold evaluation, each on its own fold."""
    fitted = _ruled(64, "normal", MODELS)
    own = mixture.scored(mixture.folds(labelled(spark, sf_dir), "vec_id", MODELS), fitted).where("model = fold")
    return rounded(mixture.fold_metrics(mixture.log_prob(own, fitted.shape), "y", "pred", "log_prob"), 5)


@query(_MODELS + "SELECT vec_id, round(avg(pred), 5) + 0.0 AS pred, round(avg(a1), 5) + 0.0 AS logit_1, round(avg(m2), 5) + 0.0 AS mean_2 FROM t GROUP BY vec_id")
def m8_ensemble_scores(spark, sf_dir):
    out = mixture.ensemble_scores(labelled(spark, sf_dir), _ruled(64, "normal", MODELS), "vec_id")
    return rounded(out.select("vec_id", "pred", F.col("logits")[0].alias("logit_1"), F.col("means")[1].alias("mean_2")), 5)


@query()
def m4_fit_normal(spark, sf_dir):
    df = labelled(spark, sf_dir)
    fitted = mixture.fit(df, _shape(df, "normal"), epochs=10, batch=32)
    return mixture.log_prob(mixture.scored(df, fitted), fitted.shape).select("vec_id", "pred", "log_prob")


@query("SELECT round(avg(label::DOUBLE), 2) AS mean, round(stddev_pop(label::DOUBLE), 2) AS scale FROM embeddings")
def m4_fit_moments(spark, sf_dir):
    """One component without features: the fit must arrive at the mean and the deviation of the target."""
    df = labelled(spark, sf_dir).select("vec_id", F.array(F.lit(0.0)).alias("features"), "y")
    fitted = mixture.fit(df, mixture.Shape(1, 2, 1), epochs=4, batch=mixture.ROWS, sweeps=400, rate=0.05, anneal=True)
    return rounded(mixture.scored(df, fitted).select(F.col("means")[0].alias("mean"), F.col("scales")[0].alias("scale")), 2).distinct()


@query()
def m3_fit_poisson(spark, sf_dir):
    df = labelled(spark, sf_dir)
    fitted = mixture.fit(df, _shape(df, "poisson"), epochs=10, batch=32)
    return mixture.log_prob(mixture.scored(df, fitted), fitted.shape).select("vec_id", "pred", "log_prob")


@query()
def m7_kfold(spark, sf_dir):
    df = labelled(spark, sf_dir)
    return mixture.kfold(df, _shape(df, "normal"), "vec_id")[1]


@query()
def m8_kfold_predictions(spark, sf_dir):
    df = labelled(spark, sf_dir)
    split = mixture.folds(df, "vec_id", 5)
    fitted = mixture.fit(split, _shape(df, "normal"), fold="fold", models=5, epochs=20, patience=5)
    return mixture.ensemble_scores(df, fitted, "vec_id").select("vec_id", "pred", F.size("means").alias("components"))


# -- the flagship


def flagship(spark, sf_dir) -> DataFrame:
    """Events, one per key, with rolling statistics, as daily bars of each type."""
    steps = Pipeline(
        [
            lambda t: t.deduped("first"),
            lambda t: stats.rolling_stats(t, ["event_type"], ["value"], "e", 5, day_block()),
        ]
    )
    events = KeyedTable(table(spark, sf_dir, "events"), ("event_id",), ("event_id", "event_type", "user_id"), ("value",), ("ts", "event_id"))
    rolled = steps.execute(events).df
    mean = F.avg("e_rolling_5_value_mean").alias("rolling_mean")
    out = bars.ohlcv(rolled, ["event_type", F.date_trunc("day", "ts").alias("day")], "ts", **dict.fromkeys(("open", "high", "low", "close", "volume"), "value"), extra=[mean])
    return rounded(out)


query("""WITH e AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts) = 1),
r AS (SELECT *, CASE WHEN count(value) OVER w = 5 THEN avg(value) OVER w END AS m FROM e WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS day, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, round(sum(value), 6) AS volume, round(avg(m), 6) AS rolling_mean
FROM r GROUP BY event_type, date_trunc('day', ts)""")(flagship)
