"""Option chains: tickers, times, the stock beside each option, volatilities, Greeks and hedges."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketframe.functions.dates import from_nanos
from marketframe.functions.math import norm_cdf_array, norm_pdf, with_norm_cdf

NANOS_PER_DAY = 86_400_000_000_000
DAYS_PER_YEAR = 365


def parse_tickers(df: DataFrame, ticker: str = "ticker", strict: bool = True) -> DataFrame:
    """``underlying``, ``expiration_date``, ``opt_type`` (c or p) and ``strike_price`` from option tickers.

    A ticker is ``O:``, the underlying, YYMMDD, C or P, and the strike times
    1000 in eight digits, read from the right. Years are 20yy. A malformed one
    is an error, or nulls if not ``strict``.

    The ticker passes through a generator of one row, which the optimiser doesn't
    look through, so what it is made of is computed once and not for each part.
    """
    names = df.columns
    made = F.inline(F.array(F.struct(F.col(ticker).alias(ticker))))
    df = df.select(*[c for c in names if c != ticker], made).select(*names)
    t, n = F.col(ticker), F.length(ticker)
    date = F.concat(F.lit("20"), F.substr(t, n - 14, F.lit(6)))
    underlying, kind, strike = F.substr(t, F.lit(3), n - 17), F.lower(F.substr(t, n - 8, F.lit(1))), F.right(t, F.lit(8))
    good = t.rlike(r"^O:.+\d{6}[CP]\d{8}$")
    parts = {
        "underlying": underlying,
        "expiration_date": F.try_to_date(date, "yyyyMMdd") if not strict else F.to_date(date, "yyyyMMdd"),
        "opt_type": kind,
        "strike_price": (strike.try_cast("double") if not strict else strike.cast("double")) / 1000,
    }
    if strict:
        failed = F.raise_error(F.concat(F.lit("malformed option ticker: "), t))
        parts["underlying"] = F.when(t.isNull() | good, underlying).otherwise(failed)
        return df.withColumns(parts)
    return df.withColumns({k: F.when(good, v) for k, v in parts.items()})


def add_times(df: DataFrame, window_start: str = "window_start", expiration: str = "expiration_date") -> DataFrame:
    """``window_start_dt``, ``expiration_dt``, ``DTE`` in days with their fraction, and ``t`` in years."""
    dte = (F.unix_date(expiration).cast("bigint") * NANOS_PER_DAY - F.col(window_start)) / float(NANOS_PER_DAY)
    return df.withColumns(
        {
            "window_start_dt": from_nanos(F.col(window_start)),
            "expiration_dt": F.col(expiration).cast("timestamp"),
            "DTE": dte,
            "t": dte / DAYS_PER_YEAR,
        }
    )


STOCK_COLUMNS = ("volume", "open", "close", "high", "low", "transactions")


def join_stocks(options: DataFrame, stocks: DataFrame) -> DataFrame:
    """Options with the columns of their underlying at the same time, as ``stock_*``; null without a match.

    The join key is the raw nanosecond time. Spark broadcasts the stock side if
    it is measured to be small, else both sides are shuffled, unless both are
    tables in buckets by underlying (``ticker``) and time (``tables.bucketed``).
    """
    beside = stocks.select(F.col("ticker").alias("underlying"), "window_start", *[F.col(c).alias(f"stock_{c}") for c in STOCK_COLUMNS])
    return options.join(beside, ["underlying", "window_start"], "left")


def moneyness(df: DataFrame, spot: str = "stock_close", strike: str = "strike_price") -> DataFrame:
    return df.withColumn("moneyness", F.try_divide(spot, strike))


def _with_terms(df: DataFrame, spot: str, strike: str, t: str, rate: float, sigma: str) -> DataFrame:
    """Columns that price and Greeks share; null unless spot, strike, time and volatility are positive.

    The inputs pass through a generator of one row, which the optimiser doesn't
    look through: their expressions would be repeated wherever a term uses them,
    and the generated code would grow too long for the virtual machine to compile.
    """
    inputs = F.struct(*[F.col(c).cast("double").alias(n) for n, c in zip(INPUTS, (spot, strike, t, sigma), strict=True)])
    df = df.select("*", F.inline(F.array(inputs)))
    s, k, years, v = map(F.col, INPUTS)
    ok = (s > 0) & (k > 0) & (years > 0) & (v > 0)
    df = df.withColumn("__rt", F.when(ok, F.sqrt(years)))
    df = df.withColumn("__d1", (F.log(s / k) + (rate + v * v / 2) * years) / (v * F.col("__rt")))
    df = df.withColumn("__d2", F.col("__d1") - v * F.col("__rt"))
    df = with_norm_cdf(df, {"__n1": "__d1", "__n2": "__d2"})
    # a when() without a match is null, but the distribution function of null takes its last branch
    return df.withColumn("__k", F.when(F.col("__rt").isNotNull(), k * F.exp(-rate * years)))


INPUTS = ("__s", "__x", "__t", "__v")
TERMS = (*INPUTS, "__rt", "__d1", "__d2", "__n1", "__n2", "__k")


def add_price(df: DataFrame, rate: float = 0.01, spot: str = "stock_close", strike: str = "strike_price", t: str = "t", sigma: str = "implied_vol", kind: str = "opt_type", to: str = "price") -> DataFrame:
    """Black-Scholes prices; null unless spot, strike, time and volatility are positive."""
    n1, n2, k, s = F.col("__n1"), F.col("__n2"), F.col("__k"), F.col("__s")
    call, put = s * n1 - k * n2, k * (1 - n2) - s * (1 - n1)
    df = _with_terms(df, spot, strike, t, rate, sigma)
    return df.withColumn(to, F.when(F.col(kind) == "c", call).when(F.col(kind) == "p", put)).drop(*TERMS)


GREEKS = ("delta", "gamma", "theta", "vega")


def add_greeks(df: DataFrame, rate: float = 0.01, spot: str = "stock_close", strike: str = "strike_price", t: str = "t", sigma: str = "implied_vol", kind: str = "opt_type") -> DataFrame:
    """delta, gamma, theta (a calendar day) and vega (a volatility point); null where the price is."""
    df = _with_terms(df, spot, strike, t, rate, sigma)
    n1, n2, root, s, v = F.col("__n1"), F.col("__n2"), F.col("__rt"), F.col("__s"), F.col("__v")
    call, carry, decay, pdf = F.col(kind) == "c", rate * F.col("__k"), F.col("__decay"), F.col("__pdf")
    df = df.withColumn("__pdf", norm_pdf(F.col("__d1"))).withColumn("__decay", -s * pdf * v / (2 * root))
    known = {
        "delta": F.when(call, n1).otherwise(n1 - 1),
        "gamma": pdf / (s * v * root),
        "theta": F.when(call, decay - carry * n2).otherwise(decay + carry * (1 - n2)) / DAYS_PER_YEAR,
        "vega": s * pdf * root / 100,
    }
    valid = root.isNotNull() & F.col(kind).isin("c", "p")
    return df.withColumns({n: F.when(valid, x) for n, x in known.items()}).drop("__pdf", "__decay", *TERMS)


def implied_vols(price_, s, k, t, r, call):
    """Volatilities that give the prices, as arrays; NaN outside the no-arbitrage bounds and for what isn't positive.

    Bisection on all rows at once narrows each to a bracket, Newton steps kept
    in the bracket finish. A row is done when its own steps end, whatever the
    rows beside it do.
    """
    import numpy as np

    out = np.full(len(price_), np.nan)
    with np.errstate(all="ignore"):
        discounted = k * np.exp(-r * t)
        low = np.where(call, np.maximum(s - discounted, 0), np.maximum(discounted - s, 0))
        high = np.where(call, s, discounted)
        ok = (s > 0) & (k > 0) & (t > 0) & (price_ > low) & (price_ < high)
    i = np.flatnonzero(ok)
    if not len(i):
        return out
    p, s, k, t, call, discounted = (x[i] for x in (price_, s, k, t, call, discounted))
    root, money = np.sqrt(t), np.log(s / k) + r * t

    def value(v, at):
        spread = v * root[at]
        d1 = money[at] / spread + spread / 2
        c = s[at] * norm_cdf_array(d1) - discounted[at] * norm_cdf_array(d1 - spread)
        return np.where(call[at], c, c - s[at] + discounted[at]), d1

    every = np.arange(len(i))
    a, b = np.full(len(i), 1e-6), np.full(len(i), 1.0)
    at = every
    for _ in range(12):  # widen until the price lies below
        at = at[value(b[at], at)[0] < p[at]]
        if not len(at):
            break
        b[at] *= 2
    v, at = (a + b) / 2, every
    for step in range(60):
        now, d1 = value(v[at], at)
        low, high = np.where(now < p[at], v[at], a[at]), np.where(now < p[at], b[at], v[at])
        a[at], b[at] = low, high
        slope = s[at] * root[at] * np.exp(-d1 * d1 / 2) / np.sqrt(2 * np.pi)
        with np.errstate(all="ignore"):
            newton = v[at] - (now - p[at]) / slope
        new = np.where((newton > low) & (newton < high) & (step >= 3), newton, (low + high) / 2)
        moved = np.abs(new - v[at]) >= 1e-12
        v[at] = new
        at = at[moved]
        if not len(at):
            break
    out[i] = v
    return out


def add_implied_vol(df: DataFrame, rate: float = 0.01, price: str = "close", spot: str = "stock_close", strike: str = "strike_price", t: str = "t", kind: str = "opt_type", to: str = "implied_vol") -> DataFrame:
    """``df`` with the volatility that inverts the Black-Scholes price, in Arrow batches; null where there is none."""

    def rows(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            of = lambda c, b=batch: b.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False)
            call, put = (pc.fill_null(pc.equal(batch.column(kind), one), False).to_numpy(zero_copy_only=False) for one in "cp")
            found = implied_vols(of(price), of(spot), of(strike), of(t), rate, call)
            found[~(call | put)] = np.nan
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, mask=np.isnan(found))], [*batch.schema.names, to])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(rows, f"{fields}, `{to}` double")


def option_metrics(df: DataFrame, rate: float = 0.01) -> DataFrame:
    """``moneyness``, ``implied_vol`` and the Greeks of a joined chain."""
    return add_greeks(add_implied_vol(moneyness(df), rate), rate)


def adjusted_vol(atm: Column, strike: Column, atm_strike: Column, skew: Column, kurtosis: Column) -> Column:
    """At-the-money volatility with skew and kurtosis by the ratio of strikes."""
    m = strike / atm_strike
    return atm + (m - 1) * skew + (m * m - 1) * kurtosis


def scenarios(legs: DataFrame, spots: DataFrame) -> DataFrame:
    """Each leg at each spot of a grid.

    The grid is a short list of prices, a parameter; its rows are counted, up to
    ``MAX_SPOTS``, before they are sent to every task.
    """
    grid = spots.select(F.col(spots.columns[0]).cast("double").alias(spots.columns[0]))
    if grid.limit(MAX_SPOTS + 1).count() > MAX_SPOTS:
        raise ValueError(f"a grid has at most {MAX_SPOTS} spots")
    return legs.crossJoin(F.broadcast(grid))


MAX_SPOTS = 10_000


def portfolio_greeks(legs: DataFrame, spots: DataFrame, portfolio: Sequence[str], rate: float = 0.01, quantity: str = "quantity", strike: str = "strike_price", t: str = "t", sigma: str = "implied_vol", kind: str = "opt_type") -> DataFrame:
    """Net Greeks, quantity times Greek over the legs, by portfolio and spot."""
    spot = spots.columns[0]
    each = add_greeks(scenarios(legs, spots), rate, spot, strike, t, sigma, kind)
    return each.groupBy(*portfolio, spot).agg(*[F.sum(F.col(quantity) * F.col(n)).alias(n) for n in GREEKS])


def hedge_weights(df: DataFrame, portfolio: Sequence[str], x1: str, x2: str, y: str) -> DataFrame:
    """``w1, w2`` that minimise the sum of (x1 w1 + x2 w2 + y)^2 by portfolio; null if the instruments are collinear.

    Five sums by group and Cramer's rule; nothing is gathered.
    """
    total = lambda a, b: F.sum(F.col(a) * F.col(b))
    s = df.groupBy(*portfolio).agg(total(x1, x1).alias("a"), total(x1, x2).alias("b"), total(x2, x2).alias("d"), total(x1, y).alias("e"), total(x2, y).alias("f"))
    det = F.col("a") * F.col("d") - F.col("b") * F.col("b")
    det = F.when(F.abs(det) > 1e-12 * F.col("a") * F.col("d"), det)
    return s.select(
        *portfolio,
        F.try_divide(F.col("b") * F.col("f") - F.col("d") * F.col("e"), det).alias("w1"),
        F.try_divide(F.col("b") * F.col("e") - F.col("a") * F.col("f"), det).alias("w2"),
    )
