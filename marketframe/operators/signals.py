"""Signals, positions and returns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketframe.operators.blocks import haloed, last_values, own, running_sums
from marketframe.operators.scan import automaton


def in_range(df: DataFrame, col: str, low: float, high: float, to: str) -> DataFrame:
    """Whether ``low <= col <= high``."""
    return df.withColumn(to, F.col(col).between(low, high))


def fired_at(df: DataFrame, fires: dict[str, tuple[str, object]], ts: str) -> DataFrame:
    """For each new column -> (signal column, value): the time of rows whose signal has that value, else null."""
    return df.withColumns({to: F.when(F.col(c) == value, F.col(ts)) for to, (c, value) in fires.items()})


def forward_filled(df: DataFrame, cols: Sequence[str], groups: Sequence[str], order: Sequence[str], block: Column | None = None) -> DataFrame:
    """The last value up to each row in place of nulls."""
    found = last_values(df, groups, order, block, {f"__last{i}": c for i, c in enumerate(cols)}, own_too=True)
    return found.withColumns({c: F.col(f"__last{i}") for i, c in enumerate(cols)}).drop(*[f"__last{i}" for i in range(len(cols))])


def recent(df: DataFrame, ts: str, fired: dict[str, str], within: str = "10 MINUTES") -> DataFrame:
    """For each new column -> time column: whether that time is at most ``within`` before the row's; null if it never was."""
    return df.withColumns({to: F.col(ts) - F.col(c) <= F.expr(f"INTERVAL {within}") for to, c in fired.items()})


def both(df: DataFrame, combined: dict[str, tuple[str, str]]) -> DataFrame:
    """For each new column -> (a, b): a AND b, with three values."""
    return df.withColumns({to: F.col(a) & F.col(b) for to, (a, b) in combined.items()})


def positions(
    df: DataFrame, long_in: str, long_out: str, short_in: str, short_out: str, groups: Sequence[str], order: Sequence[str], block: Column, to: str = "position"
) -> DataFrame:
    """1 while long, -1 while short, 0 while flat.

    A flat position goes long on its entry signal, else short on its; then, in
    the same row, an exit signal of the side held makes it flat. Null is false.
    """
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    # states: 0 flat, 1 long, 2 short
    from_long, from_short = F.when(on(long_out), 0).otherwise(1), F.when(on(short_out), 0).otherwise(2)
    from_flat = F.when(on(long_in), from_long).when(on(short_in), from_short).otherwise(0)
    walked = automaton(df, groups, order, block, F.array(from_flat, from_long, from_short), 3, 0, "__side")
    return walked.withColumn(to, F.when(F.col("__side") == 1, 1).when(F.col("__side") == 2, -1).otherwise(0)).drop("__side")


def pct_change(df: DataFrame, col: str, groups: Sequence[str], order: Sequence[str], to: str, block: Column | None = None) -> DataFrame:
    """The value over the last one before it, less 1; null for a null value."""
    found = last_values(df, groups, order, block, {"__last": col}, own_too=False)
    return found.withColumn(to, F.try_divide(F.col(col), F.col("__last")) - 1).drop("__last")


def strategy_returns(
    df: DataFrame, returns: str, position: str, groups: Sequence[str], order: Sequence[str], to: str = "strategy_return", total: str = "cumulative_return",
    lag_position: bool = False, block: Column | None = None,
) -> DataFrame:
    """Return times position, and its running sum, null where the product is.

    ``lag_position`` takes the position of the row before, which was held at the
    start of the period; otherwise the row's own.
    """
    held = F.col(position)
    if lag_position:
        found, w = haloed(df, groups, order, block, [position], 1)
        df, held = own(found.withColumn("__held", F.lag(position, 1).over(w))), F.col("__held")
    out = running_sums(df.withColumn(to, F.col(returns) * held).drop("__held"), groups, order, block, {total: to})
    return out.withColumn(total, F.when(F.col(to).isNotNull(), F.col(total)))
