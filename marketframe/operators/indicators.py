"""Technical indicators of ordered series.

Each takes the columns that separate series (``groups``) and those that order
one (``order``, unique within a series). ``block`` cuts series in parts along
their order, each worked on in a task of its own; see ``blocks`` and ``scan``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketframe.operators.blocks import haloed, own
from marketframe.operators.scan import ewm_means


def changes(df: DataFrame, col: str, groups: Sequence[str], order: Sequence[str], block: Column | None = None) -> DataFrame:
    """``delta``, ``gain`` and ``loss`` against the row before; the first row has none, gain and loss 0."""
    found, w = haloed(df, groups, order, block, [col], 1)
    out = own(found.withColumn("delta", F.col(col) - F.lag(col, 1).over(w)))
    return out.withColumns({"gain": F.when(F.col("delta") > 0, F.col("delta")).otherwise(0.0), "loss": F.when(F.col("delta") < 0, -F.col("delta")).otherwise(0.0)})


def rsi(df: DataFrame, col: str, window: int, groups: Sequence[str], order: Sequence[str], to: str = "RSI", block: Column | None = None) -> DataFrame:
    """Relative strength index by simple means of gains and losses over ``window`` rows.

    Null for the first ``window - 1`` rows and where nothing moved; 100 where nothing fell.
    """
    found, w = haloed(df, groups, order, block, [col], window)
    delta = F.col(col) - F.lag(col, 1).over(w)
    moved = found.withColumn("__gain", F.when(delta > 0, delta).otherwise(0.0)).withColumn("__loss", F.when(delta < 0, -delta).otherwise(0.0))
    recent = w.rowsBetween(-(window - 1), Window.currentRow)
    gain, loss = F.avg("__gain").over(recent), F.avg("__loss").over(recent)
    strength = 100 - F.try_divide(F.lit(100.0), 1 + F.try_divide(gain, loss))
    value = F.when(loss > 0, strength).when(gain > 0, 100.0)
    return own(moved.withColumn(to, F.when(F.count(F.lit(1)).over(recent) == window, value)), "__gain", "__loss")


def ewm_mean(df: DataFrame, col: str, alpha: float, groups: Sequence[str], order: Sequence[str], block: Column, to: str) -> DataFrame:
    """Exponentially weighted mean; see ``scan.ewm_means``."""
    return ewm_means(df, groups, order, block, {to: (col, alpha)})


def macd(
    df: DataFrame, col: str, fast: int, slow: int, signal: int, groups: Sequence[str], order: Sequence[str], block: Column, signal_to: str = "macd_signal"
) -> DataFrame:
    """``ema_fast``, ``ema_slow``, their difference ``MACD`` and its mean, with alphas 2 / (period + 1)."""
    alpha = lambda period: 2 / (period + 1)
    both = ewm_means(df, groups, order, block, {"ema_fast": (col, alpha(fast)), "ema_slow": (col, alpha(slow))})
    both = both.withColumn("MACD", F.col("ema_fast") - F.col("ema_slow"))
    return ewm_means(both, groups, order, block, {signal_to: ("MACD", alpha(signal))})


def crossover(df: DataFrame, a: str, b: str | float, groups: Sequence[str], order: Sequence[str], to: str, block: Column | None = None) -> DataFrame:
    """1 where ``a`` comes to lie above ``b`` (a column or a number), -1 where below, else 0."""
    named = isinstance(b, str)
    found, w = haloed(df, groups, order, block, list(dict.fromkeys([a, b] if named else [a])), 1)
    other = F.col(b) if named else F.lit(float(b))
    last_a, last_b = F.lag(a, 1).over(w), F.lag(b, 1).over(w) if named else other
    up = (last_a <= last_b) & (F.col(a) > other)
    down = (last_a >= last_b) & (F.col(a) < other)
    return own(found.withColumn(to, F.when(up, 1).when(down, -1).otherwise(0)))
