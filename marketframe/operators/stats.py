"""Grouped, cumulative, shifted and rolling statistics of keyed tables.

All columns of a call share one shuffle of the rows, whatever their number.
Frames count rows, not values. Ordered statistics take ``block``, an expression
that cuts a series in parts along its order (its day, say), which are worked on
in tasks of their own; without it a series is one task. Results are the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketframe.functions.columns import require, stat_name, union
from marketframe.keyed import KeyedTable
from marketframe.operators.blocks import haloed, own, running_moments


def _order(table: KeyedTable, groups: Sequence[str]) -> list[str]:
    """The columns that order a series: the table's, less what the groups fix."""
    if not groups:
        raise ValueError("an ordered statistic needs groups: without them all rows would meet in one task")
    return [c for c in table.order_by if c not in groups] or list(groups)


def grouped_sums(table: KeyedTable, groups: Sequence[str], cols: Sequence[str]) -> KeyedTable:
    """Sums by group; a group without any value sums to 0. The groups become key and dimensions."""
    require(table.df.columns, [*groups, *cols])
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast(_sum_type(table.df, c)).alias(c)
    return KeyedTable(table.df.groupBy(*groups).agg(*map(zero, cols)), tuple(groups), tuple(groups))


def _sum_type(df: DataFrame, col: str) -> str:
    kind = df.schema[col].dataType.typeName()
    return "double" if kind in ("double", "float") else "bigint" if kind in ("byte", "short", "integer", "long") else df.schema[col].dataType.simpleString()


def summary_stats(table: KeyedTable, groups: Sequence[str], cols: Sequence[str], attr: str, affix: str = "") -> KeyedTable:
    """Mean and sample deviation by group, and the number of values of the first column."""
    require(table.df.columns, [*groups, *cols])
    out = [x for c in cols for x in (F.avg(c).alias(stat_name(attr, c, "mean", affix)), F.stddev_samp(c).alias(stat_name(attr, c, "std", affix)))]
    out.append(F.count(cols[0]).alias(stat_name(attr, "count", "n", affix)))
    return KeyedTable(table.df.groupBy(*groups).agg(*out), tuple(groups), tuple(groups))


def shifted(table: KeyedTable, groups: Sequence[str], cols: Sequence[str], n: int = 1, block: Column | None = None) -> KeyedTable:
    """The values 1 to ``n`` rows before, as ``shifted_col_i``."""
    require(table.df.columns, [*groups, *cols])
    found, w = haloed(table.df, groups, _order(table, groups), block, cols, n)
    return table.with_df(own(found.withColumns({f"shifted_{c}_{i}": F.lag(c, i).over(w) for c in cols for i in range(1, n + 1)})))


def _cumulative(df: DataFrame, table: KeyedTable, groups: Sequence[str], names: Sequence[str], attr: str, affix: str, block: Column | None) -> KeyedTable:
    found = running_moments(df, groups, _order(table, groups), block, {f"__m{i}": c for i, c in enumerate(names)})
    out = []
    for i, name in enumerate(names):
        for part in ("mean", "std"):
            out.append(F.when(F.col(name).isNotNull(), F.col(f"__m{i}")[part]).alias(stat_name(attr, name, f"cuml_{part}", affix)))
    out.append(F.col("__m0")["n"].alias(stat_name(attr, "count", "cuml_n", affix)))
    return KeyedTable(found.select(*table.primary_key, *out), table.primary_key, table.primary_key)


def cumulative_stats(table: KeyedTable, groups: Sequence[str], cols: Sequence[str], attr: str, affix: str = "", block: Column | None = None) -> KeyedTable:
    """Running mean, sample deviation and count up to each row: the key and the statistics.

    Where the value is null so are mean and deviation; the count carries on.
    """
    require(table.df.columns, [*groups, *cols])
    return _cumulative(table.df, table, groups, cols, attr, affix, block)


def offset_stats(table: KeyedTable, groups: Sequence[str], cols: Sequence[str], attr: str, affix: str = "", block: Column | None = None) -> KeyedTable:
    """As ``cumulative_stats``, of the rows before each row, under the names of the shifted columns."""
    lagged = shifted(table, groups, cols, 1, block).df
    return _cumulative(lagged, table, groups, [f"shifted_{c}_1" for c in cols], attr, affix, block)


def rolling_names(cols: Sequence[str], attr: str, window: int) -> dict[str, tuple[str, str]]:
    return {c: (stat_name(attr, c, "mean", f"rolling_{window}"), stat_name(attr, c, "std", f"rolling_{window}")) for c in cols}


def rolling_stats(table: KeyedTable, over: Sequence[str], cols: Sequence[str], attr: str, window: int, block: Column | None = None) -> KeyedTable:
    """The table with mean and sample deviation of the ``window`` rows before each row; null until all have values."""
    require(table.df.columns, [*over, *cols])
    found, w = haloed(table.df, over, _order(table, over), block, cols, window)
    before, more = w.rowsBetween(-window, -1), {}
    for c, (mean, std) in rolling_names(cols, attr, window).items():
        full = F.count(c).over(before) == window
        more |= {mean: F.when(full, F.avg(c).over(before)), std: F.when(full, F.stddev_samp(c).over(before))}
    return table.with_df(own(found.withColumns(more)))


def grouped_rolling_stats(table: KeyedTable, over: Sequence[str], groups: Sequence[str], cols: Sequence[str], attr: str, window: int, block: Column | None = None) -> KeyedTable:
    """By group, the mean of the rolling means and the deviation of the mean of rolling deviations.

    The rolling statistics are added if they aren't there.
    """
    names = rolling_names(cols, attr, window)
    have = all(n in table.df.columns for pair in names.values() for n in pair)
    df = (table if have else rolling_stats(table, over, cols, attr, window, block)).df
    out = []
    for mean, std in names.values():
        out.append(F.avg(mean).alias(f"group_{mean}"))
        out.append(F.sqrt(F.try_divide(F.avg(F.col(std) * F.col(std)), F.count(std))).alias(f"group_{std}"))
    return KeyedTable(df.groupBy(*groups).agg(*out), tuple(groups), tuple(groups))


def fill_current_season(table: KeyedTable, cols: Sequence[str], attr: str) -> KeyedTable:
    """Null statistics of the current season from those of the previous one."""
    pairs = {f"{attr}_curr_ssn_{c}_{s}": f"{attr}_prev_ssn_{c}_{s}" for c in cols for s in ("mean", "std")}
    require(table.df.columns, union(pairs, pairs.values()))
    return table.with_df(table.df.withColumns({a: F.coalesce(a, b) for a, b in pairs.items()}))
