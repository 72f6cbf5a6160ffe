"""Ordered statistics of series of any length, by blocks and what enters them.

A series is cut into blocks (of time, say) that grow with its order. What a block
needs of the rows before it is added to it as more rows: the last ``n`` of them,
wherever they stand (its halo), or one row with what has been summed up over the
blocks before (moments, sums, last values, which merge). Then plain windows work
within each block, and the added rows are dropped. So rows are shuffled once, by
series and block, one series is spread over as many tasks as it has blocks, and
only a few numbers a block meet along a series.

``block`` is an expression that never falls along ``order``; None is one block.
Null groups and null places in the order are like any other, nulls first.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Series and block of a row, and whether it was added to its block.
AT, ADDED = "__at", "__added"


def in_blocks(df: DataFrame, groups: Sequence[str], block: Column | None) -> DataFrame:
    """``df`` with the column ``AT``."""
    if not groups:
        raise ValueError("an ordered statistic needs groups: name the columns that separate series")
    at = block if block is not None else F.lit(0)
    return df.withColumn(AT, F.struct(*[F.col(g).alias(f"g{i}") for i, g in enumerate(groups)], at.alias("block")))


def _within(order: Sequence[str]):
    return Window.partitionBy(AT).orderBy(F.col(ADDED).desc(), *order)


def _along(groups: Sequence[str]):
    return Window.partitionBy(*[F.col(AT)[f"g{i}"] for i in range(len(groups))]).orderBy(F.col(AT)["block"])


def _before(along):
    return along.rowsBetween(Window.unboundedPreceding, -1)


def _so_far(order: Sequence[str], last: int = Window.currentRow):
    return _within(order).rowsBetween(Window.unboundedPreceding, last)


def _with(cut: DataFrame, more: DataFrame) -> DataFrame:
    """Rows and those added to their blocks."""
    return cut.withColumn(ADDED, F.lit(False)).unionByName(more.withColumn(ADDED, F.lit(True)), allowMissingColumns=True)


def own(df: DataFrame, *drop: str) -> DataFrame:
    """The rows that were there before, without the columns made on the way."""
    return df.where(~F.col(ADDED)).drop(AT, ADDED, *drop)


def _entered(cut: DataFrame, groups: Sequence[str], summary: dict[str, Column], state: Callable) -> DataFrame:
    """Rows, and for each block one with the ``state`` (window along the series' blocks -> columns) that enters it, from each block's ``summary``."""
    blocks = cut.groupBy(AT).agg(*[c.alias(n) for n, c in summary.items()])
    return _with(cut, blocks.select(AT, *[c.alias(n) for n, c in state(_along(groups)).items()]))


def running_sums(df: DataFrame, groups: Sequence[str], order: Sequence[str], block: Column | None, sums: dict[str, str]) -> DataFrame:
    """``df`` with running sums up to each row: new column -> column. A null value adds nothing."""
    names = [f"__s{i}" for i in range(len(sums))]
    kinds = [f.dataType for f in df.select(*[F.sum(c) for c in sums.values()]).schema]
    cut = in_blocks(df, groups, block).withColumns({x: F.col(c).cast(k) for x, c, k in zip(names, sums.values(), kinds, strict=True)})
    held = _entered(cut, groups, {x: F.sum(x) for x in names}, lambda w: {x: F.sum(x).over(_before(w)).cast(k) for x, k in zip(names, kinds, strict=True)})
    return own(held.withColumns({to: F.sum(x).over(_so_far(order)) for x, to in zip(names, sums, strict=True)}), *names)


def _place(order: Sequence[str]) -> Column:
    return F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])


def last_values(df: DataFrame, groups: Sequence[str], order: Sequence[str], block: Column | None, values: dict[str, str], own_too: bool) -> DataFrame:
    """``df`` with the last value that isn't null: new column -> column. ``own_too``: the row's own counts, else only rows before it."""
    names = [f"__s{i}" for i in range(len(values))]
    cut = in_blocks(df, groups, block).withColumns({x: F.col(c) for x, c in zip(names, values.values(), strict=True)})
    last = {x: F.max_by(x, F.when(F.col(x).isNotNull(), _place(order))) for x in names}
    held = _entered(cut, groups, last, lambda w: {x: F.last(x, ignorenulls=True).over(_before(w)) for x in names})
    frame = _so_far(order, Window.currentRow if own_too else -1)
    return own(held.withColumns({to: F.last(x, ignorenulls=True).over(frame) for x, to in zip(names, values, strict=True)}), *names)


def running_moments(df: DataFrame, groups: Sequence[str], order: Sequence[str], block: Column | None, moments: dict[str, str]) -> DataFrame:
    """``df`` with structs (n, mean, std) of the values up to each row: new column -> column.

    Counts, means and sums of squares about the mean merge block by block; the
    blocks' means are taken about the series' mean, so nothing cancels.
    """
    cut, n = in_blocks(df, groups, block), range(len(moments))
    square = lambda c: F.var_pop(c) * F.count(c)
    summary = {}
    for i, c in enumerate(moments.values()):
        summary |= {f"__n{i}": F.count(c), f"__m{i}": F.coalesce(F.avg(c), F.lit(0.0)), f"__q{i}": F.coalesce(square(c), F.lit(0.0))}

    def state(along) -> dict[str, Column]:
        out, before, whole = {}, _before(along), along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        for i in n:
            count, mean = F.col(f"__n{i}"), F.col(f"__m{i}")
            centre = F.coalesce(F.try_divide(F.sum(count * mean).over(whole), F.sum(count).over(whole)), F.lit(0.0))
            rows = F.coalesce(F.sum(count).over(before), F.lit(0))
            off = F.coalesce(F.try_divide(F.sum(count * (mean - centre)).over(before), rows), F.lit(0.0))
            spread = F.coalesce(F.sum(F.col(f"__q{i}") + count * (mean - centre) * (mean - centre)).over(before), F.lit(0.0))
            out |= {f"__en{i}": rows, f"__em{i}": centre + off, f"__eq{i}": F.greatest(spread - rows * off * off, F.lit(0.0))}
        return out

    held, so_far, out = _entered(cut, groups, summary, state), _so_far(order), {}
    for i, (to, c) in enumerate(moments.items()):
        # a block's first row is the one with what enters it
        a, mean_a, spread_a = (F.first(f"__e{k}{i}").over(so_far) for k in "nmq")
        b, mean_b, spread_b = F.count(c).over(so_far), F.coalesce(F.avg(c).over(so_far), F.lit(0.0)), F.coalesce(F.var_pop(c).over(so_far), F.lit(0.0))
        out |= {f"__a{i}": a, f"__am{i}": mean_a, f"__aq{i}": spread_a, f"__b{i}": b, f"__bm{i}": mean_b, f"__bq{i}": spread_b * b}
    held = held.withColumns(out)
    for i, to in enumerate(moments):
        a, mean_a, spread_a, b, mean_b, spread_b = (F.col(f"__{k}{i}") for k in ("a", "am", "aq", "b", "bm", "bq"))
        both, step = a + b, mean_b - mean_a
        spread = spread_a + spread_b + F.coalesce(F.try_divide(step * step * a * b, both), F.lit(0.0))
        held = held.withColumn(to, F.struct(both.alias("n"), F.when(both > 0, mean_a + step * F.try_divide(b, both)).alias("mean"), F.when(both > 1, F.sqrt(spread / (both - 1))).alias("std")))
    return own(held, *out, *[f"__e{k}{i}" for i in n for k in "nmq"])


def haloed(df: DataFrame, groups: Sequence[str], order: Sequence[str], block: Column | None, cols: Sequence[str], n: int):
    """(rows with the ``n`` rows before each block added to it, a window within blocks in order).

    Added rows have ``cols`` and ``order`` only; ``own`` drops them in the end.
    Frames of the window that reach ``n`` rows back hold what they would hold in
    the whole series.
    """
    cut = in_blocks(df, groups, block)
    if block is None:
        return cut.withColumn(ADDED, F.lit(False)), _within(order)
    names = list(dict.fromkeys([*order, *cols]))
    narrow = cut.select(AT, F.struct(*names).alias("v"), *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)])
    back = Window.partitionBy(AT).orderBy(*[F.col(f"__o{i}").desc_nulls_last() for i in range(len(order))])
    ends = narrow.withColumn("k", F.row_number().over(back)).where(F.col("k") <= n).groupBy(AT).agg(F.sort_array(F.collect_list(F.struct((-F.col("k")).alias("k"), "v"))).alias("end"))
    near = _along(groups).rowsBetween(-n, -1)
    last = ends.select(AT, F.collect_list("end").over(near).alias("ends")).select(AT, F.flatten(F.transform("ends", lambda x: F.transform(x, lambda y: y["v"]))).alias("last"))
    halo = last.select(AT, F.explode(F.slice("last", F.greatest(F.size("last") - n, F.lit(0)) + 1, F.lit(n))).alias("v"))
    return _with(cut, halo.select(AT, "v.*")), _within(order)


def rows_before(df: DataFrame, groups: Sequence[str], order: Sequence[str], block: Column | None, cols: Sequence[str], n: int, to: str) -> DataFrame:
    """``df`` with an array ``to`` of the ``n`` rows before each row (structs of ``cols``, in order; fewer where a series begins)."""
    with_halo, w = haloed(df, groups, order, block, cols, n)
    return own(with_halo.withColumn(to, F.collect_list(F.struct(*cols)).over(w.rowsBetween(-n, -1))))
