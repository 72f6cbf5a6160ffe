"""Ordered recurrences in blocks.

A series of any length is cut into blocks of time. Each block is reduced to a
summary of what it does to a state that enters it; the summaries, one row per
block, are walked in order to find the state that enters each block; and the
rows of each block are replayed from there, by array operations on stretches of
rows. No task needs the rows of a whole series, and every walk is a stream that
holds one state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def walked(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: Callable, advance: Callable, needs: Sequence[str], to: dict[str, str], drop: Sequence[str] = ()) -> DataFrame:
    """``df`` with columns ``to`` (name -> type) that a walk in order computes, key by key.

    Rows come in stretches of one key: ``start(columns)`` gives the state at a
    key's first row, and ``advance(state, columns)`` the state after a stretch
    and the arrays of its values. Columns are the ``needs`` as Arrow arrays, so
    a stretch is computed by array operations and no row is visited by itself.
    """
    keys, needs, names = list(keys), list(needs), list(to)
    kept = [f for f in df.schema if f.name not in drop]

    def walk(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        kinds = [{"double": pa.float64, "bigint": pa.int64, "int": pa.int32}[t]() for t in to.values()]
        at, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            changed = np.zeros(batch.num_rows - 1, dtype=bool)
            for k in keys:
                codes = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy()
                changed |= codes[1:] != codes[:-1]
            cuts = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
            values: list[list] = [[] for _ in names]
            for first, last in zip(cuts, cuts[1:]):
                columns = [batch.column(c).slice(first, last - first) for c in needs]
                key = [batch.column(k)[first].as_py() for k in keys]
                if key != at:
                    at, state = key, start(columns)
                state, out = advance(state, columns)
                for v, x in zip(values, out, strict=True):
                    v.append(x if isinstance(x, pa.Array) else pa.array(x))
            arrays = [batch.column(f.name) for f in kept] + [pa.concat_arrays([x.cast(k) for x in v]) for v, k in zip(values, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, [*(f.name for f in kept), *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"`{n}` {t}" for n, t in to.items())])
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(walk, schema)


def decayed_sums(x, decay: float, entering: float):
    """The running sums s = s * decay + x of an array, from ``entering`` on.

    Stretches of 64 values are summed at once by a matrix of powers; only their
    last sums are carried from stretch to stretch.
    """
    import numpy as np

    width = 64
    powers = decay ** np.arange(width + 1)
    age = np.subtract.outer(np.arange(width), np.arange(width))
    matrix = np.where(age >= 0, powers[np.maximum(age, 0)], 0.0)
    rows = -(-len(x) // width)
    own = np.zeros(rows * width)
    own[: len(x)] = x
    own = own.reshape(rows, width) @ matrix.T
    carried, s = np.empty(rows), entering
    for i in range(rows):
        carried[i] = s
        s = s * powers[width] + own[i, -1]
    return (own + carried[:, None] * powers[1:]).reshape(-1)[: len(x)]


def _cut(df: DataFrame, block: Column) -> DataFrame:
    return df.withColumn("__block", block)


def _back(cut: DataFrame, entering: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the state that enters their block; null groups are groups like any other."""
    state = entering.withColumnsRenamed({k: f"__k{i}" for i, k in enumerate(keys)})
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    return cut.join(state, same).drop(*[f"__k{i}" for i in range(len(keys))])


def _decayed(values: Column, decay: float) -> Column:
    """The sum of ordered values, each times ``decay`` to its age."""
    return F.aggregate(values, F.lit(0.0), lambda s, v: s * decay + v["x"])


def ewm_means(df: DataFrame, groups: Sequence[str], order: Sequence[str], block: Column, means: dict[str, tuple[str, float]]) -> DataFrame:
    """``df`` with exponentially weighted means, weights ``(1 - alpha) ** age`` divided by their sum.

    ``means``: new column -> (column, alpha). ``block``: an expression that
    grows with ``order`` and cuts a series into blocks, such as its hour or day.
    A null value gives a null mean and doesn't count as a row, so weights do
    not decay over it. A block acts on the weighted sum s and the weight w as
    s * d ** n + its own, so a summary is three numbers.
    """
    keys, size = [*groups, "__block"], range(len(means))
    cols = [F.col(c).cast("double") for c, _ in means.values()]
    decays = [1 - alpha for _, alpha in means.values()]
    cut = _cut(df, block).withColumns({f"__x{i}": c for i, c in enumerate(cols)})
    own = []
    for i, d in enumerate(decays):
        place = F.struct(*[F.col(o).alias(f"o{j}") for j, o in enumerate(order)], F.col(f"__x{i}").alias("x"))
        values = F.sort_array(F.collect_list(F.when(F.col(f"__x{i}").isNotNull(), place)))
        own += [_decayed(values, d).alias(f"__b{i}"), F.count(f"__x{i}").alias(f"__n{i}")]
    blocks = cut.groupBy(*keys).agg(*own)

    def compose(state, columns):
        own = [c.to_pylist() for c in columns]
        out: list[list] = [[] for _ in range(2 * len(means))]
        # one row per block, not per row of the series
        for row in zip(*own, strict=True):
            for v, x in zip(out, [x for pair in state for x in pair], strict=True):
                v.append(x)
            state = tuple((s * d**n + b, w * d**n + (1 - d**n) / (1 - d)) for (s, w), d, b, n in zip(state, decays, row[0::2], row[1::2], strict=True))
        return state, out

    zero = tuple((0.0, 0.0) for _ in size)
    needs = [f"__{k}{i}" for i in size for k in "bn"]
    entering = walked(blocks, groups, ["__block"], lambda _: zero, compose, needs, {f"__{k}{i}": "double" for i in size for k in "sw"}, drop=needs)

    def replay(state, columns):
        import numpy as np
        import pyarrow as pa

        after, out = [], []
        for (s, w), d, column in zip(state, decays, columns, strict=False):
            x = column.to_numpy(zero_copy_only=False)
            there = column.is_valid().to_numpy(zero_copy_only=False)
            sums = decayed_sums(x[there], d, s)
            weights = decayed_sums(np.ones(len(sums)), d, w)
            mean = np.zeros(len(x))
            mean[there] = sums / weights
            out.append(pa.array(mean, mask=~there))
            after.append((float(sums[-1]), float(weights[-1])) if len(sums) else (s, w))
        return after, out

    begin = lambda columns: [(columns[len(size) + 2 * i][0].as_py(), columns[len(size) + 2 * i + 1][0].as_py()) for i in size]
    state = [f"__{k}{i}" for i in size for k in "sw"]
    values = [f"__x{i}" for i in size]
    return walked(_back(cut, entering, keys), keys, order, begin, replay, [*values, *state], dict.fromkeys(means, "double"), drop=[*values, *state, "__block"])


def automaton(df: DataFrame, groups: Sequence[str], order: Sequence[str], block: Column, moves: Column, states: int, start: int, to: str) -> DataFrame:
    """``df`` with the state after each row of an automaton with ``states`` states.

    ``moves``: an array that gives the next state for each state. The moves of a
    block compose into one such array, whatever the state that enters it.
    """
    keys = [*groups, "__block"]
    cut = _cut(df, block).withColumn("__move", moves)
    same = F.array(*[F.lit(i) for i in range(states)])
    place = F.struct(*[F.col(o).alias(f"o{j}") for j, o in enumerate(order)], F.col("__move").alias("m"))
    composed = F.aggregate(F.sort_array(F.collect_list(place)), same, lambda s, x: F.transform(s, lambda i: F.get(x["m"], i)))
    blocks = cut.groupBy(*keys).agg(composed.alias("__map"))

    def compose(state, columns):
        out = []
        for move in columns[0].to_pylist():  # one row per block
            out.append(state)
            state = move[state]
        return state, [out]

    def replay(state, columns):
        import numpy as np

        moves = columns[0].flatten().to_numpy().reshape(-1, states)
        # after step k each row holds the moves of the 2 ** k rows up to it, composed
        k = 1
        while k < len(moves):
            moves = np.concatenate((moves[:k], np.take_along_axis(moves[k:], moves[:-k], axis=1)))
            k *= 2
        return int(moves[-1, state]), [moves[:, state]]

    entering = walked(blocks, groups, ["__block"], lambda _: start, compose, ["__map"], {"__state": "int"}, drop=["__map"])
    begin = lambda columns: columns[1][0].as_py()
    return walked(_back(cut, entering, keys), keys, order, begin, replay, ["__move", "__state"], {to: "int"}, drop=["__move", "__state", "__block"])
