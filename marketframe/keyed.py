"""Tables with keys, dimensions, measures and an order.

A ``KeyedTable`` is a DataFrame with a primary key and the columns that order
its rows. Spark's rows have no order of their own, so whatever depends on one
(first, last, shift, running sums) takes it from ``order_by``.

Checks that need a job (``is_key``, ``check_nulls``, ``check_completeness``) are
called explicitly; no transformation runs one on its own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketframe.functions.columns import intersection, missing, require, sym_diff

#: Rows that an error message shows at most.
SHOWN = 20


@dataclass(frozen=True)
class KeyedTable:
    df: DataFrame
    primary_key: tuple[str, ...]
    dimensions: tuple[str, ...] = ()
    measures: tuple[str, ...] = ()
    order_by: tuple[str, ...] = ()

    def __post_init__(self):
        if not isinstance(self.df, DataFrame):
            raise TypeError("df must be a DataFrame")
        if not self.primary_key:
            raise ValueError("primary_key must not be empty")
        require(self.df.columns, [*self.primary_key, *self.dimensions, *self.measures, *self.order_by])
        put = lambda k, v: object.__setattr__(self, k, tuple(v))
        put("primary_key", self.primary_key)
        put("dimensions", self.dimensions)
        put("measures", self.measures or [c for c in self.df.columns if c not in self.dimensions])
        put("order_by", self.order_by or self.primary_key)

    def with_df(self, df: DataFrame, **changes) -> KeyedTable:
        return replace(self, **{"df": df, "measures": (), **changes})

    def has_columns(self, cols: list[str], strict: bool = True) -> bool:
        """Whether the columns are there; KeyError if not and ``strict``. Looks at the schema only."""
        if strict:
            require(self.df.columns, cols)
        return not missing(self.df.columns, cols)

    # -- nulls

    def null_counts(self, cols: list[str] | None = None) -> dict[str, int]:
        """Nulls (not NaN) of each column, counted in one pass."""
        cols = list(cols or self.df.columns)
        self.has_columns(cols)
        return self.df.agg(*[F.count_if(F.isnull(c)).alias(c) for c in cols]).first().asDict()

    def null_columns(self, cols: list[str] | None = None) -> list[str]:
        return [c for c, n in self.null_counts(cols).items() if n]

    def null_rows(self, cols: list[str] | None = None) -> DataFrame:
        """Rows with a null in any of the columns."""
        cols = list(cols or self.df.columns)
        self.has_columns(cols)
        return self.df.where(reduce(or_, [F.col(c).isNull() for c in cols]))

    def check_nulls(self, cols: list[str] | None = None) -> None:
        """ValueError that names the columns with a null."""
        if found := self.null_columns(cols):
            raise ValueError(f"nulls in {found}")

    # -- keys

    def duplicate_keys(self) -> DataFrame:
        """Key values that occur more than once, with their ``count``. Null counts as a value."""
        return self.df.groupBy(*self.primary_key).count().where("count > 1")

    def is_key(self) -> bool:
        return self.duplicate_keys().isEmpty()

    def assert_key(self) -> None:
        """AssertionError that shows some duplicated keys."""
        if found := self.duplicate_keys().limit(SHOWN).collect():
            raise AssertionError(f"{list(self.primary_key)} is no key: {[tuple(r) for r in found]}")

    def duplicate_rows(self) -> DataFrame:
        """All rows of duplicated keys."""
        return self._counted().where("__n > 1").drop("__n")

    def _counted(self) -> DataFrame:
        return self.df.withColumn("__n", F.count("*").over(Window.partitionBy(*self.primary_key)))

    def deduped(self, keep: str = "first") -> KeyedTable:
        """One row per key: the ``first``, ``last`` or ``any`` in the table's order, or ``none`` of a duplicated key's."""
        if keep == "any":
            return self.with_df(self.df.dropDuplicates(list(self.primary_key)))
        if keep == "none":
            return self.with_df(self._counted().where("__n = 1").drop("__n"))
        if keep not in ("first", "last"):
            raise TypeError(f"keep must be first, last, any or none, not {keep!r}")
        order = [F.asc(c) if keep == "first" else F.desc(c) for c in self.order_by]
        ranked = self.df.withColumn("__n", F.row_number().over(Window.partitionBy(*self.primary_key).orderBy(*order)))
        return self.with_df(ranked.where("__n = 1").drop("__n"))

    def deduped_key(self) -> KeyedTable:
        """A table whose key holds: ``deduped`` in the plan, without a job that looks first."""
        return self.deduped("first")

    # -- other tables

    def foreign_key(self, other: KeyedTable) -> list[str]:
        """Columns of this table's key or dimensions that are in the other's key."""
        return intersection([*self.primary_key, *self.dimensions], other.primary_key)

    def column_difference(self, other: KeyedTable) -> list[str]:
        """Columns that only one of the tables has."""
        return sym_diff(self.df.columns, other.df.columns)

    def missing_from(self, other: KeyedTable, key: list[str] | None = None) -> DataFrame:
        """Rows of ``other`` whose key isn't in this table; a key with a null is in no table."""
        key = list(key or self.primary_key)
        self.has_columns(key)
        other.has_columns(key)
        return other.df.join(self.df.select(*key), key, "left_anti")

    def check_completeness(self, other: KeyedTable, key: list[str] | None = None) -> None:
        """ValueError that shows some rows of ``other`` that this table lacks."""
        if found := self.missing_from(other, key).limit(SHOWN).collect():
            raise ValueError(f"rows without a match: {[r.asDict() for r in found]}")

    def joined_stats(self, stats: KeyedTable, lag: tuple[str, int] | None = None, check: bool = False) -> KeyedTable:
        """This table with the columns of ``stats`` that it lacks, by the foreign key.

        ``lag=("season", 1)`` joins each row with the stats of one season before.
        With ``check`` the result's key is asserted, which shows a fan-out.
        """
        key = self.foreign_key(stats)
        if not key:
            raise ValueError("no shared key")
        right = stats.df
        if lag:
            right = right.withColumn(lag[0], F.col(lag[0]) + lag[1])
        new = [c for c in stats.df.columns if c not in self.df.columns]
        out = self.with_df(self.df.join(right.select(*key, *new), key, "left").select(*self.df.columns, *new))
        if check:
            out.assert_key()
        return out

    def pipe(self, f: Callable[[DataFrame], DataFrame]) -> KeyedTable:
        return self.with_df(f(self.df))
