"""Left-to-right composition of functions from table to table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import TypeVar

T = TypeVar("T")


@dataclass(frozen=True)
class Pipeline:
    """``Pipeline([f, g]).execute(x)`` is ``g(f(x))``; no function gives ``x`` itself.

    Works on DataFrames and on KeyedTables. The functions only add to the plan,
    so the whole is optimised as one.
    """

    functions: Sequence[Callable[[T], T]]

    def execute(self, table: T) -> T:
        return reduce(lambda x, f: f(x), self.functions, table)

    def then(self, *functions: Callable[[T], T]) -> Pipeline:
        return Pipeline([*self.functions, *functions])
