"""Lists of column names. Order is that of first appearance."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable


def intersection(*lists: Iterable[str]) -> list[str]:
    """Names that are in every list; no lists: none."""
    if not lists:
        return []
    first, *rest = [list(dict.fromkeys(x)) for x in lists]
    return [c for c in first if all(c in x for x in rest)]


def union(*lists: Iterable[str]) -> list[str]:
    """Names that are in any list."""
    return list(dict.fromkeys(c for x in lists for c in x))


def sym_diff(*lists: Iterable[str]) -> list[str]:
    """Names that are in an odd number of lists, as symmetric differences in a row give."""
    seen = Counter(c for x in lists for c in dict.fromkeys(x))
    return [c for c in union(*lists) if seen[c] % 2]


def missing(have: Iterable[str], wanted: Iterable[str]) -> list[str]:
    have = set(have)
    return [c for c in dict.fromkeys(wanted) if c not in have]


def require(have: Iterable[str], wanted: Iterable[str]) -> None:
    """KeyError that names the wanted columns that aren't there."""
    if lost := missing(have, wanted):
        raise KeyError(f"no such columns: {lost}")


def stat_name(attr: str, col: str, stat: str, affix: str = "") -> str:
    """``attr_affix_col_stat``, without the affix if there is none."""
    return "_".join(x for x in (attr, affix, col, stat) if x)
