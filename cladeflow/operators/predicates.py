"""Filters of the search surface: values, nulls, ranges, nested decisions, texts."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULL, NOT_NULL = "_NULL", "_NOT_NULL"


def matches(column: str | Column, values: list, array: bool = False) -> Column:
    """Any of the values; _NULL and _NOT_NULL stand for missing and present.

    An empty array counts as missing.
    """
    c = F.col(column) if isinstance(column, str) else column
    missing = c.isNull() | (F.size(c) == 0) if array else c.isNull()
    parts = []
    if NULL in values:
        parts.append(missing)
    if NOT_NULL in values:
        parts.append(~missing)
    plain = [v for v in values if v not in (NULL, NOT_NULL)]
    if plain:
        parts.append(F.arrays_overlap(c, F.array(*map(F.lit, plain))) if array else c.isin(*plain))
    return F.coalesce(reduce(or_, parts), F.lit(False)) if parts else F.lit(True)


def conjunction(parameters: dict[str, list], arrays: frozenset = frozenset(), without: str | None = None) -> Column:
    """All parameters hold, each by any of its values; `without` leaves one out."""
    parts = [matches(k, v, k in arrays) for k, v in parameters.items() if k != without]
    return reduce(and_, parts) if parts else F.lit(True)


def rank_between(ordinal: Column, lowest: int | None = None, highest: int | None = None) -> Column:
    """Ranks between two, given by ordinals that grow downwards."""
    parts = ([ordinal <= lowest] if lowest is not None else []) + ([ordinal >= highest] if highest is not None else [])
    return reduce(and_, parts) if parts else F.lit(True)


def decided(decisions: Column, project, modes: list[str]) -> Column:
    """A decision of the project with one of the modes; _NULL: the project has none, _NOT_NULL: it has any."""
    own = lambda d: d["project"] == project
    parts = []
    if NULL in modes:
        parts.append(~F.exists(decisions, own))
    if NOT_NULL in modes:
        parts.append(F.exists(decisions, own))
    plain = [m for m in modes if m not in (NULL, NOT_NULL)]
    if plain:
        parts.append(F.exists(decisions, lambda d: own(d) & d["mode"].isin(*plain)))
    return reduce(or_, parts)


def alpha_index(name: Column, letter: str) -> Column:
    return F.upper(F.substring(name, 1, 1)) == letter.upper()


def below(path: Column, node) -> Column:
    """Anywhere under `node` or itself, by the path of structs with `id`."""
    return F.exists(path, lambda p: p["id"] == node)


def blocked_names(name: Column, exact: list[str], patterns: list[str]) -> Column:
    parts = ([name.isin(*exact)] if exact else []) + [name.rlike(p) for p in patterns]
    return reduce(or_, parts) if parts else F.lit(False)


def same_criteria(criteria: dict[str, object]) -> Column:
    """Equality on the criteria that are given; those of None don't count."""
    parts = [F.col(k) == v for k, v in criteria.items() if v is not None]
    return reduce(and_, parts) if parts else F.lit(True)


def null_safe(criteria: dict[str, object]) -> Column:
    """Equality on all criteria; None asks for a null."""
    return reduce(and_, [F.col(k).eqNullSafe(F.lit(v)) for k, v in criteria.items()])


def page(rows: DataFrame, limit: int = 10, offset: int = 0) -> DataFrame:
    """A page of ordered rows; at most 1000 rows from at most 100 000 on."""
    if not 0 <= limit <= 1000:
        raise ValueError("limit must be 0 to 1000")
    if not 0 <= offset <= 100_000:
        raise ValueError("offset must be 0 to 100000")
    return rows.offset(offset).limit(limit)
