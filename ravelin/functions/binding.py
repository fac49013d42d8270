"""Bind an expression once inside a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also when used inside lambdas over arrays."""
    return F.get(F.transform(F.array(value), body), 0)


def lookup(table: dict[str, object], key: Column, default: object = None) -> Column:
    """Value of a fixed map for a key column."""
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    found = F.try_element_at(entries, key)
    return found if default is None else F.coalesce(found, F.lit(default))
