"""F6, B11, F10, C6, C9 by cursor: keyset pages.

An offset page k sorts k pages to return one. A keyset page starts behind the
last row of the page before: its sort key, the cursor, becomes a predicate
that is pushed to the scan, and the page is a distributed top-``limit``. The
order has to be total (end it with a unique key); NULLs stand where each key
says.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Key:
    """A sort key: column, direction and the side of its NULLs."""

    name: str
    desc: bool = False
    nulls_last: bool = True

    def sort(self) -> Column:
        c = F.col(self.name)
        if self.desc:
            return c.desc_nulls_last() if self.nulls_last else c.desc_nulls_first()
        return c.asc_nulls_last() if self.nulls_last else c.asc_nulls_first()

    def equal(self, value: Any) -> Column:
        return F.col(self.name).isNull() if value is None else F.col(self.name) == value

    def beyond(self, value: Any) -> Column | None:
        """Rows strictly behind ``value`` in this key; None if there are none."""
        c = F.col(self.name)
        if value is None:
            return None if self.nulls_last else c.isNotNull()
        later = c < value if self.desc else c > value
        return later | c.isNull() if self.nulls_last else later


def after(keys: list[Key], cursor: tuple) -> Column:
    """The predicate "behind ``cursor``": equal in the first keys and beyond it
    in the next one. The first key's own range is spelled out as well, since a
    plain comparison prunes files that a disjunction of conjunctions does not."""
    out, same = F.lit(False), F.lit(True)
    for k, v in zip(keys, cursor, strict=True):
        if (further := k.beyond(v)) is not None:
            out = out | (same & further)
        same = same & k.equal(v)
    lead = keys[0].beyond(cursor[0])
    lead = keys[0].equal(cursor[0]) if lead is None else keys[0].equal(cursor[0]) | lead
    return lead & out


def page_after(df: DataFrame, keys: list[Key], limit: int, cursor: tuple | None = None) -> DataFrame:
    """The ``limit`` rows behind ``cursor`` (the first ones without it)."""
    if limit < 1:
        raise ValueError("a page has at least one row")
    x = df if cursor is None else df.where(after(keys, cursor))
    return x.orderBy(*[k.sort() for k in keys]).limit(limit)


def cursor_of(page: DataFrame, keys: list[Key]) -> tuple | None:
    """The cursor behind a page: its last row's sort key (None if empty)."""
    flipped = [Key(k.name, not k.desc, not k.nulls_last).sort() for k in keys]
    row = page.select(*[k.name for k in keys]).orderBy(*flipped).first()
    return None if row is None else tuple(row)


def pages(df: DataFrame, keys: list[Key], limit: int) -> Iterator[DataFrame]:
    """All pages in order, each found by the cursor of the one before."""
    cursor = None
    while True:
        page = page_after(df, keys, limit, cursor)
        cursor = cursor_of(page, keys)
        if cursor is None:
            return
        yield page
