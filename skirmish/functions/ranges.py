"""Date ranges as canonical half-open structs.

A range is STRUCT<lower DATE, lower_inclusive BOOLEAN, upper DATE,
upper_inclusive BOOLEAN> in canonical form ``[lower, upper)``: lower
inclusive, upper exclusive, NULL bound = unbounded, an empty range is NULL.
Membership is true set-of-days semantics (Q12 fixed).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skirmish.functions.scalars import ColumnOrName, _c

RANGE_TYPE = "struct<lower:date,lower_inclusive:boolean,upper:date,upper_inclusive:boolean>"


def make_range(lower: ColumnOrName, upper: ColumnOrName, lower_inclusive: bool | Column = True,
               upper_inclusive: bool | Column = False) -> Column:
    """Canonical range from two dates and bound flags (NULL = unbounded)."""
    lo, up = _c(lower).cast("date"), _c(upper).cast("date")
    li = lower_inclusive if isinstance(lower_inclusive, Column) else F.lit(lower_inclusive)
    ui = upper_inclusive if isinstance(upper_inclusive, Column) else F.lit(upper_inclusive)
    lo2 = F.when(lo.isNull() | li, lo).otherwise(F.date_add(lo, 1))
    up2 = F.when(up.isNull() | ~ui, up).otherwise(F.date_add(up, 1))
    canon = F.struct(lo2.alias("lower"), lo2.isNotNull().alias("lower_inclusive"),
                     up2.alias("upper"), F.lit(False).alias("upper_inclusive"))
    empty = lo2.isNotNull() & up2.isNotNull() & (lo2 >= up2)
    return F.when(empty, F.lit(None).cast(RANGE_TYPE)).otherwise(canon)


def day_range(day: ColumnOrName) -> Column:
    """The one-day range ``[d, d+1)``."""
    d = _c(day).cast("date")
    return make_range(d, F.date_add(d, 1))


def in_range(rng: ColumnOrName, day: ColumnOrName) -> Column:
    """Is ``day`` inside the canonical range (NULL range → false)."""
    r, d = _c(rng), _c(day).cast("date")
    return F.coalesce(r.isNotNull() & (r["lower"].isNull() | (r["lower"] <= d))
                      & (r["upper"].isNull() | (d < r["upper"])), F.lit(False))


def range_sort_key(rng: ColumnOrName) -> Column:
    """Ordering of ranges — lower (unbounded first), lower bound flag,
    upper (unbounded last), upper bound flag. Comparable as a struct."""
    r = _c(rng)
    return F.struct(r["lower"].isNotNull().alias("has_lower"), r["lower"].alias("lower"),
                    r["lower_inclusive"].alias("lower_inclusive"),
                    r["upper"].isNull().alias("no_upper"), r["upper"].alias("upper"),
                    r["upper_inclusive"].alias("upper_inclusive"))


def diff_date(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Days from ``b`` to ``a``."""
    return F.datediff(_c(a), _c(b))
