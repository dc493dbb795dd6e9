"""Segmented scans: order-dependent work per key without one task per key.

Rows are range-partitioned by (key, order), so a key with a third of all rows
is spread over a third of the partitions. Each partition works on its own
rows; what a later partition needs from the earlier ones (how many rows of
the key, the key's last row) is read off a summary with one row per
(partition, key). Only a partition's first key can have rows in an earlier
partition, so at most one *carry* per partition is broadcast back: its size
is bounded by the number of partitions, not by the data.

The placed rows are written to the shared folder first. Range bounds are
sampled per run, so rows and carries have to come from the same placement,
and a lost executor then only repeats reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skirmish.session import written

PART = "_part"


def placed(df: DataFrame, key: list[str], order: list[str], name: str, local: dict[str, Column] | None = None,
           parts: int | None = None) -> DataFrame:
    """``df`` in range order of (key, order) with ``_part`` and the ``local``
    window columns, each evaluated over the (partition, key) rows in order."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    w = Window.partitionBy(PART, *key).orderBy(*order)
    x = df.repartitionByRange(n, *key, *order).withColumn(PART, F.spark_partition_id())
    return written(x.withColumns({c: f.over(w) for c, f in (local or {}).items()}), name)


def carried(rows: DataFrame, key: list[str], summary: dict[str, Column], before: dict[str, Column]) -> DataFrame:
    """(``_part``, key, ``before`` columns) for the keys that a partition goes
    on with. ``summary`` aggregates the rows of each (partition, key);
    ``before`` are window functions over the summaries of the key's earlier
    partitions, in order."""
    w = Window.partitionBy(*key).orderBy(PART)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    s = rows.groupBy(PART, *key).agg(*[f.alias(c) for c, f in summary.items()])
    s = s.withColumns({c: f.over(earlier) for c, f in before.items()} | {"_nth": F.row_number().over(w)})
    return s.where("_nth > 1").select(PART, *key, *before)


def with_carry(rows: DataFrame, carry: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` with the carry's columns (NULL where the key starts in the
    partition). NULL keys meet like any other."""
    c = carry.select(F.col(PART).alias("_cp"), *[F.col(k).alias(f"_ck{i}") for i, k in enumerate(key)],
                     *[x for x in carry.columns if x not in (PART, *key)])
    on = F.col(PART) == F.col("_cp")
    for i, k in enumerate(key):
        on = on & F.col(k).eqNullSafe(F.col(f"_ck{i}"))
    return rows.join(F.broadcast(c), on, "left").drop("_cp", *[f"_ck{i}" for i in range(len(key))])


def numbered(df: DataFrame, key: list[str], order: list[str], out: str = "pos", name: str = "numbered",
             parts: int | None = None) -> DataFrame:
    """``df`` with ``out`` (long): the row's place in its key by ``order``, from
    0. Rows that agree in key and all order columns are numbered arbitrarily
    among themselves."""
    rows = placed(df, key, order, name, {"_idx": F.row_number()}, parts)
    carry = carried(rows, key, {"_n": F.count(F.lit(1))}, {"_before": F.sum("_n")})
    at = F.coalesce(F.col("_before"), F.lit(0).cast("long")) + F.col("_idx") - 1
    return with_carry(rows, carry, key).withColumn(out, at).drop("_idx", "_before", PART)
