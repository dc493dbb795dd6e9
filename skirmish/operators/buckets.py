"""I1, I4 on stored tables: targets bucketed by key, changed bucket by bucket.

A table is stored under ``path`` in ``n`` folders by a hash of its key. A batch
touches the buckets of its own keys only: the read is pruned to these folders,
and dynamic partition overwrite replaces these and leaves the others' files
as they are. New files are staged and moved in when the job commits, so the
old ones can be read while it runs; running a batch again gives the same
table. ``n`` belongs to the table (choose it so that a bucket is some hundred
MB); the list of touched buckets that reaches the driver has at most ``n``
numbers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from skirmish.operators.maintain import KEY_DEFAULTS, collapse_updates, insert_role_logs, merge_updates, role_log_key

BUCKET = "bucket"


@dataclass(frozen=True)
class Bucketed:
    """A table stored in ``n`` folders by the hash of ``keys``. With ``schema``
    (without the bucket) a table of no rows can be read too."""

    path: str
    keys: tuple[str, ...]
    n: int
    schema: StructType | None = None

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.n)).cast("int")

    def write(self, df: DataFrame) -> None:
        """Replace the buckets that ``df`` has rows of (all of a new table's)."""
        (df.withColumn(BUCKET, self.bucket()).repartition(BUCKET).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path))

    def touched(self, keys: DataFrame) -> list[int]:
        return sorted(r[0] for r in keys.select(self.bucket().alias("b")).distinct().collect())

    def read(self, spark: SparkSession, buckets: list[int] | None = None) -> DataFrame:
        """The table, or its rows in ``buckets`` (other folders aren't read)."""
        x = (spark.read if self.schema is None else spark.read.schema(StructType([*self.schema, StructField(BUCKET, IntegerType())]))).parquet(self.path)
        return (x if buckets is None else x.where(F.col(BUCKET).isin(buckets))).drop(BUCKET)

    def change(self, batch: DataFrame, merge: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Replace the buckets of the batch's keys by ``merge`` of their rows;
        returns them. ``merge`` keeps every key's row, so no bucket empties."""
        buckets = self.touched(batch)
        if buckets:
            self.write(merge(self.read(batch.sparkSession, buckets)))
        return buckets


def upsert_stored(table: Bucketed, updates: DataFrame, order: str | None = None, keep_max: tuple[str, ...] = ()) -> list[int]:
    """I1 on a stored table: ``upsert`` within the touched buckets."""
    keys = list(table.keys)
    u = collapse_updates(updates, keys, order)
    return table.change(u, lambda old: merge_updates(old, u, keys, old.columns, keep_max))


def insert_role_logs_stored(table: Bucketed, seen: DataFrame, day: str = "day") -> list[int]:
    """I4 on stored role logs (keyed by the five key columns with their
    defaults): ``insert_role_logs`` within the touched buckets."""
    if set(table.keys) != set(KEY_DEFAULTS):
        raise ValueError(f"role logs are keyed by {', '.join(KEY_DEFAULTS)}")
    rows = seen.where(F.col("global_id").isNotNull() & (F.col("global_id") != ""))
    return table.change(role_log_key(rows), lambda old: insert_role_logs(old, rows, day))
