"""A1–A3: reading the relational tables.

The reference reads PostgreSQL tables over JDBC in one unpartitioned task.
Here a JDBC read is split by a numeric column into ranges (one task each),
and the columnar layout (parquet, partitioned by ``match_type``) is the
default so that filters and projections reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The analysis tables loaded together (A2).
ANALYSIS_TABLES = ["items", "matches", "scores", "role_kungfus", "roles", "match_roles"]

# Valid match types: team size × zone family (fixed values).
TEAM_SIZES = ["2", "3", "5"]
ZONE_FAMILIES = ["c", "d", "m"]
MATCH_TYPES = [s + z for s in TEAM_SIZES for z in ZONE_FAMILIES]


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A1 for files: a lazily scanned table (pruning/pushdown by Catalyst)."""
    return spark.read.format(fmt).load(path)


def load_table(spark: SparkSession, url: str, table: str, *, driver: str | None = None,
               partition_column: str | None = None, lower_bound: int | None = None,
               upper_bound: int | None = None, num_partitions: int | None = None,
               fetch_size: int = 10_000, extra: dict | None = None) -> DataFrame:
    """A1: one relational table over JDBC, read in parallel ranges.

    ``partition_column``/bounds/``num_partitions`` split the scan into
    ``num_partitions`` range queries; without them Spark reads the table in a
    single task, which does not scale.
    """
    reader = (spark.read.format("jdbc")
              .option("url", url if url.startswith("jdbc:") else f"jdbc:{url}")
              .option("dbtable", table)
              .option("fetchsize", str(fetch_size)))
    if driver:
        reader = reader.option("driver", driver)
    if partition_column is not None:
        if not num_partitions:
            raise ValueError("partition_column needs num_partitions")
        if lower_bound is None or upper_bound is None:
            lower_bound, upper_bound = jdbc_bounds(spark, url, table, partition_column, driver, extra)
        reader = (reader.option("partitionColumn", partition_column)
                  .option("lowerBound", str(lower_bound))
                  .option("upperBound", str(upper_bound))
                  .option("numPartitions", str(num_partitions)))
    for k, v in (extra or {}).items():
        reader = reader.option(k, v)
    return reader.load()


def jdbc_bounds(spark: SparkSession, url: str, table: str, column: str, driver: str | None = None,
                extra: dict | None = None) -> tuple[int, int]:
    """Min and max of a numeric column, read by one small pushed-down query
    (two numbers reach the driver), to split a JDBC scan into ranges."""
    q = f"(SELECT min({column}) AS lo, max({column}) AS hi FROM {table}) bounds"
    r = load_table(spark, url, q, driver=driver, extra=extra).first()
    if r is None or r["lo"] is None:
        return 0, 0
    return int(r["lo"]), int(r["hi"])


def load_tables(spark: SparkSession, base: str, names: list[str] | None = None,
                fmt: str = "parquet") -> dict[str, DataFrame]:
    """A2: the analysis tables by name (lazy; nothing is read here)."""
    return {n: read_table(spark, f"{base.rstrip('/')}/{n}.{fmt}" if fmt == "parquet" else f"{base}/{n}", fmt)
            for n in (names or ANALYSIS_TABLES)}


def check_match_type(match_type: str) -> str:
    if match_type not in MATCH_TYPES:
        raise ValueError(f"invalid match type {match_type!r}; expected one of {MATCH_TYPES}")
    return match_type


def read_match_type(df: DataFrame, match_type: str) -> DataFrame:
    """A3: one match type's rows; a partition filter when stored partitioned.

    Invalid types raise instead of silently returning nothing.
    """
    return df.where(F.col("match_type") == check_match_type(match_type))


def write_partitioned(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store a match table partitioned by ``match_type`` (for A3 pruning)."""
    df.write.mode(mode).partitionBy("match_type").parquet(path)


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int, path: str | None = None,
                   mode: str = "overwrite") -> DataFrame:
    """Store a table bucketed and sorted by ``key`` (a catalog table at
    ``path``): tables bucketed alike on the join key (matches, match_roles,
    match_logs on match_id) join without a shuffle. Returns the table."""
    w = df.write.mode(mode).format("parquet").bucketBy(buckets, key).sortBy(key)
    if path:
        w = w.option("path", path)
    w.saveAsTable(name)
    return df.sparkSession.table(name)
