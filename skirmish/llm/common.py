"""Helpers shared by the corpus operators: stored tables, graph components,
a blocked Bloom filter of fixed size, and access to Arrow text buffers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.session import scratch_path


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# while a table is written: its shuffle files go when it is done, as nothing reads them again, and
# Arrow batches are small, as both the JVM and the Python workers keep the memory of the largest
WRITE_CONF = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8388608",
}


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back: cuts
    the lineage, survives lost executors, and is computed once. ``WRITE_CONF``
    holds during the write."""
    spark = df.sparkSession
    path, before = scratch_path(spark, name), {k: spark.conf.get(k) for k in WRITE_CONF}
    try:
        for k, v in WRITE_CONF.items():
            spark.conf.set(k, v)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    while name.lower() in (c.lower() for c in df.columns):
        name = "_" + name
    return name


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges`` (u, v: long) → (node, component): the smallest node reachable.

    Alternating large-star / small-star rounds; each round is two grouped
    minima and two joins on the edge list (AQE may split a hot centre), and
    its result is written to the shared folder. Nodes without an edge to
    another node don't appear. Nulls are ignored; an empty list gives no rows.
    """
    e = stored(
        edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")

    def signature(df):
        return df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()

    before = signature(e)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = signature(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def drop_keys(df: DataFrame, key, losers: DataFrame, filter_blocks: int = 1 << 18) -> DataFrame:
    """Rows of ``df`` whose ``key`` (a long expression) is not in ``losers``
    (one long column). A Bloom filter of fixed size lets rows that cannot be
    listed pass without a shuffle; the others meet the list in an anti join."""
    name, listed = fresh(df, "drop_key"), losers.columns[0]
    held = df.sparkSession.sparkContext.broadcast(BlockedBloom.build(losers, listed, filter_blocks))

    @F.pandas_udf("boolean")
    def listed_maybe(k: pd.Series) -> pd.Series:
        return pd.Series(held.value.may_hold(k.to_numpy("int64")))

    keyed = df.withColumn(name, key)
    maybe = keyed.where(listed_maybe(name)).join(losers.select(F.col(listed).alias(name)), name, "left_anti")
    return keyed.where(~listed_maybe(name)).unionByName(maybe).select(*df.columns)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64 on an unsigned 64-bit array."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# Bits taken from one 64-bit hash: 4 bit positions of 6 bits, the block from
# the upper half.
_MASK_SQL = " | ".join(f"shiftleft(1L, cast(shiftrightunsigned({{h}}, {6 * i}) & 63 as int))" for i in range(4))


_CHUNK = 1 << 13


def _packed_words(batches):
    """(chunk, its non-zero words) → the chunk's words as bytes."""
    for b in batches:
        for k, c in enumerate(b.column(0).to_pylist()):
            words = b.column(1).slice(k, 1).flatten()
            full = np.zeros(_CHUNK, dtype=np.int64)
            full[words.field(0).to_numpy() % _CHUNK] = words.field(1).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([full.tobytes()], pa.binary())], ["c", "words"])


class BlockedBloom:
    """One 64-bit word per block; a key sets four bits of one block."""

    def __init__(self, blocks: np.ndarray):
        self.blocks = blocks

    @staticmethod
    def build(df: DataFrame, hash_col: str, n_blocks: int) -> BlockedBloom:
        """Aggregate the masks of all keys per block in Spark and pack them to
        chunks of ``_CHUNK`` words there. What reaches the driver is at most
        8 bytes for each of the ``n_blocks`` words (a parameter, not the data)."""
        block = f"pmod(shiftrightunsigned({hash_col}, 32), {n_blocks}L)"
        rows = (df.where(F.col(hash_col).isNotNull())
                .select(F.expr(block).alias("b"), F.expr(_MASK_SQL.format(h=hash_col)).alias("m"))
                .groupBy("b").agg(F.bit_or("m").alias("m"))
                .groupBy(F.expr(f"b div {_CHUNK}").alias("c")).agg(F.collect_list(F.struct("b", "m")).alias("words"))
                .mapInArrow(_packed_words, "c long, words binary"))
        blocks = np.zeros(-(-n_blocks // _CHUNK) * _CHUNK, dtype=np.uint64)
        for r in rows.collect():
            blocks[r["c"] * _CHUNK: (r["c"] + 1) * _CHUNK] = np.frombuffer(r["words"], dtype=np.uint64)
        blocks = blocks[:n_blocks]
        return BlockedBloom(blocks)

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        h = h.view(np.uint64)
        word = self.blocks[(h >> np.uint64(32)) % np.uint64(len(self.blocks))]
        mask = np.zeros(len(h), dtype=np.uint64)
        for i in range(4):
            mask |= np.uint64(1) << ((h >> np.uint64(6 * i)) & np.uint64(63))
        return (word & mask) == mask


def sorted_runs(batches, n_keys: int = 1):
    """Rows sorted by their first ``n_keys`` columns → one list of numpy column
    arrays per run of equal keys, also across batch borders. The caller bounds
    a run's length; at most one run and one batch are held."""
    held = None
    for b in batches:
        cols = [_numpy(c) for c in b.columns]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        n = len(cols[0])
        if n == 0:
            held = None
            continue
        change = np.zeros(n - 1, dtype=bool)
        for k in cols[:n_keys]:
            change |= k[1:] != k[:-1]
        cuts = np.concatenate([[0], np.flatnonzero(change) + 1])
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            yield [c[i:j] for c in cols]
        held = [c[cuts[-1]:] for c in cols]
    if held is not None:
        yield held


def _numpy(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)
