"""L1, L2: Structured Streaming forms of the ingest loop.

Both run the batch operator inside ``foreachBatch`` over a file source.
Writes are keyed by the micro-batch id (``batch=<id>`` partition folders,
overwritten on replay), and every read of the target excludes the batch
being written, so a micro-batch that is re-run after a failure produces the
same output: the sinks are idempotent without a MERGE-capable format.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skirmish.operators.maintain import add_counts, fresh_rows, match_keys, participants
from skirmish.operators.ordered import change_log

BATCH_COL = "batch"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def _write_batch(df: DataFrame, path: str, batch: int) -> None:
    """Overwrite exactly the folder of this batch (replay-safe)."""
    df.write.mode("overwrite").parquet(f"{path}/{BATCH_COL}={batch}")


def _batch_ids(spark: SparkSession, path: str) -> list[int]:
    """Batch ids present under ``path`` (folder names ``batch=<id>``; a
    metadata listing on the driver, no data read)."""
    if not _exists(spark, path):
        return []
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = []
    for st in p.getFileSystem(conf).listStatus(p):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith(f"{BATCH_COL}="):
            out.append(int(name.split("=", 1)[1]))
    return sorted(out)


def _landing(spark: SparkSession, schema, path: str, max_files: int | None) -> DataFrame:
    """Arriving files; the size of a micro-batch is Spark's own unless given."""
    reader = spark.readStream.schema(schema)
    return (reader if max_files is None else reader.option("maxFilesPerTrigger", max_files)).parquet(path)


IDS_COL = "ids"           # folder of a range of match ids inside a batch's folder
IDS_WIDTH = 100_000       # ids per folder
REDELIVERY = "7 days"     # how long a delivery is remembered as state


def _write_ranges(df: DataFrame, path: str, batch: int, id_col: str, width: int) -> None:
    """Overwrite this batch's folder, with a folder per range of ids in it."""
    (df.withColumn(IDS_COL, F.expr(f"{id_col} div {width}")).write.mode("overwrite").partitionBy(IDS_COL)
     .parquet(f"{path}/{BATCH_COL}={batch}"))


def target_slice(spark: SparkSession, path: str, batch: int, rows: DataFrame, schema, id_col: str = "match_id",
                 width: int = IDS_WIDTH) -> DataFrame:
    """The target as of before ``batch``, in the id ranges that ``rows`` touch:
    the other folders are pruned. The list of ranges that reaches the driver
    has at most one number per ``width`` ids (matches arrive with growing
    ids, so a batch lies in few)."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    ranges = [r[0] for r in rows.select(F.expr(f"{id_col} div {width}").alias("r")).distinct().where("r IS NOT NULL").collect()]
    return spark.read.parquet(path).where((F.col(BATCH_COL) < batch) & F.col(IDS_COL).isin(ranges)).drop(BATCH_COL, IDS_COL)


def seed(df: DataFrame, path: str, id_col: str = "match_id", width: int = IDS_WIDTH) -> None:
    """Write the initial table as batch 0."""
    _write_ranges(df, path, 0, id_col, width)


def without_redeliveries(src: DataFrame, keys: list[str], keep: str = REDELIVERY) -> DataFrame:
    """``src`` without rows that were delivered with the same content within
    ``keep`` before. Deliveries are held in the state store as (key, hash of
    the row). The watermark runs on the time of arrival, so no row is ever
    late and none is lost; a state entry goes once ``keep`` is over, and what
    is delivered again after that meets the stored table."""
    cols = src.columns
    return (src.withColumn("_arrived", F.current_timestamp()).withColumn("_digest", F.xxhash64(*cols))
            .withWatermark("_arrived", keep).dropDuplicatesWithinWatermark([*keys, "_digest"]).select(*cols))


def stream_insert_matches(spark: SparkSession, landing: str, schema, target: str, checkpoint: str,
                          key: tuple[str, ...] | None = None, max_files: int | None = None, roles_col: str | None = None,
                          roles_target: str | None = None, fetched_deltas: str | None = None, id_col: str = "match_id",
                          width: int = IDS_WIDTH, keep: str = REDELIVERY) -> StreamingQuery:
    """L1: the ingest of I2 as a stream. Arriving match rows are inserted
    when their key is absent; with ``roles_col`` (J9's participant array)
    the participant rows of the inserted matches go to ``roles_target`` and
    the per-(role, match type) count of new participations to
    ``fetched_deltas`` (apply them with ``apply_fetched_deltas``).

    Re-deliveries are dropped by streaming state; the rest meets the stored
    table in the id ranges of the batch only. Every output is written as the
    batch's own folder, so a replayed batch rewrites the same rows."""

    def batch(df: DataFrame, epoch_id: int) -> None:
        b = epoch_id + 1
        rows = df.persist()  # read for its id ranges and for the insert
        fresh = None
        try:
            fresh = fresh_rows(target_slice(spark, target, b, rows, schema, id_col, width), rows, list(key or match_keys(rows)))
            if roles_col is None:
                _write_ranges(fresh, target, b, id_col, width)
                return
            fresh = fresh.persist()  # used by three writes; recomputed from the batch if lost
            _write_ranges(fresh.drop(roles_col), target, b, id_col, width)
            parts = participants(fresh, roles_col)
            if roles_target:
                _write_batch(parts, roles_target, b)
            if fetched_deltas:
                _write_batch(parts.groupBy("role_id", "match_type").agg(F.count(F.lit(1)).alias("n")), fetched_deltas, b)
        finally:
            if fresh is not None:
                fresh.unpersist()
            rows.unpersist()

    src = _landing(spark, schema, landing, max_files)
    keys = list(key or match_keys(src))
    return (without_redeliveries(src, keys, keep).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def apply_fetched_deltas(scores: DataFrame, deltas: DataFrame) -> DataFrame:
    """I2's counter: fetched_count raised by the recorded new participations
    (NULL + n stays NULL, as the reference's increment does)."""
    n = deltas.groupBy("role_id", "match_type").agg(F.sum("n").alias("_n"))
    return add_counts(scores, n)


SNAPSHOT_EVERY = 10  # batches between full state snapshots


def stream_passport_changes(spark: SparkSession, landing: str, schema, log: str, state: str, checkpoint: str,
                            null_safe: bool = False, max_files: int | None = None,
                            snapshot_every: int = SNAPSHOT_EVERY) -> StreamingQuery:
    """L2: the passport change log with the last row per role kept as state.

    Per micro-batch: the state rows of the keys in the batch are put in
    front of the batch rows, the change rule (E8) runs over both, and only
    batch rows are logged. State is kept as per-batch deltas (last row per
    key of that batch) plus a full snapshot every ``snapshot_every`` batches;
    a batch reads the latest snapshot before it and the deltas after that,
    so the state read does not grow with the stream's history."""
    keys, order = ["global_id"], ["inserted_at", "event_id"]
    cols = ["global_id", "passport_id", "inserted_at", "event_id"]
    last_of = lambda df: (df.groupBy(*keys)
                          .agg(F.max_by(F.struct("passport_id", "inserted_at", "event_id"), F.struct(*order)).alias("s"))
                          .select(*keys, "s.*"))

    def state_before(b: int, rows_schema) -> DataFrame:
        snaps = [i for i in _batch_ids(spark, f"{state}/snap") if i < b]
        base = snaps[-1] if snaps else 0
        parts = []
        if snaps:
            parts.append(spark.read.parquet(f"{state}/snap/{BATCH_COL}={base}"))
        deltas = [i for i in _batch_ids(spark, f"{state}/delta") if base <= i < b]
        if deltas:
            parts.append(spark.read.parquet(f"{state}/delta").where(F.col(BATCH_COL).isin(deltas)).drop(BATCH_COL))
        if not parts:
            return spark.createDataFrame([], rows_schema)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return last_of(out)

    def batch(df: DataFrame, epoch_id: int) -> None:
        b = epoch_id + 1
        rows = df.select(*cols)
        last = state_before(b, rows.schema)
        touched = last.join(rows.select(*keys).distinct(), keys, "left_semi")
        both = touched.withColumn("_old", F.lit(True)).unionByName(rows.withColumn("_old", F.lit(False)))
        logged = change_log(both, "global_id", "passport_id", order, null_safe=null_safe)
        _write_batch(logged.where(~F.col("_old")).select("global_id", "passport_id", "inserted_at"), log, b)
        delta = last_of(rows)
        _write_batch(delta, f"{state}/delta", b)
        if b % snapshot_every == 0:
            _write_batch(last_of(last.unionByName(delta)), f"{state}/snap", b)

    src = _landing(spark, schema, landing, max_files)
    return (src.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A streamed table as a whole (all batch folders)."""
    return spark.read.parquet(path).drop(BATCH_COL, IDS_COL)
