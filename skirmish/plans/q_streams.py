"""Queries for L1/L2: land the driver-derived rows in two files (the second
re-delivers the first half, to exercise idempotence), stream them through
``foreachBatch`` to completion, and return the resulting table."""

from __future__ import annotations

from pyspark.sql import functions as F

from skirmish.functions.scalars import epoch_seconds
from skirmish.plans.catalog import query
from skirmish.plans.q_ordered import HALF_MONTH, PASSPORT_SQL
from skirmish.plans.q_reports import MATCH_COLS_SQL, flat_matches
from skirmish.session import scratch_path
from skirmish.sources.fixtures import Domain
from skirmish.streaming import streams as L


def _land(df, path: str, parts: list) -> None:
    for i, cond in enumerate(parts):
        df.where(cond).write.mode("overwrite").parquet(f"{path}/file={i}")


def _run_insert_stream(spark, sf):
    """Seed the first half of the month, land everything (second half, then
    all again), and stream it through the I2 batch; returns the folders."""
    from skirmish.operators.joins import nest

    d = Domain(spark, sf)
    base = scratch_path(spark, "stream-matches")
    cut = epoch_seconds(F.lit(HALF_MONTH))
    m = nest(d.matches, d.match_roles.select("match_id", "role_id", "seat", "team", "kungfu", "score2", "inserted_at"),
             "match_id", "roles", how="inner")
    L.seed(d.matches.where(F.col("start_time") < cut), f"{base}/target")
    landing = f"{base}/landing"
    # file 0: second half; file 1: everything again (duplicates of both halves)
    _land(m, landing, [F.col("start_time") >= cut, F.lit(True)])
    q = L.stream_insert_matches(spark, f"{landing}/*", m.schema, f"{base}/target", f"{base}/ckpt",
                                roles_col="roles", roles_target=f"{base}/roles", fetched_deltas=f"{base}/deltas")
    q.awaitTermination()
    return d, base


@query("stream_insert_matches", f"SELECT {MATCH_COLS_SQL} FROM matches")
def q_stream_insert_matches(spark, sf):
    _d, base = _run_insert_stream(spark, sf)
    return flat_matches(L.read_table(spark, f"{base}/target"))


@query("stream_insert_matches_scores", f"""
WITH n AS (SELECT mr.role_id, mr.match_type, count(*) AS n FROM match_roles mr
           JOIN matches m ON m.match_id = mr.match_id WHERE m.start_time >= epoch(TIMESTAMP '{HALF_MONTH}')
           GROUP BY mr.role_id, mr.match_type)
SELECT s.role_id, s.match_type, CAST(CASE WHEN n.n IS NULL THEN s.fetched_count ELSE s.fetched_count + n.n END AS INTEGER)
  AS fetched_count
FROM scores s LEFT JOIN n ON n.role_id = s.role_id AND n.match_type = s.match_type""")
def q_stream_insert_matches_scores(spark, sf):
    d, base = _run_insert_stream(spark, sf)
    return L.apply_fetched_deltas(d.scores, L.read_table(spark, f"{base}/deltas")).select(
        "role_id", "match_type", "fetched_count")


@query("stream_passport_changes", PASSPORT_SQL.format(cmp="passport_id <> prev"))
def q_stream_passport_changes(spark, sf):
    d = Domain(spark, sf)
    base = scratch_path(spark, "stream-passports")
    u = d.role_updates
    half = F.lit(HALF_MONTH).cast("timestamp_ntz")
    _land(u, f"{base}/landing", [F.col("inserted_at") < half, F.col("inserted_at") >= half])
    q = L.stream_passport_changes(spark, f"{base}/landing/*", u.schema, f"{base}/log", f"{base}/state", f"{base}/ckpt")
    q.awaitTermination()
    return L.read_table(spark, f"{base}/log")
