"""Plan-shape tests: the scale properties the operators are built for."""

from __future__ import annotations

import pytest

from skirmish.plans import catalog

SF_DIR = "/root/testdata/sf0.001"
catalog.load_all()  # the corpus queries may use Python and have their own tests
QUERIES = dict(catalog.QUERIES)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("stream_")))
def test_no_cross_products_or_python(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan, f"{name}: {bad}"


def test_top_n_per_key_is_limited_before_the_shuffle(spark):
    plan = plan_of(QUERIES["last_n_per_role"](spark, SF_DIR))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_match_type_read_prunes_partitions(spark):
    plan = plan_of(QUERIES["read_match_type"](spark, SF_DIR))
    assert "PartitionFilters: [isnotnull(match_type" in plan and "= 2c)" in plan


def test_scans_read_only_needed_columns(spark):
    plan = plan_of(QUERIES["recent_days"](spark, SF_DIR))
    scan = [line for line in plan.splitlines() if "FileScan parquet" in line][0]
    assert "props" not in scan and "ReadSchema" in scan


def test_report_is_one_aggregation_round(spark):
    from pyspark.sql import functions as F

    from skirmish.operators import reports as R
    from skirmish.sources.fixtures import Domain

    t = R.split_team(Domain(spark, SF_DIR).matches)
    rep = R.team_kungfu_report(R.label_teams(t, R.day_team_map(t)))
    plan = plan_of(rep.select("grade", F.col("team_count")))
    assert "pivotfirst" not in plan.lower()


def test_bucketed_tables_join_without_shuffle(spark, tmp_path):
    from skirmish.sources.fixtures import Domain
    from skirmish.sources.tables import write_bucketed

    d = Domain(spark, SF_DIR)
    m = write_bucketed(d.matches.select("match_id", "grade"), "bucketed_matches", "match_id", 4,
                       str(tmp_path / "m"))
    r = write_bucketed(d.match_roles.select("match_id", "role_id"), "bucketed_match_roles", "match_id", 4,
                       str(tmp_path / "r"))
    joined = m.join(r, "match_id")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(joined)
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert joined.count() == d.match_roles.join(d.matches.select("match_id"), "match_id").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("DROP TABLE IF EXISTS bucketed_matches")
        spark.sql("DROP TABLE IF EXISTS bucketed_match_roles")
