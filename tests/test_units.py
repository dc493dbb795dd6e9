"""Hand-made cases for the quirks and invariants."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from skirmish.functions import scalars as H
from skirmish.functions.kungfu import kungfu_items, lineup_labels
from skirmish.functions.ranges import in_range, make_range
from skirmish.operators import filters as B
from skirmish.operators import joins as C
from skirmish.operators import maintain as M
from skirmish.operators import ordered as E
from skirmish.operators import replay as P
from skirmish.operators import reports as R
from skirmish.sources.dimension import class_dimension

MATCH_SCHEMA = ("match_id long, grade int, pvp_type int, start_time long, winner int, "
                "team1_kungfu array<int>, team2_kungfu array<int>, role_ids array<string>, "
                "team1_score int, team2_score int")


def d(s: str) -> dt.date:
    return dt.date.fromisoformat(s)


def matches_df(spark, rows):
    return spark.createDataFrame(rows, MATCH_SCHEMA)


# --------------------------------------------------------------------- G1 / Q1
def test_split_team_unequal_null_empty_and_mirror(spark):
    m = matches_df(spark, [
        (1, 5, 3, 0, 1, [1, 2], [3, 4], ["a", "b", "c", "d"], 10, 5),      # normal
        (2, 5, 3, 0, 2, [1], [3, 4], ["a", "b", "c"], 1, 2),               # unequal teams: kept (Q1 fixed)
        (3, 5, 3, 0, 1, None, [3], ["a"], 1, 0),                           # NULL array: dropped
        (4, 5, 3, 0, 1, [], [], [], 0, 0),                                 # empty teams: kept, empty sides
        (5, 5, 3, 0, None, [1, 2], [1, 2], ["a", "b", "a", "b"], 3, 3),    # mirror, NULL winner
        (6, 5, 3, 0, 1, [1, 2], [3, 4], ["a", "b", "c"], 1, 0),            # size mismatch: dropped
    ])
    t = R.split_team(m)
    got = {(r.match_id, tuple(r.role_ids), tuple(r.anta_role_ids), r.won) for r in t.collect()}
    assert (2, ("a",), ("b", "c"), False) in got and (2, ("b", "c"), ("a",), True) in got
    assert not {g for g in got if g[0] in (3, 6)}
    assert (4, (), (), True) in got
    mirror = [g for g in got if g[0] == 5]
    assert t.where("match_id = 5").count() == 2 and all(g[3] is None for g in mirror)
    # invariant: G1 doubles the row count of guarded matches
    assert t.count() == 2 * R.size_guard(m).count()


def test_won_sum_matches_winners(spark):
    m = matches_df(spark, [(i, 1, 3, 0, 1 + i % 2, [1], [2], ["x", "y"], 1, 0) for i in range(10)])
    t = R.split_team(m)
    assert t.where("won").count() == m.where("winner in (1, 2)").count()


# --------------------------------------------------------------------- H2 / Q14
def test_labels_exception_pair_and_unknown(spark):
    items = spark.createDataFrame(
        [("kungfu", "1", '"jingyu"'), ("kungfu", "2", '"tianluo"'), ("kungfu", "3", '"mowen"'),
         ("kungfu", "4", '"taixu"')], "tag string, id string, content string")
    ki = kungfu_items(items, class_dimension(spark))
    df = spark.createDataFrame([([3, 1, 2],), ([1, 3],), ([4, 99],), ([],), (None,)], "k array<int>")
    got = {tuple(r.k) if r.k is not None else None: r.short for r in lineup_labels(df, "k", ki).collect()}
    # jingyu moves just before tianluo when both are present; mowen after tianluo
    assert got[(3, 1, 2)] == "鲸螺莫"
    # without tianluo: plain rank order (mowen 9 before jingyu 13)
    assert got[(1, 3)] == "莫鲸"
    assert got[(4, 99)] == "剑?"
    assert got[()] == ""
    assert got[None] is None

def test_labels_start_no_job_while_planned(spark):
    """The class items are read when the labels are, not before."""
    ki = kungfu_items(spark.createDataFrame([("kungfu", "1", '"jingyu"')], "tag string, id string, content string"), class_dimension(spark))
    df = spark.createDataFrame([([1],)], "k array<int>")
    never = ki.where(F.raise_error(F.lit("read")).isNull())
    out = lineup_labels(df, "k", never)
    assert out.columns == ["k", "short"]
    with pytest.raises(Exception, match="read"):
        out.collect()


# --------------------------------------------------------------------- D6 / Q7
def test_report_counts_add_up_and_null_cells(spark):
    m = matches_df(spark, [(i, 1, 3, 86400 * (i % 2), 1, [1, 2], [3, 4], ["a", "b", "c", "d"], 1, 0)
                           for i in range(10)])
    t = R.split_team(m)
    lab = R.label_teams(t, R.day_team_map(t))
    rep = R.team_kungfu_report(lab)
    tot = rep.select(F.sum(F.col("team_count") + F.col("person_count"))).first()[0]
    assert tot == lab.count()
    m2 = matches_df(spark, [(1, 1, 3, 0, 1, [1], [2], ["a", "b"], 1, 0)])
    r2 = R.team_kungfu_report(R.label_teams(R.split_team(m2), R.day_team_map(R.split_team(m2)))).collect()
    assert all(r.team_count == 0 and r.team_win is None for r in r2)


# --------------------------------------------------------------------- H17 / Q17, C7 / Q4
def test_win_rate_zero_and_null_total(spark):
    df = spark.createDataFrame([(1, 0), (1, None), (1, 3)], "w long, t long")
    got = [r.r for r in df.select(H.win_rate("w", "t").alias("r")).collect()]
    assert got == [None, None, 0.333]


def test_top_roles_null_score_edge(spark):
    roles = spark.createDataFrame([(str(i), f"n{i}", "f") for i in range(4)], "global_id string, name string, force string")
    scores = spark.createDataFrame([("0", "3c", None, 1, 1, 4), ("1", "3c", 2000, 2, 1, 2), ("2", "3c", 2000, 2, 2, 2),
                                    ("3", "3c", 1000, 1, 0, None)],
                                   "role_id string, match_type string, score int, total_count long, win_count long, "
                                   "ranking int")
    top = C.top_roles(roles, scores, limit=2).collect()
    # position is the place in the list; ranking is the score row's own (ties allowed)
    assert [(r.role_id, r.position, r.ranking) for r in top] == [("1", 1, 2), ("2", 2, 2)]
    top_nf = C.top_roles(roles, scores, limit=2, keep_null_scores=True).collect()
    assert [r.role_id for r in top_nf] == ["0", "1"]


# --------------------------------------------------------------------- A5 / K1 / Q10
def test_replay_good_bad_blank_null_empty(spark):
    logs = spark.createDataFrame([
        (1, '{"replay":[{"ts":1,"skillName":"a"}],"players":[],"match_id":1,"match_duration":9}'),
        (2, '{"replay": [oops'), (3, "   "), (4, None), (5, '{"replay":[],"match_id":5}')],
        "match_id long, replay string")
    p = P.parse_replay(logs)
    got = {r.match_id: (r.match_duration, r.f)
           for r in p.select("match_id", "match_duration", P.first_skill().alias("f")).collect()}
    assert set(got) == {1, 2, 5}
    assert got[1] == (9, "a") and got[2] == (None, None) and got[5] == (None, None)


# --------------------------------------------------------------------- H11 / Q15
def test_parse_ranking(spark):
    df = spark.createDataFrame([("7",), ("12%",), ("-",), (None,), ("x",)], "r string")
    assert [r.v for r in df.select(H.parse_ranking("r").alias("v")).collect()] == [7, -12, None, None, None]


# --------------------------------------------------------------------- E6/E7/H14 / Q12
def ranges_df(spark, rows):
    df = spark.createDataFrame(rows, "k int, lo date, up date, ui boolean")
    return df.select("k", make_range("lo", "up", True, F.col("ui")).alias("seen"))


def merged(spark, rows):
    out = E.merge_seen_ranges(ranges_df(spark, rows), ["k"])
    return sorted((r.k, r.seen.lower, r.seen.upper) for r in out.collect())


def test_date_ranges(spark):
    # gap day stays a gap; adjacent merges; inclusive upper counts its day
    assert merged(spark, [(1, d("2024-01-01"), d("2024-01-03"), False), (1, d("2024-01-04"), d("2024-01-05"), False)]) == \
        [(1, d("2024-01-01"), d("2024-01-03")), (1, d("2024-01-04"), d("2024-01-05"))]
    assert merged(spark, [(1, d("2024-01-01"), d("2024-01-03"), False), (1, d("2024-01-03"), d("2024-01-05"), False)]) == \
        [(1, d("2024-01-01"), d("2024-01-05"))]
    assert merged(spark, [(1, d("2024-01-01"), d("2024-01-02"), True), (1, d("2024-01-03"), d("2024-01-05"), False)]) == \
        [(1, d("2024-01-01"), d("2024-01-05"))]
    # unbounded bounds swallow everything on their side; equal uppers collapse
    assert merged(spark, [(1, None, d("2024-01-02"), False), (1, d("2024-01-01"), None, False)]) == [(1, None, None)]
    assert merged(spark, [(1, d("2024-01-01"), d("2024-01-05"), False), (1, d("2024-01-03"), d("2024-01-05"), False)]) == \
        [(1, d("2024-01-01"), d("2024-01-05"))]


def test_add_seen_day_bridges_and_is_idempotent(spark):
    base = E.merge_seen_ranges(ranges_df(spark, [(1, d("2024-01-01"), d("2024-01-02"), False),
                                                 (1, d("2024-01-03"), d("2024-01-04"), False)]), ["k"])
    day = spark.createDataFrame([(1, d("2024-01-02"))], "k int, day date")
    once = E.add_seen_days(base, day, ["k"])
    assert [(r.seen.lower, r.seen.upper) for r in once.collect()] == [(d("2024-01-01"), d("2024-01-04"))]
    twice = E.add_seen_days(once, day, ["k"])
    assert sorted(map(str, twice.collect())) == sorted(map(str, once.collect()))
    inside = spark.createDataFrame([(d("2024-01-03"),), (d("2024-01-04"),), (d("2024-01-10"),)], "day date")
    r = make_range(F.lit("2024-01-01").cast("date"), F.lit("2024-01-03").cast("date"), True, True)
    assert [x.v for x in inside.select(in_range(r, "day").alias("v")).collect()] == [True, False, False]


# --------------------------------------------------------------------- E8 / Q13
def test_passport_changes_null_rules(spark):
    rows = [("g", None, 1), ("g", "a", 2), ("g", "a", 3), ("g", None, 4), ("g", "b", 5), ("h", "x", 1)]
    df = spark.createDataFrame([(g, p, dt.datetime(2024, 1, 1 + t), t) for g, p, t in rows],
                               "global_id string, passport_id string, inserted_at timestamp_ntz, event_id long")
    default = sorted((r.global_id, r.passport_id) for r in E.passport_changes(df).collect())
    # NULL → a is not logged (NULL <> 'a' is NULL); value → NULL never logged; NULL → b not logged
    assert default == [("h", "x")]
    safe = sorted((r.global_id, r.passport_id) for r in E.passport_changes(df, null_safe=True).collect())
    assert safe == [("g", "a"), ("g", "b"), ("h", "x")]


def test_change_log_spans_buckets(spark):
    # the same key across days (buckets): the first row of a day compares with the previous day
    rows = [("g", "a", dt.datetime(2024, 1, 1)), ("g", "a", dt.datetime(2024, 1, 2)), ("g", "b", dt.datetime(2024, 1, 3))]
    df = spark.createDataFrame([(g, p, t, i) for i, (g, p, t) in enumerate(rows)],
                               "global_id string, passport_id string, inserted_at timestamp_ntz, event_id long")
    assert [r.passport_id for r in E.passport_changes(df).orderBy("inserted_at").collect()] == ["a", "b"]


# --------------------------------------------------------------------- I1
def test_upsert_null_keeps_old_and_two_updates(spark):
    t = spark.createDataFrame([("k1", 1, "x"), ("k2", 2, "y")], "k string, a int, b string")
    u = spark.createDataFrame([("k1", None, "z", 1), ("k1", 5, None, 2), ("k3", 7, None, 1)],
                              "k string, a int, b string, seq int")
    out = {r.k: (r.a, r.b) for r in M.upsert(t, u, ["k"], order="seq").collect()}
    assert out == {"k1": (5, "z"), "k2": (2, "y"), "k3": (7, None)}
    again = M.upsert(M.upsert(t, u, ["k"], order="seq"), u, ["k"], order="seq")
    assert {r.k: (r.a, r.b) for r in again.collect()} == out


# --------------------------------------------------------------------- E5
def test_infer_teams_statuses(spark):
    m = spark.createDataFrame([(1, [1, 2], [3], 10, 5), (2, [1], [2], 1, 1), (3, [1], [2], 1, 1), (4, [1], [9], 3, 1)],
                              "match_id long, team1_kungfu array<int>, team2_kungfu array<int>, team1_score int, team2_score int")
    ts = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    mr = spark.createDataFrame([
        (1, "a", 2, 6, ts(1)), (1, "b", 1, 4, ts(2)), (1, "c", 3, 5, ts(3)),   # fixed (team 1 sorted {1,2})
        (2, "a", 1, 1, ts(1)),                                                 # size mismatch
        (3, "a", 1, 0, ts(1)), (3, "b", 2, 1, ts(2)),                          # score mismatch
        (4, "a", 1, 3, ts(1)), (4, "b", 2, 1, ts(2)),                          # kungfu mismatch
    ], "match_id long, role_id string, kungfu int, score2 int, inserted_at timestamp_ntz")
    got = {r.match_id: (r.status, list(r.role_ids)) for r in E.infer_teams(mr, m).collect()}
    assert got[1] == ("fixed", ["a", "b", "c"])
    assert got[2][0] == "size_mismatch" and got[3][0] == "score_mismatch" and got[4][0] == "kungfu_mismatch"


# --------------------------------------------------------------------- E10
def test_dictionary_versions_dense(spark):
    known = spark.createDataFrame([("t", "a", 0), ("t", "b", 1)], "tag string, value string, id long")
    vals = spark.createDataFrame([("t", "c", 5), ("t", "a", 1), ("t", "d", 3), ("t", "c", 9), ("u", "z", 1)],
                                 "tag string, value string, seq long")
    out = sorted((r.tag, r.value, r.id) for r in E.dictionary_versions(known, vals, "seq").collect())
    assert out == [("t", "a", 0), ("t", "b", 1), ("t", "c", 3), ("t", "d", 2), ("u", "z", 0)]


# --------------------------------------------------------------------- B9/B10
def test_predicates(spark):
    df = spark.createDataFrame([(1, "2", "little"), (3, "2", "big")], "role_id int, global_id string, body_type string")
    assert B.where_text(df, 'x1.role_id < x1.global_id and x1.body_type == "little"').count() == 1
    with pytest.raises(ValueError):
        B.where_text(df, "role_id in (select 1)")
    with pytest.raises(ValueError):
        B.where_text(df, "java_method('java.lang.System', 'exit', 0) is null")
    for text, n in [("x1.role_id in (1, 12)", 1), ("x1.body_type <> 'from'", 2), ("exists(array(role_id), x -> x > 1)", 1),
                    ("x1.body_type like '%select%' or role_id between 2 and 4", 1)]:
        assert B.where_text(df, text).count() == n, text
    df.createOrReplaceTempView("tg")
    for text in ["x1.role_id = (table tg limit 1)", "exists (select 1)", "system.builtin.reflect('java.lang.System', 'exit', 0) is null",
                 "`java_method`('java.lang.System', 'exit', 0) is null", "count(*) > 1", "sum(role_id) over (order by role_id) > 1",
                 "identifier('role_id') = 1", ":p = 1", "role_id in (1, (select max(role_id) from tg))", "input_file_name() = ''"]:
        with pytest.raises(ValueError):
            B.where_text(df, text)
    assert B.where_list(df, [("body_type", B.Lit("big")), (("role_id", "+", 1), ">", 3)]).count() == 1


def test_scalars_misc(spark):
    df = spark.createDataFrame([(12345, 999, "电信一区", None)], "n long, small long, zone string, z2 string")
    r = df.select(H.pad_int("n", 3).alias("p"), H.humanize_count("n").alias("h"), H.humanize_count("small").alias("s"),
                  H.zone_suffix("zone").alias("zs"), H.zone_suffix("z2").alias("zn"), H.zone_suffix_sql("z2").alias("zq"),
                  H.default_match_type("z2").alias("dm")).first()
    assert (r.p, r.h, r.s, r.zs, r.zn, r.zq, r.dm) == ("12345", "12.3K", "999", "c", "", "m", "3c")
    g = spark.createDataFrame([(None,), (950,), (2399,), (5000,)], "s int").select(H.grade_of_score("s").alias("g"))
    assert [x.g for x in g.collect()] == [None, 0, 13, 13]


# --------------------------------------------------------------------- H13, time zones
def test_epoch_conversions_ignore_session_zone(spark):
    rows = [(dt.datetime(2024, 3, 10, 2, 30, 0, 250000),), (dt.datetime(1999, 12, 31, 23, 59, 59),)]
    df = spark.createDataFrame(rows, "t timestamp_ntz")
    expect = [int((r[0] - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000) for r in rows]
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for tz in ("UTC", "America/Los_Angeles", "Asia/Shanghai"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            got = df.select(H.epoch_micros("t").alias("us"), H.start_time(H.epoch_seconds("t")).alias("back")).collect()
            assert [g.us for g in got] == expect
            assert [g.back for g in got] == [r[0].replace(microsecond=0) for r in rows]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


# --------------------------------------------------------------------- L1 / L2
def test_stream_insert_is_idempotent_on_replay(spark, tmp_path):
    from skirmish.streaming import streams as L

    schema = "match_id long, v string"
    land = str(tmp_path / "landing")
    spark.createDataFrame([(1, "a"), (2, "b")], schema).coalesce(1).write.parquet(f"{land}/f=0")
    spark.createDataFrame([(2, "b"), (3, "c")], schema).coalesce(1).write.parquet(f"{land}/f=1")
    target = str(tmp_path / "target")
    L.seed(spark.createDataFrame([(1, "a")], schema), target)
    for ck in ("ck1", "ck2"):  # the second run replays every batch (lost checkpoint)
        L.stream_insert_matches(spark, f"{land}/*", spark.createDataFrame([], schema).schema, target,
                                str(tmp_path / ck)).awaitTermination()
        got = sorted((r.match_id, r.v) for r in L.read_table(spark, target).collect())
        assert got == [(1, "a"), (2, "b"), (3, "c")]


def test_stream_passport_state_across_batches(spark, tmp_path):
    from skirmish.streaming import streams as L

    schema = "event_id long, global_id string, passport_id string, inserted_at timestamp_ntz"
    t = lambda d: dt.datetime(2024, 1, d)
    land = str(tmp_path / "landing")
    spark.createDataFrame([(1, "g", "a", t(1)), (2, "g", "a", t(2))], schema).coalesce(1).write.parquet(f"{land}/f=0")
    spark.createDataFrame([(3, "g", "a", t(3)), (4, "g", "b", t(4)), (5, "h", "x", t(4))], schema) \
        .coalesce(1).write.parquet(f"{land}/f=1")
    s = spark.createDataFrame([], schema).schema
    spark.createDataFrame([(6, "g", "b", t(5)), (7, "h", "y", t(6))], schema).coalesce(1).write.parquet(f"{land}/f=2")
    for every in (10, 2):  # without and with a snapshot (after batch 2)
        L.stream_passport_changes(spark, f"{land}/*", s, str(tmp_path / f"log{every}"), str(tmp_path / f"state{every}"),
                                  str(tmp_path / f"ck{every}"), snapshot_every=every).awaitTermination()
        got = sorted((r.global_id, r.passport_id) for r in L.read_table(spark, str(tmp_path / f"log{every}")).collect())
        # 'a' is logged once (the repeat in batch 2 compares with the state), 'b' once, 'x' then 'y'
        assert got == [("g", "a"), ("g", "b"), ("h", "x"), ("h", "y")]


def test_change_log_keeps_null_keys_and_times(spark):
    rows = [(1, None, "a", dt.datetime(2024, 1, 1)), (2, None, "b", dt.datetime(2024, 1, 2)),
            (3, "g", "a", None), (4, "g", "a", dt.datetime(2024, 1, 1))]
    df = spark.createDataFrame(rows, "event_id long, global_id string, passport_id string, inserted_at timestamp_ntz")
    got = sorted((r.global_id or "", r.passport_id, r.event_id)
                 for r in E.change_log(df, "global_id", "passport_id", ["inserted_at", "event_id"]).collect())
    assert got == [("", "a", 1), ("", "b", 2), ("g", "a", 3)]


def test_route_roles_text_or_number_level(spark):
    df = spark.createDataFrame([("a", "100"), ("b", " 100"), ("c", "99"), ("d", None), ("e", "x")],
                               "global_id string, level string")
    full, lamb = M.route_roles(df)
    assert sorted(r.global_id for r in full.collect()) == ["a", "b"]
    assert sorted(r.global_id for r in lamb.collect()) == ["c", "d", "e"]


def test_stats_merge_drops_only_zero_totals(spark):
    metrics = spark.createDataFrame([("k1", 0, 1), ("k2", None, 2), ("k3", 5, 3), ("k4", 0, 4)],
                                    "kungfu string, total_count int, win_count int")
    skills = spark.createDataFrame([("k4", 7), ("k5", 8)], "kungfu string, skill_count int")
    out = sorted(r.kungfu for r in C.kungfu_stats_merge(metrics, skills, role_id="r", match_type="3c").collect())
    assert out == ["k2", "k3", "k4", "k5"]


def test_mean_team_score_truncates_toward_zero(spark):
    df = spark.createDataFrame([(7,), (-7,), (None,)], "s int")
    assert [r.m for r in df.select(H.mean_team_score("s").alias("m")).collect()] == [2, -2, None]


def test_insert_matches_is_idempotent(spark):
    m_schema = "match_id long, match_type string, grade int"
    mr_schema = "match_id long, role_id string, kungfu int, match_type string"
    s_schema = "role_id string, match_type string, fetched_count int"
    matches = spark.createDataFrame([(1, "3c", 5)], m_schema)
    mroles = spark.createDataFrame([(1, "a", 10, "3c")], mr_schema)
    scores = spark.createDataFrame([("a", "3c", 1), ("b", "3c", None), ("c", "3c", 0)], s_schema)
    new = spark.createDataFrame([(1, "3c", 5, [("a", 10)]), (2, "3c", 6, [("b", 11), ("c", 12)]),
                                 (2, "3c", 6, [("b", 11), ("c", 12)])],
                                "match_id long, match_type string, grade int, roles array<struct<role_id:string,kungfu:int>>")
    m2, mr2, s2 = M.insert_matches(matches, mroles, scores, new)
    assert sorted(r.match_id for r in m2.collect()) == [1, 2]
    assert sorted((r.match_id, r.role_id) for r in mr2.collect()) == [(1, "a"), (2, "b"), (2, "c")]
    # b's NULL count stays NULL (NULL + 1), c counts its one new participation
    assert sorted((r.role_id, r.fetched_count) for r in s2.collect()) == [("a", 1), ("b", None), ("c", 1)]
    m3, mr3, s3 = M.insert_matches(m2, mr2, s2, new)
    assert sorted(map(str, m3.collect())) == sorted(map(str, m2.collect()))
    assert sorted(map(str, mr3.collect())) == sorted(map(str, mr2.collect()))
    assert sorted(map(str, s3.collect())) == sorted(map(str, s2.collect()))


def test_kungfu_usage_order_and_heads(spark):
    recent = spark.createDataFrame([("r", k) for k in [1, 1, 2, 2, 3, 9, 9]], "role_id string, kungfu int")
    ki = spark.createDataFrame([(1, "zixia"), (2, "aoxue"), (3, "taixu")], "id int, content string")
    most = E.kungfu_usage_per_role(recent, ki, pick="most").first()
    # sorted by (count, name, id): taixu 1; unknown(9) 2 (NULL name first); aoxue 2; zixia 2
    assert [(u["count"], u["name"], u["kungfu"]) for u in most.usage] == \
        [(1, "taixu", 3), (2, None, 9), (2, "aoxue", 2), (2, "zixia", 1)]
    assert (most.head_kungfu, most.head_name) == (9, None)
    least = E.kungfu_usage_per_role(recent, ki, pick="least").first()
    assert (least.head_kungfu, least.head_name) == (3, "taixu")


def test_stream_insert_counts_are_replay_safe(spark, tmp_path):
    from skirmish.streaming import streams as L

    schema = "match_id long, match_type string, roles array<struct<role_id:string,kungfu:int>>"
    land = str(tmp_path / "landing")
    spark.createDataFrame([(1, "3c", [("a", 1), ("b", 2)])], schema).coalesce(1).write.parquet(f"{land}/f=0")
    spark.createDataFrame([(1, "3c", [("a", 1), ("b", 2)]), (2, "3c", [("a", 3)])], schema) \
        .coalesce(1).write.parquet(f"{land}/f=1")
    s = spark.createDataFrame([], schema).schema
    scores = spark.createDataFrame([("a", "3c", 5), ("b", "3c", None)], "role_id string, match_type string, fetched_count int")
    for ck in ("ck1", "ck2"):  # the second run replays both batches
        L.stream_insert_matches(spark, f"{land}/*", s, str(tmp_path / "t"), str(tmp_path / ck), roles_col="roles",
                                roles_target=str(tmp_path / "r"), fetched_deltas=str(tmp_path / "d")).awaitTermination()
        got = {r.role_id: r.fetched_count for r in
               L.apply_fetched_deltas(scores, L.read_table(spark, str(tmp_path / "d"))).collect()}
        assert got == {"a": 7, "b": None}
        assert sorted((r.match_id, r.role_id) for r in L.read_table(spark, str(tmp_path / "r")).collect()) == \
            [(1, "a"), (1, "b"), (2, "a")]


def test_upsert_and_insert_of_a_batch(spark):
    t = spark.createDataFrame([(f"k{i}", i, "x") for i in range(20)], "k string, a int, b string")
    u = spark.createDataFrame([("k1", None, "y", 1), ("k1", 9, None, 2), ("k99", 5, None, 1)],
                              "k string, a int, b string, seq int")
    new = spark.createDataFrame([("k3", 0, "n"), ("k50", 1, "n"), ("k50", 1, "n")], "k string, a int, b string")
    small_up = sorted(map(tuple, M.upsert(t, u, ["k"], order="seq").collect()))
    small_ins = sorted(map(tuple, M.insert_if_absent(t, new, ["k"]).collect()))
    assert ("k1", 9, "y") in small_up and ("k99", 5, None) in small_up and len(small_up) == 21
    assert len(small_ins) == 21


# --------------------------------------------------------------------- J
def test_payload_edge_cases(spark):
    from skirmish.sources import payloads as J

    top = spark.createDataFrame([('[{"passportId":"","globalId":"g1","personId":"p","personInfo":{"gameRoleId":"",'
                                  '"roleName":"n","person":{"nickName":"","avatarUrl":"a"}}}]',)], "payload string")
    r = J.flatten_top200(top).first()
    assert (r.passport_id, r.global_id, r.role_id, r.name, r.person_name, r.avatar) == (None, "g1", None, "n", None, "a")
    gid = spark.createDataFrame([('{"passportId":"x","personId":"p"}',), ('{"personInfo":{"gameGlobalRoleId":"g",'
                                 '"gameRoleId":"12"},"personId":"p"}',)], "payload string")
    rows = J.flatten_role_by_gid(gid).collect()
    assert [(x.global_id, x.role_id) for x in rows] == [("g", 12)]
    rep = spark.createDataFrame([("3c", '{"error": "No data found"}'), ("3c", None),
                                 ("3c", '{"match_id": 5, "replay": [], "skill_cate": [1]}')],
                                "match_type string, payload string")
    out = J.flatten_match_replay(rep).collect()
    assert [(x.match_id, x.match_type) for x in out] == [(5, "3c")] and "skill_cate" not in J.flatten_match_replay(rep).columns
    det = spark.createDataFrame([("3c", '{"match_id": 7, "basic_info": {"map": "x3", "type": 3}, '
                                        '"team1": {"won": null, "players_info": [{"global_role_id": "a", "score": 250, '
                                        '"kungfu_id": 2, "equip_strength_score": 1, "stone_score": 2}]}}')],
                                "match_type string, payload string")
    m, roles = J.flatten_match_detail(det)
    mr = m.first()
    # unparsable map → NULL; missing team 2 → empty side; NULL team1.won → winner 2
    assert (mr.map, mr.team1_score, mr.team2_score, mr.winner, mr.team2_kungfu) == (None, 250, 0, 2, [])
    pr = roles.first()
    assert (pr.global_id, pr.team, pr.grade, pr.equip_addition_score) == ("a", 1, 0, 3)


def test_number_prefix_rules(spark):
    df = spark.createDataFrame([("12.5%",), ("7",), ("12.%",), (" 3",), (".5",), ("-2e3x",)], "v string")
    r = df.select(H.percent_name(F.lit("n"), "v").alias("p"), H.parse_attrs(F.array("v"))[0].alias("a")).collect()
    # a number must start the text; a fraction needs digits (as the reference's float parse)
    assert [(x.p, x.a) for x in r] == [("n%", 12.5), ("n", 7.0), ("n.%", 12.0), ("n", None), ("n", None), ("nx", -2000.0)]
    urls = spark.createDataFrame([("https://cdn/x/a.png?v=1",), ("see https://cdn/x/b.png",), ("other",)], "u string")
    assert [x.t for x in urls.select(H.icon_url_trim("u", "https://cdn/x/").alias("t")).collect()] == ["a.png", "b.png", "other"]


def test_encode_key_order(spark):
    df = spark.createDataFrame([('"abc"',), ('"12"',), (":name",), ("42",), ('"x',), ('"',), ("plain",)], "k string")
    got = [r.e for r in df.select(H.encode_key("k").alias("e")).collect()]
    assert got == ["abc", "12", "name", "42", "", "", "plain"]


# --------------------------------------------------------------------- A3, A9, session
def test_match_type_check_and_report_set_write(spark, tmp_path):
    from skirmish.sources import sinks as S
    from skirmish.sources import tables as A

    with pytest.raises(ValueError):
        A.check_match_type("4x")
    assert A.check_match_type("5m") == "5m"
    m = matches_df(spark, [(i, 1 + i % 2, 3, 0, 1, [1], [2], ["x", "y"], 1, 0) for i in range(6)])
    docs = S.tagged_report_set(m, grades=[1, 2])
    S.save_report_set(docs, str(tmp_path / "docs"))
    back = spark.read.parquet(str(tmp_path / "docs"))
    assert sorted(r.tag for r in back.select("tag").collect()) == ["grade_count", "kungfus_1", "kungfus_2"]
    assert {"inserted_at", "updated_at", "content"} <= set(back.columns)


def test_scale_conf_sizes_partitions():
    from skirmish.session import scale_conf

    c = scale_conf(100 * 1024 ** 4, 16000)
    assert int(c["spark.sql.shuffle.partitions"]) == 409600
    assert int(scale_conf(1024, 8)["spark.sql.shuffle.partitions"]) == 24
    assert c["spark.sql.adaptive.enabled"] == "true"


def test_a_match_is_its_type_and_id(spark):
    m = spark.createDataFrame([(1, "2c", 5)], "match_id long, match_type string, grade int")
    new = spark.createDataFrame([(1, "3c", 6), (1, "2c", 7)], m.schema)
    assert sorted(map(tuple, M.insert_if_absent(m, new, M.match_keys(m, new)).collect())) == [(1, "2c", 5), (1, "3c", 6)]
    assert M.match_keys(m.drop("match_type"), m.drop("match_type")) == ["match_id"]
    with pytest.raises(ValueError):
        M.match_keys(m, m.drop("match_type"))


def test_performance_rules(spark):
    s = spark.createDataFrame([("a", "3c", 1, 50, 3)], "role_id string, match_type string, score int, fetched_count int, ranking int")
    p = spark.createDataFrame([("a", "3c", 2, 3, "12%"), ("b", "3c", 4, None, "-")], "role_id string, match_type string, score int, fetched_count int, ranking string")
    out, log = M.save_performance(s, p)
    assert sorted(map(tuple, out.collect())) == [("a", "3c", 2, 50, -12), ("b", "3c", 4, None, None)]
    assert {r["ranking"] for r in log.collect()} == {-12, None}


def test_dictionary_order(spark):
    d = spark.createDataFrame([("t", "1", "old")], "tag string, id string, content string")
    e = spark.createDataFrame([("t", i, f"v{k}", k) for i in ("1", "2") for k in range(5)], "tag string, id string, content string, seq int")
    last = {r["id"]: r["content"] for r in M.dictionary_push(d, e, "force", order="seq").collect()}
    first = {r["id"]: r["content"] for r in M.dictionary_push(d, e, "insert_only", order="seq").collect()}
    assert last == {"1": "v4", "2": "v4"} and first == {"1": "old", "2": "v0"}
