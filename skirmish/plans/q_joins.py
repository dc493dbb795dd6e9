"""Queries for C1–C20 (joins)."""

from __future__ import annotations

from pyspark.sql import functions as F

from skirmish.operators import joins as C
from skirmish.operators.keyset import Key, cursor_of, page_after
from skirmish.plans.catalog import query
from skirmish.plans.q_reports import MATCH_COLS_SQL, flat_matches
from skirmish.sources.fixtures import Domain

ROLE = "5"
SCORE_COLS = "role_id, match_type, score, total_count, win_count, mvp_count, fetched_to, fetched_count, ranking, fetched_at"


@query("scores_with_kungfus", f"""
SELECT s.*, rk.kungfu, rk.total_count AS kungfu_count, rk.win_count AS kungfu_win_count
FROM scores s JOIN role_kungfus rk ON rk.role_id = s.role_id AND rk.match_type = s.match_type""")
def q_scores_with_kungfus(spark, sf):
    d = Domain(spark, sf)
    return C.scores_with_kungfus(d.scores, d.role_kungfus)


@query("roles_with_scores", """
SELECT r.global_id, r.name, s.match_type, s.score
FROM roles r LEFT JOIN scores s ON s.role_id = r.global_id
WHERE s.match_type = '3c' OR s.match_type IS NULL
ORDER BY s.score DESC NULLS LAST, r.global_id LIMIT 100 OFFSET 10""")
def q_roles_with_scores(spark, sf):
    d = Domain(spark, sf)
    return C.roles_with_scores(d.roles, d.scores, "3c", offset=10, limit=100).select("global_id", "name", "match_type", "score")


@query("roles_with_scores_by_cursor", """
SELECT r.global_id, r.name, s.match_type, s.score
FROM roles r LEFT JOIN scores s ON s.role_id = r.global_id
WHERE s.match_type = '3c' OR s.match_type IS NULL
ORDER BY s.score DESC NULLS LAST, r.global_id LIMIT 40 OFFSET 80""")
def q_roles_with_scores_by_cursor(spark, sf):
    """The third page of 40, behind the cursors of the first two."""
    d = Domain(spark, sf)
    x = C.roles_with_scores(d.roles, d.scores, "3c").select("global_id", "name", "match_type", "score")
    keys, cursor = [Key("score", desc=True), Key("global_id")], None
    for _ in range(2):
        cursor = cursor_of(page_after(x, keys, 40, cursor), keys)
    return page_after(x, keys, 40, cursor)


TOP_SQL = """
SELECT round(s.win_count / s.total_count, 3) AS win_rate, s.score, s.role_id, s.ranking, r.name, r.force,
       CAST(row_number() OVER (ORDER BY s.score DESC, s.role_id) AS INTEGER) AS position
FROM scores s JOIN roles r ON r.global_id = s.role_id
WHERE s.match_type = '3c' AND s.score IS NOT NULL
ORDER BY s.score DESC, s.role_id LIMIT {n}"""


@query("top_roles", f"SELECT * FROM ({TOP_SQL.format(n=200)})")
def q_top_roles(spark, sf):
    d = Domain(spark, sf)
    return C.top_roles(d.roles, d.scores, limit=200)


@query("top_roles_null_first", """
SELECT * FROM (
SELECT round(s.win_count / s.total_count, 3) AS win_rate, s.score, s.role_id, s.ranking, r.name, r.force,
       CAST(row_number() OVER (ORDER BY s.score DESC NULLS FIRST, s.role_id) AS INTEGER) AS position
FROM scores s JOIN roles r ON r.global_id = s.role_id
WHERE s.match_type = '3c'
ORDER BY s.score DESC NULLS FIRST, s.role_id LIMIT 200)""")
def q_top_roles_null_first(spark, sf):
    d = Domain(spark, sf)
    return C.top_roles(d.roles, d.scores, limit=200, keep_null_scores=True)


@query("unknown_roles", """
SELECT r.global_id, r.name FROM roles r WHERE NOT EXISTS (SELECT 1 FROM scores s WHERE s.role_id = r.global_id)""")
def q_unknown_roles(spark, sf):
    d = Domain(spark, sf)
    return C.unknown_roles(d.roles, d.scores).select("global_id", "name")


@query("roles_needing_scores", """
SELECT r.global_id, r.name FROM roles r
WHERE NOT EXISTS (SELECT 1 FROM scores s WHERE s.role_id = r.global_id)
  AND EXISTS (SELECT 1 FROM match_roles m WHERE m.role_id = r.global_id AND m.match_type = '3c')
ORDER BY r.global_id LIMIT 100""")
def q_roles_needing_scores(spark, sf):
    d = Domain(spark, sf)
    return C.roles_needing_scores(d.roles, d.scores, d.match_roles, limit=100).select("global_id", "name")


@query("matches_of_role", f"""
SELECT {MATCH_COLS_SQL}, mr_role_id, kungfu, score2, team FROM (
  SELECT m.*, mr.role_id AS mr_role_id, mr.kungfu, mr.score2, mr.team
  FROM matches m JOIN match_roles mr ON mr.match_id = m.match_id WHERE mr.role_id = '{ROLE}'
  ORDER BY m.match_id DESC LIMIT 20)""")
def q_matches_of_role(spark, sf):
    d = Domain(spark, sf)
    x = C.matches_of_role(d.matches, d.match_roles, ROLE, limit=20).withColumnRenamed("role_id", "mr_role_id")
    return flat_matches(x, extra=["mr_role_id", "kungfu", "score2", "team"])


@query("match_history", f"""
SELECT mr.match_id, mr.role_id, mr.kungfu, mr.score2, m.start_time, m.grade, m.winner
FROM match_roles mr LEFT JOIN matches m ON m.match_id = mr.match_id WHERE mr.role_id = '{ROLE}'""")
def q_match_history(spark, sf):
    d = Domain(spark, sf)
    return C.match_history(d.match_roles, d.matches, ROLE).select(
        "match_id", "role_id", "kungfu", "score2", "start_time", "grade", "winner")


RECENT_SQL = """
SELECT role_id, match_id, kungfu, start_time FROM (
  SELECT r.global_id AS role_id, mr.match_id, mr.kungfu, m.start_time,
         row_number() OVER (PARTITION BY r.global_id ORDER BY m.start_time DESC NULLS FIRST, mr.match_id DESC) AS rn
  FROM roles r JOIN match_roles mr ON mr.role_id = r.global_id LEFT JOIN matches m ON m.match_id = mr.match_id
  WHERE mr.match_type = '3c')
WHERE rn <= 100"""


@query("role_recent_kungfus", RECENT_SQL)
def q_role_recent_kungfus(spark, sf):
    d = Domain(spark, sf)
    return C.role_recent_kungfus(d.roles, d.match_roles, d.matches, 100).select("role_id", "match_id", "kungfu", "start_time")


@query("roles_of_ungraded_matches", """
SELECT mr.role_id, count(*) AS count FROM matches m LEFT JOIN match_roles mr ON mr.match_id = m.match_id
WHERE m.grade IS NULL OR m.grade = 0 GROUP BY mr.role_id""")
def q_roles_of_ungraded(spark, sf):
    d = Domain(spark, sf)
    return C.roles_of_ungraded_matches(d.matches, d.match_roles)


def _combine_sides(d: Domain):
    rk = d.role_kungfus
    # l1: classes a role has won with; l2: classes played at least 3 times (overlapping key sets)
    l1 = rk.where(F.col("win_count") > 0).select("role_id", "kungfu", "total_count", "win_count")
    l2 = rk.where(F.col("total_count") >= 3).select(
        "role_id", "kungfu", (F.col("total_count") * 10).alias("total_count"),
        F.when(F.col("win_count") > 2, F.col("win_count") + 1).alias("win_count"), F.lit("l2").alias("note"))
    return l1, l2


@query("combine_with", """
SELECT coalesce(l1.role_id, l2.role_id) AS role_id, coalesce(l1.kungfu, l2.kungfu) AS kungfu,
       coalesce(l1.total_count, l2.total_count) AS total_count, coalesce(l1.win_count, l2.win_count) AS win_count,
       l2.note
FROM (SELECT role_id, kungfu, total_count, win_count FROM role_kungfus WHERE win_count > 0) l1
FULL OUTER JOIN (SELECT role_id, kungfu, total_count * 10 AS total_count,
                        CASE WHEN win_count > 2 THEN win_count + 1 END AS win_count, 'l2' AS note
                 FROM role_kungfus WHERE total_count >= 3) l2
ON l1.role_id = l2.role_id AND l1.kungfu = l2.kungfu""")
def q_combine_with(spark, sf):
    l1, l2 = _combine_sides(Domain(spark, sf))
    return C.combine_with(l1, l2, ["role_id", "kungfu"])


@query("kungfu_stats_merge", """
SELECT coalesce(m.role_id, k.role_id) AS role_id, coalesce(m.kungfu, k.kungfu) AS kungfu,
       m.total_count, m.win_count, k.skill_count, '3c' AS match_type
FROM (SELECT role_id, kungfu, CASE WHEN win_count = 0 THEN 0 ELSE total_count END AS total_count, win_count
      FROM role_kungfus) m
FULL OUTER JOIN (SELECT role_id, kungfu, total_count AS skill_count FROM role_kungfus WHERE total_count >= 3) k
ON m.role_id = k.role_id AND m.kungfu = k.kungfu
WHERE k.role_id IS NOT NULL OR m.total_count IS NULL OR m.total_count <> 0""")
def q_kungfu_stats_merge(spark, sf):
    rk = Domain(spark, sf).role_kungfus
    metrics = rk.select("role_id", "kungfu", F.when(F.col("win_count") == 0, F.lit(0).cast("long"))
                        .otherwise(F.col("total_count")).alias("total_count"), "win_count")
    skills = rk.where(F.col("total_count") >= 3).select("role_id", "kungfu", F.col("total_count").alias("skill_count"))
    return C.kungfu_stats_merge(metrics, skills, match_type="3c", keys=["role_id", "kungfu"])


PLAYERS_SQL = "string_agg(mr.role_id || ':' || CAST(mr.kungfu AS VARCHAR), ';' ORDER BY mr.role_id)"


@query("nest", f"""
SELECT m.match_id, {PLAYERS_SQL} AS players
FROM matches m LEFT JOIN match_roles mr ON mr.match_id = m.match_id GROUP BY m.match_id""")
def q_nest(spark, sf):
    d = Domain(spark, sf)
    x = C.nest(d.matches.select("match_id"), d.match_roles, "match_id", "players")
    return x.select("match_id", F.array_join(F.transform(
        "players", lambda p: F.concat(p["role_id"], F.lit(":"), p["kungfu"].cast("string"))), ";").alias("players"))


@query("score_match_roles", f"""
SELECT * FROM match_roles WHERE role_id = '{ROLE}' AND match_type = '3c' ORDER BY match_id DESC LIMIT 20""")
def q_score_match_roles(spark, sf):
    return C.score_match_roles(Domain(spark, sf).match_roles, ROLE, "3c")


def _history(d: Domain):
    return d.match_roles.select("match_id", "match_type", "role_id", (F.col("match_id") % 13 + 1).cast("int").alias("avg_grade"))


@query("grade_backfill", f"""
SELECT {MATCH_COLS_SQL.replace("grade,", "coalesce(nullif(grade, 0), h.avg_grade) AS grade,", 1)}
FROM matches LEFT JOIN (SELECT match_id AS h_id, CAST(max(match_id % 13 + 1) AS INTEGER) AS avg_grade
                        FROM match_roles GROUP BY match_id) h ON h.h_id = match_id""")
def q_grade_backfill(spark, sf):
    d = Domain(spark, sf)
    return flat_matches(C.grade_backfill(d.matches, _history(d)))


@query("recode_match_type", f"""
SELECT s.role_id, replace(replace(replace(s.match_type, 'c', ''), 'd', ''), 'm', '') ||
       CASE WHEN r.zone LIKE '%电信%' THEN 'c' WHEN r.zone LIKE '%双线%' THEN 'd' ELSE 'm' END AS match_type,
       s.score
FROM scores s LEFT JOIN roles r ON r.global_id = s.role_id""")
def q_recode_match_type(spark, sf):
    d = Domain(spark, sf)
    return C.recode_match_type(d.scores, d.roles).select("role_id", "match_type", "score")


@query("participant_of", f"""
SELECT m.match_id, mr.role_id, mr.seat, mr.team, mr.kungfu, mr.score2, mr.inserted_at, mr.match_type
FROM matches m JOIN match_roles mr ON mr.match_id = m.match_id WHERE mr.role_id = '{ROLE}'""")
def q_participant_of(spark, sf):
    d = Domain(spark, sf)
    detail = C.nest(d.matches.select("match_id"), d.match_roles, "match_id", "players")
    return C.participant_of(detail, ROLE)
