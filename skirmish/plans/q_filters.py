"""Queries for B1–B17 (filters, lookups, predicates, paging)."""

from __future__ import annotations

from pyspark.sql import functions as F

from skirmish.functions.scalars import is_recent
from skirmish.operators import filters as B
from skirmish.operators.trigram import TrigramIndex
from skirmish.plans.catalog import query
from skirmish.plans.q_reports import MATCH_COLS_SQL, flat_matches
from skirmish.session import scratch_path
from skirmish.sources.fixtures import Domain

MIN_MATCH_ID = 1000
AS_OF_EVENTS = "2024-01-25 00:00:00"
AS_OF_SCORES = "2001-08-01 00:00:00"
ROLE = "8"
MATCH = 100
NAME_PART = "00001"
NAME_PATTERN = "000_1%2"


@query("recent_matches", f"SELECT {MATCH_COLS_SQL} FROM matches WHERE match_id > {MIN_MATCH_ID}")
def q_recent_matches(spark, sf):
    return flat_matches(B.recent_matches(Domain(spark, sf).matches, MIN_MATCH_ID))


@query("recent_days", f"""
SELECT match_id, role_id, inserted_at FROM match_roles
WHERE inserted_at > TIMESTAMP '{AS_OF_EVENTS}' - INTERVAL 7 DAY""")
def q_recent_days(spark, sf):
    return B.recent_days(Domain(spark, sf).match_roles, 7, AS_OF_EVENTS).select("match_id", "role_id", "inserted_at")


@query("items_by_tag", """
SELECT tag, count(*) AS n, string_agg(id, ',' ORDER BY id, content) AS ids FROM items GROUP BY tag""")
def q_items_by_tag(spark, sf):
    x = B.items_by_tag(Domain(spark, sf).items)
    return x.select("tag", F.size("items").cast("long").alias("n"),
                    F.array_join(F.transform("items", lambda i: i["id"]), ",").alias("ids"))


@query("items_of_tag", """
SELECT tag, count(*) AS n, string_agg(id, ',' ORDER BY id, content) AS ids FROM items WHERE tag = 'kungfu' GROUP BY tag""")
def q_items_of_tag(spark, sf):
    x = B.items_by_tag(Domain(spark, sf).items, "kungfu")
    return x.select("tag", F.size("items").cast("long").alias("n"),
                    F.array_join(F.transform("items", lambda i: i["id"]), ",").alias("ids"))


@query("get_role", f"""
SELECT r.*, s.match_type, s.score, s.total_count, s.win_count, s.mvp_count, s.fetched_to, s.fetched_count,
       s.ranking, s.fetched_at
FROM roles r LEFT JOIN scores s ON s.role_id = r.global_id WHERE r.global_id = '{ROLE}'""")
def q_get_role(spark, sf):
    d = Domain(spark, sf)
    return B.get_role(d.roles, d.scores, ROLE)


@query("get_match", f"SELECT {MATCH_COLS_SQL} FROM matches WHERE match_id = {MATCH}")
def q_get_match(spark, sf):
    return flat_matches(B.get_match(Domain(spark, sf).matches, MATCH))


@query("get_matches", f"SELECT {MATCH_COLS_SQL} FROM matches")
def q_get_matches(spark, sf):
    return flat_matches(B.get_matches(Domain(spark, sf).matches))


@query("search_role", f"""
SELECT r.global_id AS role_id, r.force, r.name, r.zone, r.server, p.name AS person_name
FROM roles r LEFT JOIN persons p ON p.person_id = r.person_id WHERE r.name LIKE '%{NAME_PART}%'""")
def q_search_role(spark, sf):
    d = Domain(spark, sf)
    return B.search_role(d.roles, d.persons, NAME_PART)


@query("search_role_indexed", f"""
SELECT r.global_id AS role_id, r.force, r.name, r.zone, r.server, p.name AS person_name
FROM roles r LEFT JOIN persons p ON p.person_id = r.person_id WHERE r.name LIKE '%{NAME_PATTERN}%'""")
def q_search_role_indexed(spark, sf):
    """All roles indexed, then found by a pattern with wildcards inside."""
    d = Domain(spark, sf)
    index = TrigramIndex(scratch_path(spark, "names"), "global_id", "name", d.roles.schema)
    index.write(d.roles)
    return B.search_role_indexed(spark, index, d.persons, NAME_PATTERN)


@query("where_text", """
SELECT x1.global_id, x1.name, x1.body_type FROM roles x1 WHERE x1.role_id < 100 AND x1.body_type = 'little'""")
def q_where_text(spark, sf):
    x = B.where_text(Domain(spark, sf).roles, 'x1.role_id < 100 and x1.body_type == "little"')
    return x.select("global_id", "name", "body_type")


@query("where_text_list", """
SELECT x1.global_id, x1.name, x1.body_type FROM roles x1
WHERE x1.body_type IN ('little', 'from') AND x1.name <> 'select' AND x1.role_id % 2 = 1""")
def q_where_text_list(spark, sf):
    """An IN list and words of SQL inside literals are plain predicates."""
    x = B.where_text(Domain(spark, sf).roles, "x1.body_type in ('little', 'from') and x1.name <> 'select' and x1.role_id % 2 = 1")
    return x.select("global_id", "name", "body_type")


@query("where_list", f"""
SELECT {MATCH_COLS_SQL} FROM matches
WHERE grade >= 10 AND team1_score + team2_score > 10000 AND match_type = '3c'""")
def q_where_list(spark, sf):
    x = B.where_list(Domain(spark, sf).matches,
                     [("grade", ">=", 10), (("team1_score", "+", "team2_score"), ">", 10000), ("match_type", "3c")])
    return flat_matches(x)


@query("paged", f"""
SELECT {MATCH_COLS_SQL} FROM matches x1 WHERE match_type = '3c' AND x1.grade > 5
ORDER BY match_id LIMIT 50 OFFSET 10""")
def q_paged(spark, sf):
    x = B.paged(Domain(spark, sf).matches, [F.col("match_id")], prefix="3c", where="x1.grade > 5",
                limit=50, offset=10)
    return flat_matches(x)


@query("refresh_due", f"""
SELECT role_id, match_type,
  CASE WHEN score IS NOT NULL AND score < 2200 THEN 100
       ELSE coalesce(total_count, 1000) - coalesce(fetched_to, 0) END AS "limit"
FROM scores
WHERE CASE WHEN score IS NOT NULL AND score < 2200
           THEN fetched_at IS NULL OR epoch_us(TIMESTAMP '{AS_OF_SCORES}') - epoch_us(fetched_at) > CAST(6 * 24 * 3600 AS BIGINT) * 1000000
           ELSE fetched_at IS NULL OR epoch_us(TIMESTAMP '{AS_OF_SCORES}') - epoch_us(fetched_at) > CAST(18 * 3600 AS BIGINT) * 1000000 END""")
def q_refresh_due(spark, sf):
    return B.refresh_due(Domain(spark, sf).scores, AS_OF_SCORES)


@query("is_recent", f"""
SELECT role_id, coalesce(epoch_us(TIMESTAMP '{AS_OF_SCORES}') - epoch_us(fetched_at) <= CAST(30 * 24 * 3600 AS BIGINT) * 1000000, false)
  AS recent FROM scores""")
def q_is_recent(spark, sf):
    s = Domain(spark, sf).scores
    return s.select("role_id", is_recent("fetched_at", 30, "day", F.lit(AS_OF_SCORES)).alias("recent"))


@query("missing_grade", f"SELECT {MATCH_COLS_SQL} FROM matches WHERE grade IS NULL OR grade = 0")
def q_missing_grade(spark, sf):
    return flat_matches(B.missing_grade(Domain(spark, sf).matches))


@query("select_keys", "SELECT global_id, name, CAST(NULL AS VARCHAR) AS camp FROM roles")
def q_select_keys(spark, sf):
    return B.select_keys(Domain(spark, sf).roles, ["global_id", "name", "camp"])


@query("fetched_only", "SELECT role_id, match_type, score, fetched_at FROM scores WHERE fetched_at IS NOT NULL")
def q_fetched_only(spark, sf):
    return B.fetched_only(Domain(spark, sf).scores).select("role_id", "match_type", "score", "fetched_at")
