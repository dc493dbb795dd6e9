"""Queries for A1–A9 (sources, sinks), A5/K1/D18/C3 (replays)."""

from __future__ import annotations

from pyspark.sql import functions as F

from skirmish.functions.scalars import flat
from skirmish.operators import reports as R
from skirmish.operators import replay as P
from skirmish.operators.joins import top_roles
from skirmish.plans.catalog import query
from skirmish.session import scratch_path
from skirmish.sources import sinks as S
from skirmish.sources import tables as A
from skirmish.sources.fixtures import Domain

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "conversations"]


@query("load_table", "SELECT * FROM customer")
def q_load_table(spark, sf):
    return A.read_table(spark, f"{sf}/customer.parquet")


@query("load_tables", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows FROM {t}" for t in DRIVER_TABLES))
def q_load_tables(spark, sf):
    tabs = A.load_tables(spark, sf, DRIVER_TABLES)
    out = None
    for name, df in tabs.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


@query("read_match_type", """
SELECT match_id, start_time, grade, winner FROM matches WHERE match_type = '2c'""")
def q_read_match_type(spark, sf):
    d = Domain(spark, sf)
    path = scratch_path(spark, "matches")
    A.write_partitioned(d.matches, path)
    stored = spark.read.parquet(path)
    return A.read_match_type(stored, "2c").select("match_id", "start_time", "grade", "winner")


REPLAY_SQL = "SELECT conv_id AS match_id, max(turn) AS match_duration, count(*) AS n_replay, 0 AS n_players " \
             "FROM conversations GROUP BY conv_id"


@query("parse_replay", REPLAY_SQL)
def q_parse_replay(spark, sf):
    r = P.parse_replay(Domain(spark, sf).match_logs)
    return r.select("match_id", "match_duration", F.size("replay").cast("long").alias("n_replay"),
                    F.size("players").alias("n_players"))


@query("first_skill_count", """
SELECT value, count(*) AS count FROM (
  SELECT conv_id, list(role ORDER BY turn, role)[1] AS value FROM conversations GROUP BY conv_id) GROUP BY value""")
def q_first_skill_count(spark, sf):
    return R.first_skill_count(P.parse_replay(Domain(spark, sf).match_logs))


@query("first_skill", """
SELECT conv_id AS match_id, list(role ORDER BY turn, role)[1] AS first_skill FROM conversations GROUP BY conv_id""")
def q_first_skill(spark, sf):
    r = P.parse_replay(Domain(spark, sf).match_logs)
    return r.select("match_id", P.first_skill("replay").alias("first_skill"))


@query("replay_with_match", """
SELECT c.match_id, array_to_string(m.role_ids[1:len(m.team1_kungfu)], ',') AS team1_ids,
       array_to_string(m.role_ids[len(m.team1_kungfu) + 1:len(m.team1_kungfu) + len(m.team2_kungfu)], ',') AS team2_ids,
       c.match_duration
FROM (SELECT conv_id AS match_id, max(turn) AS match_duration FROM conversations GROUP BY conv_id) c
JOIN matches m ON m.match_id = c.match_id
WHERE len(m.role_ids) = len(m.team1_kungfu) + len(m.team2_kungfu)""")
def q_replay_with_match(spark, sf):
    d = Domain(spark, sf)
    x = P.replay_with_match(P.parse_replay(d.match_logs), d.matches)
    return x.select("match_id", flat("team1_ids").alias("team1_ids"), flat("team2_ids").alias("team2_ids"),
                    "match_duration")


TOP_JSON_SQL = """'{' || concat_ws(',', '"role_id":' || to_json(role_id), '"score":' || to_json(score),
  '"ranking":' || to_json(ranking), '"win_rate":' || to_json(win_rate), '"name":' || to_json(name),
  '"force":' || to_json(force), '"position":' || to_json(position)) || '}'"""


def _top_sql():
    from skirmish.plans.q_joins import TOP_SQL

    return TOP_SQL.format(n=200)


@query("take_rows", f"SELECT {TOP_JSON_SQL} AS value FROM ({_top_sql()})")
def q_take_rows(spark, sf):
    d = Domain(spark, sf)
    return S.take_rows(top_roles(d.roles, d.scores, limit=S.DEFAULT_TAKE), order=["position"])


@query("union_rows", """
SELECT role_id, score, NULL AS name FROM scores UNION ALL SELECT global_id AS role_id, NULL AS score, name FROM roles""")
def q_union_rows(spark, sf):
    d = Domain(spark, sf)
    return S.union_rows(d.scores.select("role_id", "score"),
                        d.roles.select(F.col("global_id").alias("role_id"), "name")).select("role_id", "score", "name")


@query("to_document", """
SELECT 'grade_count' AS tag, string_agg(j, chr(10) ORDER BY j) AS content FROM (
  SELECT '{' || concat_ws(',', '"grade":' || to_json(grade), '"count":' || to_json(count(*))) || '}' AS j
  FROM matches GROUP BY grade)""")
def q_to_document(spark, sf):
    doc = S.to_document(R.grade_count(Domain(spark, sf).matches), "grade_count")
    return doc.select("tag", F.array_join("content", "\n").alias("content"))


@query("save_document", """
SELECT 'grade_count' AS tag, count(*) AS n FROM (SELECT grade FROM matches GROUP BY grade)""")
def q_save_document(spark, sf):
    d = Domain(spark, sf)
    path = scratch_path(spark, "documents")
    S.save_document(S.to_document(R.grade_count(d.matches)), "grade_count", path)
    back = spark.read.parquet(path)
    return back.select("tag", F.size("content").cast("long").alias("n"))


@query("tagged_report_set", """
SELECT 'grade_count' AS tag, count(*) AS n, CAST(sum(c) AS BIGINT) AS games
FROM (SELECT grade, count(*) AS c FROM matches GROUP BY grade)
UNION ALL
SELECT 'kungfus_' || CAST(grade AS VARCHAR) AS tag, count(*) AS n, CAST(sum(c) AS BIGINT) AS games
FROM (SELECT grade, kungfus, count(*) AS c FROM teams WHERE grade BETWEEN 1 AND 13 GROUP BY grade, kungfus)
GROUP BY grade""")
def q_tagged_report_set(spark, sf):
    docs = S.tagged_report_set(Domain(spark, sf).matches)
    games = F.aggregate(F.transform("content", lambda x: F.get_json_object(x, "$.count").cast("long")),
                        F.lit(0).cast("long"), lambda a, b: a + b)
    return docs.select("tag", F.size("content").cast("long").alias("n"), games.alias("games"))


@query("replace_report_set", """
SELECT r.run, t.tag, t.n FROM (SELECT 'a' AS run UNION ALL SELECT 'b') r CROSS JOIN (
  SELECT 'grade_count' AS tag, count(*) AS n FROM (SELECT grade FROM matches GROUP BY grade)
  UNION ALL SELECT 'kungfus_' || CAST(grade AS VARCHAR), count(*)
  FROM (SELECT grade, kungfus FROM teams WHERE grade BETWEEN 1 AND 13 GROUP BY grade, kungfus) GROUP BY grade) t""")
def q_replace_report_set(spark, sf):
    """Two runs, the first written twice: each document is there once."""
    path = scratch_path(spark, "report-sets")
    docs = S.tagged_report_set(Domain(spark, sf).matches)
    for run in ("a", "b", "a"):
        S.replace_report_set(docs, path, run)
    return spark.read.parquet(path).select("run", "tag", F.size("content").cast("long").alias("n"))


RECENT_LOG_ID = 10


@query("replay_analysis", f"""
SELECT value, count(*) AS count FROM (
  SELECT conv_id, list(role ORDER BY turn, role)[1] AS value FROM conversations WHERE conv_id > {RECENT_LOG_ID}
  GROUP BY conv_id) GROUP BY value""")
def q_replay_analysis(spark, sf):
    """§3.4 end to end: recent match logs (B2) → parse (A5) → first skill
    (K1) → counts (D18)."""
    from skirmish.operators.filters import recent_matches

    logs = recent_matches(Domain(spark, sf).match_logs, RECENT_LOG_ID)
    return R.first_skill_count(P.parse_replay(logs))
