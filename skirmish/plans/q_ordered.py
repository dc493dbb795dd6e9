"""Queries for E1–E11, F1–F10 and the date-range functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skirmish.functions.ranges import day_range, in_range, make_range
from skirmish.operators import joins as C
from skirmish.operators import ordered as E
from skirmish.plans.catalog import query
from skirmish.plans.q_joins import RECENT_SQL, TOP_SQL
from skirmish.sources.fixtures import Domain

SEARCH = 3000
HALF_MONTH = "2024-01-15"


def recent(d: Domain):
    return C.role_recent_kungfus(d.roles, d.match_roles, d.matches, 100)


@query("last_n_per_role", """
SELECT role_id, match_id FROM (
  SELECT mr.role_id, mr.match_id,
         row_number() OVER (PARTITION BY mr.role_id ORDER BY m.start_time DESC, mr.match_id DESC) AS rn
  FROM match_roles mr JOIN matches m ON m.match_id = mr.match_id) WHERE rn <= 50""")
def q_last_n_per_role(spark, sf):
    d = Domain(spark, sf)
    h = d.match_roles.join(d.matches.select("match_id", "start_time"), "match_id")
    return E.last_n_per_key(h, "role_id", [F.col("start_time").desc(), F.col("match_id").desc()], 50).select(
        "role_id", "match_id")


USAGE_SQL = f"""
SELECT role_id, string_agg(CAST(count AS VARCHAR) || ':' || coalesce(name, ''), ';' ORDER BY count, name NULLS FIRST, kungfu)
         AS usage,
       max(kungfu) FILTER (WHERE rn = 1) AS head_kungfu, max(name) FILTER (WHERE rn = 1) AS head_name
FROM (SELECT u.*, row_number() OVER (PARTITION BY role_id ORDER BY {{head}}) AS rn
      FROM (SELECT c.role_id, c.kungfu, c.count, n.name
            FROM (SELECT role_id, kungfu, count(*) AS count FROM ({RECENT_SQL}) WHERE kungfu IS NOT NULL
                  GROUP BY role_id, kungfu) c
            LEFT JOIN (SELECT id, min(content) AS name FROM kungfu_items WHERE id IS NOT NULL GROUP BY id) n
              ON n.id = c.kungfu) u)
GROUP BY role_id"""
USAGE_MOST = USAGE_SQL.format(head="count DESC, name NULLS FIRST, kungfu")
USAGE_LEAST = USAGE_SQL.format(head="count, name NULLS FIRST, kungfu")


def flat_usage(df):
    return df.select("role_id", F.array_join(F.transform(
        "usage", lambda u: F.concat(u["count"].cast("string"), F.lit(":"), F.coalesce(u["name"], F.lit("")))), ";")
        .alias("usage"), "head_kungfu", "head_name")


def usage(d: Domain, pick: str):
    from skirmish.plans.q_reports import kitems

    return E.kungfu_usage_per_role(recent(d), kitems(d), pick=pick)


@query("kungfu_usage_per_role", USAGE_MOST)
def q_usage(spark, sf):
    return flat_usage(usage(Domain(spark, sf), "most"))


@query("kungfu_usage_least", USAGE_LEAST)
def q_usage_least(spark, sf):
    return flat_usage(usage(Domain(spark, sf), "least"))


SEARCH_KUNGFU = "tianluo"


@query("search_kungfu", f"""
SELECT t.*, u.head_kungfu, u.head_name FROM ({TOP_SQL.format(n=SEARCH)}) t JOIN ({USAGE_MOST}) u ON u.role_id = t.role_id
WHERE u.head_name = '{SEARCH_KUNGFU}' ORDER BY t.position LIMIT 100""")
def q_search_kungfu(spark, sf):
    d = Domain(spark, sf)
    top = C.top_roles(d.roles, d.scores, limit=SEARCH)
    return E.search_kungfu(top, usage(d, "most"), SEARCH_KUNGFU, limit=100)


@query("infer_teams", """
WITH p AS (SELECT match_id, list(role_id ORDER BY inserted_at, role_id) AS ids,
                  list(kungfu ORDER BY inserted_at, role_id) AS ks, list(score2 ORDER BY inserted_at, role_id) AS ss
           FROM match_roles GROUP BY match_id)
SELECT m.match_id, array_to_string(p.ids, ',') AS role_ids,
  CASE WHEN len(p.ids) <> len(m.team1_kungfu) + len(m.team2_kungfu) THEN 'size_mismatch'
       WHEN list_sort(p.ks[1:len(m.team1_kungfu)]) <> m.team1_kungfu
         OR list_sort(p.ks[len(m.team1_kungfu) + 1:len(m.team1_kungfu) + len(m.team2_kungfu)]) <> m.team2_kungfu
         THEN 'kungfu_mismatch'
       WHEN list_sum(p.ss[1:len(m.team1_kungfu)]) <> m.team1_score
         OR list_sum(p.ss[len(m.team1_kungfu) + 1:len(m.team1_kungfu) + len(m.team2_kungfu)]) <> m.team2_score
         THEN 'score_mismatch'
       ELSE 'fixed' END AS status
FROM matches m JOIN p ON p.match_id = m.match_id""")
def q_infer_teams(spark, sf):
    d = Domain(spark, sf)
    x = E.infer_teams(d.match_roles, d.matches)
    return x.select("match_id", F.array_join("role_ids", ",").alias("role_ids"), "status")


ISLANDS_SQL = """
SELECT user_id, min(day) AS lower, max(day) + 1 AS upper FROM (
  SELECT user_id, day, sum(CASE WHEN prev IS NULL OR day > prev + 1 THEN 1 ELSE 0 END)
           OVER (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS island
  FROM (SELECT user_id, day, lag(day) OVER (PARTITION BY user_id ORDER BY day) AS prev FROM seen_days))
GROUP BY user_id, island"""


def day_ranges(d: Domain, where=None):
    s = d.seen_days if where is None else d.seen_days.where(where)
    return s.select("user_id", day_range("day").alias("seen"))


def flat_ranges(df):
    return df.select("user_id", F.col("seen.lower").alias("lower"), F.col("seen.upper").alias("upper"))


@query("merge_seen_ranges", ISLANDS_SQL)
def q_merge_seen_ranges(spark, sf):
    return flat_ranges(E.merge_seen_ranges(day_ranges(Domain(spark, sf)), ["user_id"]))


@query("add_seen_days", ISLANDS_SQL)
def q_add_seen_days(spark, sf):
    d = Domain(spark, sf)
    before = E.merge_seen_ranges(day_ranges(d, F.col("day") < F.lit(HALF_MONTH).cast("date")), ["user_id"])
    later = d.seen_days.where(F.col("day") >= F.lit(HALF_MONTH).cast("date"))
    return flat_ranges(E.add_seen_days(before, later, ["user_id"]))


@query("in_range", f"""
SELECT s.user_id, s.day, s.day >= DATE '{HALF_MONTH}' AND s.day < DATE '{HALF_MONTH}' + 7 AS inside FROM seen_days s""")
def q_in_range(spark, sf):
    s = Domain(spark, sf).seen_days
    lo = F.lit(HALF_MONTH).cast("date")
    rng = make_range(lo, F.date_add(lo, 6), upper_inclusive=True)
    return s.select("user_id", "day", in_range(rng, "day").alias("inside"))


@query("role_logs_by_seen", f"""
SELECT CAST(user_id AS VARCHAR) AS global_id,
       string_agg(CAST(lower AS VARCHAR) || '/' || CAST(upper AS VARCHAR), ';' ORDER BY lower) AS seen
FROM ({ISLANDS_SQL}) GROUP BY user_id""")
def q_role_logs_by_seen(spark, sf):
    merged = E.merge_seen_ranges(day_ranges(Domain(spark, sf)), ["user_id"])
    logs = E.seen_sets(merged, ["user_id"]).withColumn("global_id", F.col("user_id").cast("string"))
    x = E.order_by_seen(logs)
    return x.select("global_id", F.array_join(F.transform(
        "seen", lambda r: F.concat(r["lower"].cast("string"), F.lit("/"), r["upper"].cast("string"))), ";").alias("seen"))


PASSPORT_SQL = """
SELECT global_id, passport_id, inserted_at FROM (
  SELECT global_id, passport_id, inserted_at,
         row_number() OVER w AS rn, lag(passport_id) OVER w AS prev
  FROM role_updates WINDOW w AS (PARTITION BY global_id ORDER BY inserted_at, event_id))
WHERE passport_id IS NOT NULL AND global_id IS NOT NULL AND (rn = 1 OR {cmp})"""


@query("passport_changes", PASSPORT_SQL.format(cmp="passport_id <> prev"))
def q_passport_changes(spark, sf):
    return E.passport_changes(Domain(spark, sf).role_updates)


@query("passport_changes_null_safe", PASSPORT_SQL.format(cmp="passport_id IS DISTINCT FROM prev"))
def q_passport_changes_null_safe(spark, sf):
    return E.passport_changes(Domain(spark, sf).role_updates, null_safe=True)


@query("latest_score2", """
SELECT role_id, score2 FROM (
  SELECT mr.role_id, mr.score2, row_number() OVER (PARTITION BY mr.role_id ORDER BY m.start_time DESC, m.match_id DESC) AS rn
  FROM match_roles mr JOIN matches m ON m.match_id = mr.match_id) WHERE rn = 1""")
def q_latest_score2(spark, sf):
    d = Domain(spark, sf)
    h = d.match_roles.join(d.matches.select("match_id", "start_time"), "match_id")
    return E.latest_score2(h)


DICT_SQL = """
WITH known AS (
  SELECT 'kungfu' AS tag, p_type AS value, row_number() OVER (ORDER BY min(p_partkey), p_type) - 1 AS id
  FROM part WHERE p_partkey < 3 GROUP BY p_type),
firsts AS (SELECT 'kungfu' AS tag, p_type AS value, min(p_partkey) AS first FROM part GROUP BY p_type),
new AS (SELECT f.tag, f.value,
               (SELECT coalesce(max(id), -1) FROM known) + row_number() OVER (ORDER BY f.first, f.value) AS id
        FROM firsts f WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.tag = f.tag AND k.value = f.value))
SELECT tag, value, CAST(id AS BIGINT) AS id, false AS is_new FROM known
UNION ALL SELECT tag, value, CAST(id AS BIGINT) AS id, true AS is_new FROM new"""


@query("dictionary_versions", DICT_SQL)
def q_dictionary_versions(spark, sf):
    part = Domain(spark, sf).raw("part")
    vals = part.select(F.lit("kungfu").alias("tag"), F.col("p_type").alias("value"), "p_partkey")
    first_known = vals.where(F.col("p_partkey") < 3).groupBy("tag", "value").agg(F.min("p_partkey").alias("_f"))
    known = first_known.select("tag", "value", (F.row_number().over(
        Window.partitionBy("tag").orderBy("_f", "value")) - 1).alias("id"))
    return E.dictionary_versions(known, vals, "p_partkey")


@query("score_history", """
SELECT role_id, match_type, score, ranking, total_count, win_count, mvp_count FROM scores WHERE score IS NOT NULL""")
def q_score_history(spark, sf):
    return E.score_history(Domain(spark, sf).scores)


@query("roles_page", """
SELECT * FROM roles ORDER BY global_id LIMIT 200""")
def q_roles_page(spark, sf):
    return E.roles_page(Domain(spark, sf).roles, limit=200)


@query("make_range", """
SELECT user_id, day,
       CASE WHEN day < DATE '2024-01-10' THEN day + 1 ELSE day END AS lower,
       CASE WHEN day < DATE '2024-01-10' THEN day + 3 ELSE day + 2 END AS upper,
       (day < DATE '2024-01-10' AND day + 1 >= day + 3) AS empty
FROM seen_days""")
def q_make_range(spark, sf):
    s = Domain(spark, sf).seen_days
    early = F.col("day") < F.lit("2024-01-10").cast("date")
    # early days: (day, day+2] exclusive lower, inclusive upper; later days: [day, day+1] inclusive
    rng = F.when(early, make_range(F.col("day"), F.date_add("day", 2), False, True)).otherwise(
        make_range(F.col("day"), F.date_add("day", 1), True, True))
    x = s.select("user_id", "day", rng.alias("r"))
    return x.select("user_id", "day", F.col("r.lower").alias("lower"), F.col("r.upper").alias("upper"),
                    F.col("r").isNull().alias("empty"))


@query("range_order", f"""
SELECT user_id, lower, upper, CAST(row_number() OVER (PARTITION BY user_id ORDER BY lower NULLS FIRST, upper NULLS LAST) AS INTEGER) AS pos
FROM ({ISLANDS_SQL})""")
def q_range_order(spark, sf):
    from skirmish.functions.ranges import range_sort_key

    merged = E.merge_seen_ranges(day_ranges(Domain(spark, sf)), ["user_id"])
    w = Window.partitionBy("user_id").orderBy(range_sort_key("seen"))
    return merged.select("user_id", F.col("seen.lower").alias("lower"), F.col("seen.upper").alias("upper"),
                         F.row_number().over(w).alias("pos"))
