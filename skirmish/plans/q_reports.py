"""Queries for G1/G2 and D1–D20 (team split, line-up reports, summaries)."""

from __future__ import annotations

from pyspark.sql import functions as F

from skirmish.functions.kungfu import kungfu_items, label_sql
from skirmish.functions.scalars import flat
from skirmish.operators import reports as R
from skirmish.plans.catalog import query
from skirmish.sources.dimension import class_dimension
from skirmish.sources.fixtures import Domain

MIN_SCORE = 2200
GRADE = 13
KUNGFU = 10021


def kitems(d: Domain):
    return kungfu_items(d.items, class_dimension(d.spark))


def teams(d: Domain):
    return R.split_team(d.matches)


def flat_teams(df):
    return df.select(
        "match_id", "grade", "match_type", "pvp_type", "start_time",
        flat("kungfus").alias("kungfus"), flat("role_ids").alias("role_ids"), "won",
        flat("anta_role_ids").alias("anta_role_ids"), flat("anta_kungfus").alias("anta_kungfus"), "start_date")


def flat_matches(df, extra=()):
    return df.select(
        "match_id", "match_type", "start_time", "duration", "pvp_type", "map", "grade",
        "team1_score", "team2_score", "winner",
        flat("team1_kungfu").alias("team1_kungfu"), flat("team2_kungfu").alias("team2_kungfu"),
        flat("role_ids").alias("role_ids"), *extra)


MATCH_COLS_SQL = """match_id, match_type, start_time, duration, pvp_type, map, grade, team1_score, team2_score,
  winner, array_to_string(team1_kungfu, ',') AS team1_kungfu, array_to_string(team2_kungfu, ',') AS team2_kungfu,
  array_to_string(role_ids, ',') AS role_ids"""

TEAM_COLS_SQL = """match_id, grade, match_type, pvp_type, start_time, array_to_string(kungfus, ',') AS kungfus,
  array_to_string(role_ids, ',') AS role_ids, won, array_to_string(anta_role_ids, ',') AS anta_role_ids,
  array_to_string(anta_kungfus, ',') AS anta_kungfus, start_date"""


@query("split_team", f"SELECT {TEAM_COLS_SQL} FROM teams")
def q_split_team(spark, sf):
    return flat_teams(teams(Domain(spark, sf)))


@query("show_tags", "SELECT DISTINCT tag FROM items")
def q_show_tags(spark, sf):
    return R.show_tags(Domain(spark, sf).items)


@query("grade_count", "SELECT grade, count(*) AS count FROM matches GROUP BY grade")
def q_grade_count(spark, sf):
    return R.grade_count(Domain(spark, sf).matches)


@query("match_grade", f"SELECT {MATCH_COLS_SQL} FROM matches WHERE grade = {GRADE}")
def q_match_grade(spark, sf):
    return flat_matches(R.match_grade(Domain(spark, sf).matches, GRADE))


@query("match_size_guard", f"SELECT {MATCH_COLS_SQL} FROM matches "
                           "WHERE len(role_ids) = len(team1_kungfu) + len(team2_kungfu)")
def q_size_guard(spark, sf):
    return flat_matches(R.size_guard(Domain(spark, sf).matches))


@query("match_count", """
SELECT array_to_string(kungfus, ',') AS kungfus, count(*) AS count, count(*) FILTER (WHERE won) AS won
FROM teams GROUP BY kungfus""")
def q_match_count(spark, sf):
    return R.match_count(teams(Domain(spark, sf))).select(flat("kungfus").alias("kungfus"), "count", "won")


@query("match_rate", f"""
SELECT array_to_string(c.kungfus, ',') AS kungfus, c.count, c.won, l.short, c.won / c.count AS rate
FROM (SELECT kungfus, count(*) AS count, count(*) FILTER (WHERE won) AS won FROM teams
      GROUP BY kungfus ORDER BY won DESC, kungfus LIMIT 200) c
LEFT JOIN {label_sql("(SELECT kungfus AS k FROM teams) t0")} l ON l.k = c.kungfus""")
def q_match_rate(spark, sf):
    d = Domain(spark, sf)
    r = R.match_rate(R.match_count(teams(d)), kitems(d))
    return r.select(flat("kungfus").alias("kungfus"), "count", "won", "short", "rate")


@query("match_rate_of_grade", f"""
SELECT array_to_string(c.kungfus, ',') AS kungfus, c.count, c.won, l.short, c.won / c.count AS rate
FROM (SELECT kungfus, count(*) AS count, count(*) FILTER (WHERE won) AS won FROM teams WHERE grade = {GRADE}
      GROUP BY kungfus ORDER BY won DESC, kungfus LIMIT 200) c
LEFT JOIN {label_sql("(SELECT kungfus AS k FROM teams) t0")} l ON l.k = c.kungfus""")
def q_match_rate_grade(spark, sf):
    d = Domain(spark, sf)
    r = R.match_rate(R.match_count(R.split_team(R.match_grade(d.matches, GRADE))), kitems(d))
    return r.select(flat("kungfus").alias("kungfus"), "count", "won", "short", "rate")


@query("kungfu_weight", f"""
SELECT w.kungfu AS kungfu_en, round(w.weight, 9) AS weight, w.count, ki.id, ki.kungfu,
       round(w.count / w.weight, 9) AS avg_count
FROM (SELECT rk.kungfu, sum(rk.total_count / s.total_count) AS weight, CAST(sum(rk.total_count) AS BIGINT) AS count
      FROM scores s JOIN role_kungfus rk ON rk.role_id = s.role_id AND rk.match_type = s.match_type
      WHERE s.match_type = '3c' AND s.score > {MIN_SCORE} GROUP BY rk.kungfu) w
LEFT JOIN kungfu_items ki ON ki.content = w.kungfu""")
def q_kungfu_weight(spark, sf):
    d = Domain(spark, sf)
    w = R.kungfu_weight(d.scores, d.role_kungfus, kitems(d), MIN_SCORE)
    return w.select("kungfu_en", F.round("weight", 9).alias("weight"), "count", "id", "kungfu",
                    F.round("avg_count", 9).alias("avg_count"))


@query("day_team_map", """
SELECT start_date, array_to_string(role_ids, ',') AS role_ids, count, in_team FROM day_team_map""")
def q_day_team_map(spark, sf):
    m = R.day_team_map(teams(Domain(spark, sf)))
    return m.select("start_date", flat("role_ids").alias("role_ids"), "count", "in_team")


LABELED_SQL = """
SELECT t.*, m.in_team, a.in_team AS anta_in_team
FROM teams t
JOIN day_team_map m ON m.start_date = t.start_date AND m.role_ids = list_sort(t.role_ids)
LEFT JOIN day_team_map a ON a.start_date = t.start_date AND a.role_ids = list_sort(t.anta_role_ids)"""


def labeled(d: Domain):
    t = teams(d)
    return R.label_teams(t, R.day_team_map(t))


@query("team_labels", f"""
SELECT match_id, array_to_string(role_ids, ',') AS role_ids, array_to_string(anta_role_ids, ',') AS anta_role_ids,
       start_date, won, in_team, anta_in_team FROM ({LABELED_SQL})""")
def q_team_labels(spark, sf):
    x = labeled(Domain(spark, sf))
    return x.select("match_id", flat("role_ids").alias("role_ids"), flat("anta_role_ids").alias("anta_role_ids"),
                    "start_date", "won", "in_team", "anta_in_team")


@query("team_labels_strict", f"""
SELECT t.match_id, array_to_string(t.role_ids, ',') AS role_ids, t.start_date, m.in_team, a.in_team AS anta_in_team
FROM teams t
JOIN day_team_map m ON m.start_date = t.start_date AND m.role_ids = t.role_ids
LEFT JOIN day_team_map a ON a.start_date = t.start_date AND a.role_ids = t.anta_role_ids""")
def q_team_labels_strict(spark, sf):
    t = teams(Domain(spark, sf))
    x = R.label_teams(t, R.day_team_map(t), strict=True)
    return x.select("match_id", flat("role_ids").alias("role_ids"), "start_date", "in_team", "anta_in_team")


REPORT_SQL = f"""
SELECT grade, list_sort(kungfus) AS kungfus,
  count(*) FILTER (WHERE in_team) AS team_count,
  CASE WHEN count(*) FILTER (WHERE in_team) = 0 THEN NULL ELSE count(*) FILTER (WHERE in_team AND won) END AS team_win,
  CASE WHEN count(*) FILTER (WHERE in_team) = 0 THEN NULL
       ELSE count(*) FILTER (WHERE in_team AND anta_in_team) END AS team_vs_team_count,
  CASE WHEN count(*) FILTER (WHERE in_team) = 0 THEN NULL
       ELSE count(*) FILTER (WHERE in_team AND anta_in_team AND won) END AS team_vs_team_win,
  count(*) FILTER (WHERE NOT in_team) AS person_count,
  CASE WHEN count(*) FILTER (WHERE NOT in_team) = 0 THEN NULL
       ELSE count(*) FILTER (WHERE NOT in_team AND won) END AS person_win,
  CASE WHEN count(*) FILTER (WHERE NOT in_team) = 0 THEN NULL
       ELSE count(*) FILTER (WHERE NOT in_team AND anta_in_team) END AS person_vs_team_count,
  CASE WHEN count(*) FILTER (WHERE NOT in_team) = 0 THEN NULL
       ELSE count(*) FILTER (WHERE NOT in_team AND anta_in_team AND won) END AS person_vs_team_win
FROM ({LABELED_SQL}) GROUP BY grade, list_sort(kungfus)"""

REPORT_COLS = ["grade", "team_count", "team_win", "team_vs_team_count", "team_vs_team_win",
               "person_count", "person_win", "person_vs_team_count", "person_vs_team_win"]


def report(d: Domain):
    return R.team_kungfu_report(labeled(d))


@query("team_kungfu_report", f"""
SELECT {", ".join(c for c in REPORT_COLS)}, array_to_string(kungfus, ',') AS kungfus FROM ({REPORT_SQL})""")
def q_team_kungfu_report(spark, sf):
    return report(Domain(spark, sf)).select(*REPORT_COLS, flat("kungfus").alias("kungfus"))


RATES_SQL = f"""
SELECT l.short, r.grade, r.kungfus, r.person_count + r.team_count AS total_count,
  r.team_count / (r.person_count + r.team_count) AS team_weight,
  r.person_win / r.person_count AS person_rate, r.team_win / r.team_count AS team_rate,
  1.0 - r.person_vs_team_count / r.person_count AS cross_person,
  r.team_vs_team_count / r.team_count AS cross_team
FROM ({REPORT_SQL}) r LEFT JOIN {label_sql(f"(SELECT kungfus AS k FROM ({REPORT_SQL})) t0")} l ON l.k = r.kungfus"""


def rates(d: Domain):
    return R.team_kungfu_rates(report(d), kitems(d))


def flat_rates(df):
    return df.select("short", "grade", flat("kungfus").alias("kungfus"), "total_count", "team_weight",
                     "person_rate", "team_rate", F.col("cross.person").alias("cross_person"),
                     F.col("cross.team").alias("cross_team"))


@query("team_kungfu_rates", f"""
SELECT short, grade, array_to_string(kungfus, ',') AS kungfus, total_count, team_weight, person_rate,
       team_rate, cross_person, cross_team FROM ({RATES_SQL})""")
def q_team_kungfu_rates(spark, sf):
    return flat_rates(rates(Domain(spark, sf)))


@query("top_lineups", f"""
SELECT short, grade, array_to_string(kungfus, ',') AS kungfus, total_count, team_weight, person_rate,
       team_rate, cross_person, cross_team
FROM (SELECT *, row_number() OVER (PARTITION BY grade ORDER BY total_count DESC NULLS LAST, kungfus) AS rn
      FROM ({RATES_SQL})) WHERE rn <= 200""")
def q_top_lineups(spark, sf):
    return flat_rates(R.top_lineups(rates(Domain(spark, sf)), grade=None, order="total_count", n=200))


@query("with_kungfu", f"""
SELECT {", ".join(c for c in REPORT_COLS)}, array_to_string(kungfus, ',') AS kungfus FROM ({REPORT_SQL})
WHERE list_contains(kungfus, {KUNGFU})""")
def q_with_kungfu(spark, sf):
    return R.with_kungfu(report(Domain(spark, sf)), KUNGFU).select(*REPORT_COLS, flat("kungfus").alias("kungfus"))


ROLE_WEIGHT_SQL = """
SELECT role_id, CAST(coalesce(sum(count) FILTER (WHERE in_team), 0) AS BIGINT) AS team,
       CAST(coalesce(sum(count) FILTER (WHERE NOT in_team), 0) AS BIGINT) AS person
FROM (SELECT unnest(role_ids) AS role_id, in_team, count FROM day_team_map) GROUP BY role_id"""


@query("role_team_weight", ROLE_WEIGHT_SQL)
def q_role_team_weight(spark, sf):
    return R.role_team_weight(R.day_team_map(teams(Domain(spark, sf))))


@query("role_team_rate", f"""
SELECT role_id, team, person, team + person AS total, team / (team + person) AS team_rate FROM ({ROLE_WEIGHT_SQL})""")
def q_role_team_rate(spark, sf):
    return R.role_team_rate(R.role_team_weight(R.day_team_map(teams(Domain(spark, sf)))))


@query("team_repeat_histogram", "SELECT count, count(*) AS weight FROM day_team_map GROUP BY count")
def q_team_repeat_histogram(spark, sf):
    return R.team_repeat_histogram(R.day_team_map(teams(Domain(spark, sf))))


HIST_BINS = 20


@query("weighted_histogram", f"""
WITH w AS ({ROLE_WEIGHT_SQL}),
r AS (SELECT team / (team + person) AS v, team + person AS total FROM w),
b AS (SELECT min(v) AS lo, max(v) AS hi FROM r)
SELECT CAST(bin AS INTEGER) AS bin, CAST(sum(total) AS BIGINT) AS weight,
       lo + (bin - 1) * ((hi - lo) / {HIST_BINS}) AS lower, lo + bin * ((hi - lo) / {HIST_BINS}) AS upper
FROM (SELECT CASE WHEN b.hi = b.lo THEN 1 ELSE least(floor({HIST_BINS} * (r.v - b.lo) / (b.hi - b.lo)) + 1, {HIST_BINS}) END AS bin,
             r.total, b.lo, b.hi FROM r, b WHERE r.v IS NOT NULL)
GROUP BY bin, lo, hi""")
def q_weighted_histogram(spark, sf):
    rr = R.role_team_rate(R.role_team_weight(R.day_team_map(teams(Domain(spark, sf)))))
    return R.weighted_histogram(rr, "team_rate", "total", HIST_BINS)


SCORE_LINE_SQL = """string_agg(concat_ws(':', s.match_type, coalesce(CAST(s.score AS VARCHAR), ''),
  coalesce(CAST(s.ranking AS VARCHAR), ''), CAST(s.total_count AS VARCHAR),
  coalesce(CAST(round(s.win_count / s.total_count, 3) AS VARCHAR), '')), ';' ORDER BY s.match_type)
  FILTER (WHERE s.role_id IS NOT NULL)"""


@query("role_summary", f"""
SELECT r.global_id, r.name, r.person_id, p.name AS person_name,
       CAST(coalesce(sum(s.fetched_count), 0) AS BIGINT) AS fetched_count, max(s.fetched_at) AS fetched_at,
       {SCORE_LINE_SQL} AS scores
FROM roles r LEFT JOIN persons p ON p.person_id = r.person_id LEFT JOIN scores s ON s.role_id = r.global_id
GROUP BY r.global_id, r.name, r.person_id, p.name""")
def q_role_summary(spark, sf):
    d = Domain(spark, sf)
    x = R.role_summary(d.roles, d.persons, d.scores)
    line = lambda s: F.concat_ws(":", s["match_type"], F.coalesce(s["score"].cast("string"), F.lit("")),
                                 F.coalesce(s["ranking"].cast("string"), F.lit("")), s["total_count"].cast("string"),
                                 F.coalesce(s["win_rate"].cast("string"), F.lit("")))
    return x.select("global_id", "name", "person_id", "person_name", "fetched_count", "fetched_at",
                    F.nullif(F.array_join(F.transform("scores", line), ";"), F.lit("")).alias("scores"))


@query("person_summary", """
SELECT p.person_id, p.name, r.global_id, r.name AS role_name, r.force, r.passport_id
FROM persons p LEFT JOIN roles r ON r.person_id = p.person_id""")
def q_person_summary(spark, sf):
    d = Domain(spark, sf)
    return R.person_summary(d.persons, d.roles)


@query("summary_counts", """
SELECT (SELECT count(*) FROM roles) AS roles, (SELECT count(*) FROM persons) AS persons,
       (SELECT count(*) FROM matches WHERE match_type = '3c') AS matches,
       (SELECT count(*) FROM scores WHERE fetched_at IS NOT NULL) AS fetched""")
def q_summary_counts(spark, sf):
    d = Domain(spark, sf)
    return R.summary_counts(d.roles, d.persons, d.matches, d.scores)


@query("role_match_count", "SELECT role_id, count(*) AS count FROM match_roles WHERE match_type = '3c' GROUP BY role_id")
def q_role_match_count(spark, sf):
    return R.role_match_count(Domain(spark, sf).match_roles)


@query("count_word", "SELECT value, count(*) AS count FROM (SELECT unnest(kungfus) AS value FROM teams) GROUP BY value")
def q_count_word(spark, sf):
    return R.count_word(teams(Domain(spark, sf)), "kungfus")


@query("team_scores", """
SELECT match_id, team, CAST(sum(score2) AS BIGINT) AS team_score FROM match_roles GROUP BY match_id, team""")
def q_team_scores(spark, sf):
    return R.team_scores(Domain(spark, sf).match_roles).drop("match_type")


@query("fetched_counts", "SELECT role_id, count(*) AS fetched FROM match_roles GROUP BY role_id")
def q_fetched_counts(spark, sf):
    return R.fetched_counts(Domain(spark, sf).match_roles)


@query("describe")
def q_describe(spark, sf):
    return R.describe(flat_rates(rates(Domain(spark, sf))), "total_count", "team_weight", "person_rate", "team_rate")


DESCRIBED = ["score2", "kungfu", "seat"]


@query("describe_columns", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", count({c}) AS count, round(avg(CAST({c} AS DOUBLE)), 6) AS mean, CAST(min({c}) AS DOUBLE) AS min,
       CAST(max({c}) AS DOUBLE) AS max, true AS within FROM match_roles""" for c in DESCRIBED))
def q_describe_columns(spark, sf):
    """Moments, and whether each quantile's rank is within the bound (judged
    against exact ranks)."""
    shares, bound = (0.25, 0.5, 0.75), 1e-3
    x = Domain(spark, sf).match_roles
    d = R.describe_columns(x, DESCRIBED, shares, accuracy=1000)
    values = x.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in DESCRIBED])).alias("e")).select("e.*")
    met = values.join(F.broadcast(d.select("column", "quantiles")), "column")
    near = F.lit(True)
    for i, s in enumerate(shares):
        q = F.col("quantiles")[i]
        below, upto = F.count_if(F.col("v") < q) / F.count("v"), F.count_if(F.col("v") <= q) / F.count("v")
        near = near & (below <= s + bound) & (upto >= s - bound)
    ranks = met.groupBy("column").agg(near.alias("within"))
    return d.join(ranks, "column").select("column", "count", F.round("mean", 6).alias("mean"), "min", "max", "within")


@query("kungfu_items", "SELECT id, content, kungfu, short, rank FROM kungfu_items")
def q_kungfu_items(spark, sf):
    return kitems(Domain(spark, sf))


COUNT_BINS = 30


@query("count_histogram", f"""
WITH r AS (SELECT CAST(count AS DOUBLE) AS v, count(*) AS w FROM day_team_map GROUP BY count),
b AS (SELECT min(v) AS lo, max(v) AS hi FROM r)
SELECT CAST(bin AS INTEGER) AS bin, CAST(sum(w) AS BIGINT) AS weight,
       lo + (bin - 1) * ((hi - lo) / {COUNT_BINS}) AS lower, lo + bin * ((hi - lo) / {COUNT_BINS}) AS upper
FROM (SELECT CASE WHEN b.hi = b.lo THEN 1 ELSE least(floor({COUNT_BINS} * (r.v - b.lo) / (b.hi - b.lo)) + 1, {COUNT_BINS}) END
             AS bin, r.w, b.lo, b.hi FROM r, b WHERE r.v IS NOT NULL)
GROUP BY bin, lo, hi""")
def q_count_histogram(spark, sf):
    """D11 over D10: repeat counts of (day, team) groups in 30 bins."""
    hist = R.team_repeat_histogram(R.day_team_map(teams(Domain(spark, sf))))
    return R.weighted_histogram(hist, "count", "weight", COUNT_BINS)
