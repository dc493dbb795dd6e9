"""Queries for the scalar functions (H1–H29), each over a driver column."""

from __future__ import annotations

from pyspark.sql import functions as F

from skirmish.functions import scalars as H
from skirmish.functions.kungfu import label_sql, lineup_labels
from skirmish.functions.ranges import diff_date
from skirmish.operators import joins as C
from skirmish.operators import reports as R
from skirmish.plans.catalog import query
from skirmish.plans.q_reports import kitems
from skirmish.sources.fixtures import Domain

URL_PREFIX = "https://"


@query("trim_quotes", "SELECT tag, id, trim(content, '\"') AS content FROM items")
def q_trim_quotes(spark, sf):
    return Domain(spark, sf).items.select("tag", "id", H.trim_quotes("content").alias("content"))


@query("show_kungfus", f"""
SELECT array_to_string(l.k, ',') AS kungfus, l.short FROM {label_sql("(SELECT kungfus AS k FROM teams) t0")} l""")
def q_show_kungfus(spark, sf):
    d = Domain(spark, sf)
    lineups = R.split_team(d.matches).select("kungfus").distinct()
    return lineup_labels(lineups, "kungfus", kitems(d)).select(H.flat("kungfus").alias("kungfus"), "short")


@query("empty_nil", "SELECT page_id, nullif(regexp_extract(url, '#(.*)$', 1), '') AS fragment FROM pages")
def q_empty_nil(spark, sf):
    p = Domain(spark, sf).raw("pages")
    return p.select("page_id", H.empty_nil(F.regexp_extract("url", "#(.*)$", 1)).alias("fragment"))


@query("pad_int", """
SELECT c_custkey, CASE WHEN length(CAST(c_custkey AS VARCHAR)) >= 4 THEN CAST(c_custkey AS VARCHAR)
                       ELSE lpad(CAST(c_custkey AS VARCHAR), 4, '0') END AS padded FROM customer""")
def q_pad_int(spark, sf):
    c = Domain(spark, sf).raw("customer")
    return c.select("c_custkey", H.pad_int("c_custkey", 4).alias("padded"))


@query("compact_timestamp", "SELECT event_id, substr(strftime(ts, '%Y%m%d%H%M%S%f'), 1, 17) AS stamp FROM events")
def q_compact_timestamp(spark, sf):
    e = Domain(spark, sf).raw("events")
    return e.select("event_id", H.compact_timestamp("ts").alias("stamp"))


@query("icon_url_trim", f"""
SELECT page_id, CASE WHEN regexp_matches(url, 'https://([^?]*)')
                     THEN regexp_extract(url, 'https://([^?]*)', 1) ELSE url END AS path FROM pages""")
def q_icon_url_trim(spark, sf):
    p = Domain(spark, sf).raw("pages")
    return p.select("page_id", H.icon_url_trim("url", URL_PREFIX).alias("path"))


PERCENT_VALUE = """CAST(event_id % 100 AS VARCHAR) ||
  CASE event_type WHEN 'click' THEN '%' WHEN 'view' THEN ' pts' WHEN 'error' THEN '.5x' ELSE '' END"""


@query("percent_name", f"""
SELECT event_id, event_type || regexp_extract({PERCENT_VALUE}, '^([+-]?[0-9]+(\\.[0-9]+)?([eE][+-]?[0-9]+)?)(.*)$', 4)
  AS name FROM events""")
def q_percent_name(spark, sf):
    e = Domain(spark, sf).raw("events")
    value = F.concat((F.col("event_id") % 100).cast("string"),
                     F.when(F.col("event_type") == "click", "%").when(F.col("event_type") == "view", " pts")
                     .when(F.col("event_type") == "error", ".5x").otherwise(""))
    return e.select("event_id", H.percent_name("event_type", value).alias("name"))


ZONE_SQL = """CASE WHEN n_nationkey = 24 THEN NULL WHEN n_nationkey = 23 THEN ''
  WHEN n_nationkey % 3 = 0 THEN '电信' || n_name WHEN n_nationkey % 3 = 1 THEN '双线' || n_name
  ELSE n_name || '电信' END"""


def zones(d: Domain):
    k = F.col("n_nationkey")
    z = (F.when(k == 24, F.lit(None).cast("string")).when(k == 23, F.lit(""))
         .when(k % 3 == 0, F.concat(F.lit("电信"), "n_name")).when(k % 3 == 1, F.concat(F.lit("双线"), "n_name"))
         .otherwise(F.concat("n_name", F.lit("电信"))))
    return d.raw("nation").select("n_nationkey", z.alias("zone"))


@query("zone_suffix", f"""
SELECT n_nationkey, zone,
  CASE WHEN zone IS NULL OR zone = '' THEN '' WHEN starts_with(zone, '电信') THEN 'c'
       WHEN starts_with(zone, '双线') THEN 'd' ELSE 'm' END AS suffix,
  CASE WHEN zone LIKE '%电信%' THEN 'c' WHEN zone LIKE '%双线%' THEN 'd' ELSE 'm' END AS suffix_sql
FROM (SELECT n_nationkey, {ZONE_SQL} AS zone FROM nation)""")
def q_zone_suffix(spark, sf):
    z = zones(Domain(spark, sf))
    return z.select("n_nationkey", "zone", H.zone_suffix("zone").alias("suffix"), H.zone_suffix_sql("zone").alias("suffix_sql"))


@query("default_match_type", f"""
SELECT n_nationkey, CASE WHEN zone IS NULL OR zone = '' THEN '3c' WHEN starts_with(zone, '电信') THEN '3c'
       WHEN starts_with(zone, '双线') THEN '3d' ELSE '3m' END AS match_type
FROM (SELECT n_nationkey, {ZONE_SQL} AS zone FROM nation)""")
def q_default_match_type(spark, sf):
    z = zones(Domain(spark, sf))
    return z.select("n_nationkey", H.default_match_type("zone").alias("match_type"))


@query("pvp_type", """
SELECT n_nationkey, coalesce(TRY_CAST(nullif(regexp_extract(mt, '^([+-]?[0-9]+)', 1), '') AS INTEGER), 0) AS pvp_type
FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 'x' || n_name ELSE CAST(n_nationkey AS VARCHAR) || 'c' END AS mt
      FROM nation)""")
def q_pvp_type(spark, sf):
    n = Domain(spark, sf).raw("nation")
    mt = F.when(F.col("n_nationkey") % 4 == 0, F.concat(F.lit("x"), "n_name")).otherwise(
        F.concat(F.col("n_nationkey").cast("string"), F.lit("c")))
    return n.select("n_nationkey", H.pvp_type(mt).alias("pvp_type"))


RANKING_SQL = """CASE o_orderkey % 4 WHEN 0 THEN '-' WHEN 1 THEN CAST(o_orderkey % 100 AS VARCHAR) || '%'
  WHEN 2 THEN CAST(o_orderkey % 1000 AS VARCHAR) ELSE NULL END"""


@query("parse_ranking", f"""
SELECT o_orderkey, CASE WHEN r = '-' THEN NULL WHEN r LIKE '%\\%' ESCAPE '\\' THEN -TRY_CAST(rtrim(r, '%') AS INTEGER)
                        ELSE TRY_CAST(r AS INTEGER) END AS ranking
FROM (SELECT o_orderkey, {RANKING_SQL} AS r FROM orders)""")
def q_parse_ranking(spark, sf):
    o = Domain(spark, sf).raw("orders")
    k = F.col("o_orderkey")
    r = (F.when(k % 4 == 0, F.lit("-")).when(k % 4 == 1, F.concat((k % 100).cast("string"), F.lit("%")))
         .when(k % 4 == 2, (k % 1000).cast("string")))
    return o.select("o_orderkey", H.parse_ranking(r).alias("ranking"))


@query("parse_attrs", """
SELECT event_id, CAST(user_id AS DOUBLE) AS a0,
       TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS a1, CAST(NULL AS DOUBLE) AS a2 FROM events""")
def q_parse_attrs(spark, sf):
    e = Domain(spark, sf).raw("events")
    attrs = F.array(F.concat(F.col("user_id").cast("string"), F.lit("px")),
                    F.concat(F.regexp_extract("props", "([0-9]+)", 1), F.lit("%")), F.lit("n/a"))
    p = H.parse_attrs(attrs)
    return e.select("event_id", p[0].alias("a0"), p[1].alias("a1"), p[2].alias("a2"))


@query("start_date", """
SELECT match_id, make_timestamp(start_time * 1000000) AS start_ts, CAST(make_timestamp(start_time * 1000000) AS DATE) AS start_date
FROM matches""")
def q_start_date(spark, sf):
    m = Domain(spark, sf).matches
    return m.select("match_id", H.start_time("start_time").alias("start_ts"),
                    H.start_date(H.start_time("start_time")).alias("start_date"))


@query("win_rate", "SELECT role_id, round(win_count / total_count, 3) AS win_rate FROM scores")
def q_win_rate(spark, sf):
    return Domain(spark, sf).scores.select("role_id", H.win_rate("win_count", "total_count").alias("win_rate"))


@query("grade_of_score", """
SELECT role_id, CASE WHEN score IS NULL THEN NULL ELSE CAST(greatest(least(CAST(trunc(score / 100) AS BIGINT) - 10, 13), 0) AS INTEGER) END AS grade FROM scores""")
def q_grade_of_score(spark, sf):
    return Domain(spark, sf).scores.select("role_id", H.grade_of_score("score").alias("grade"))


@query("equip_addition", "SELECT match_id, role_id, score2 + seat AS equip_addition_score FROM match_roles")
def q_equip_addition(spark, sf):
    mr = Domain(spark, sf).match_roles
    return mr.select("match_id", "role_id", H.equip_addition("score2", "seat").alias("equip_addition_score"))


@query("winner_of", "SELECT match_id, CASE WHEN team1_score > team2_score THEN 1 ELSE 2 END AS winner FROM matches")
def q_winner_of(spark, sf):
    m = Domain(spark, sf).matches
    return m.select("match_id", H.winner_of(F.col("team1_score") > F.col("team2_score")).alias("winner"))


@query("mean_team_score", """
SELECT match_id, CAST(trunc(team1_score / 3) AS BIGINT) AS mean1, CAST(trunc(team2_score / 2) AS BIGINT) AS mean2 FROM matches""")
def q_mean_team_score(spark, sf):
    m = Domain(spark, sf).matches
    return m.select("match_id", H.mean_team_score("team1_score").alias("mean1"),
                    H.mean_team_score("team2_score", F.size("team2_kungfu")).alias("mean2"))


def _human(n: str) -> str:
    def fmt(div: int, suf: str) -> str:
        return (f"CAST(CAST(trunc({n} / {div}) AS BIGINT) AS VARCHAR) || '.' || "
                f"CAST(CAST(trunc(({n} % {div}) * 10 / {div}) AS BIGINT) AS VARCHAR) || '{suf}'")
    return (f"CASE WHEN {n} < 1000 THEN CAST({n} AS VARCHAR) WHEN {n} < 1000000 THEN {fmt(1000, 'K')} "
            f"WHEN {n} < 1000000000 THEN {fmt(1000000, 'M')} ELSE {fmt(1000000000, 'B')} END")


@query("humanize_count", f"""
SELECT o_orderkey, {_human('n')} AS human FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS n FROM orders)""")
def q_humanize_count(spark, sf):
    o = Domain(spark, sf).raw("orders")
    return o.select("o_orderkey", H.humanize_count(F.floor("o_totalprice")).alias("human"))


@query("array_toolkit", """
SELECT match_id, CAST(len(role_ids) AS INTEGER) AS n, array_to_string(role_ids[2:3], ',') AS middle,
       array_to_string(list_sort(list_reverse(team1_kungfu)), ',') AS sorted1,
       list_contains(team1_kungfu, 10021) AS has_click FROM matches""")
def q_array_toolkit(spark, sf):
    m = Domain(spark, sf).matches
    return m.select("match_id", F.size("role_ids").alias("n"), H.flat(F.slice("role_ids", 2, 2)).alias("middle"),
                    H.flat(H.sort_kungfus(F.reverse("team1_kungfu"))).alias("sorted1"),
                    F.array_contains("team1_kungfu", 10021).alias("has_click"))


@query("zip_seats", """
SELECT match_id, array_to_string(list_transform(range(1, least(len(team1_kungfu), len(role_ids)) + 1),
                                 lambda i: role_ids[i] || ':' || CAST(team1_kungfu[i] AS VARCHAR)), ',') AS team1
FROM matches""")
def q_zip_seats(spark, sf):
    m = Domain(spark, sf).matches
    z = H.zip_shortest(H.take("role_ids", F.size("team1_kungfu")), "team1_kungfu")
    return m.select("match_id", F.array_join(F.transform(
        z, lambda x: F.concat(x["a"], F.lit(":"), x["b"].cast("string"))), ",").alias("team1"))


@query("encode_key", """
SELECT tag, id, CASE WHEN starts_with(k, '"') THEN substr(k, 2, greatest(length(k) - 2, 0))
                     WHEN starts_with(k, ':') THEN substr(k, 2)
                     WHEN TRY_CAST(k AS BIGINT) IS NOT NULL THEN CAST(TRY_CAST(k AS BIGINT) AS VARCHAR)
                     ELSE k END AS encoded,
       TRY_CAST(id AS INTEGER) AS id_int
FROM (SELECT tag, id, CASE WHEN tag = 'brand' THEN ':' || id ELSE content END AS k FROM items
      UNION ALL SELECT tag, id, id AS k FROM items)""")
def q_encode_key(spark, sf):
    i = Domain(spark, sf).items
    k = i.select("tag", "id", F.when(F.col("tag") == "brand", F.concat(F.lit(":"), "id")).otherwise(F.col("content")).alias("k"))
    k = k.unionByName(i.select("tag", "id", F.col("id").alias("k")))
    return k.select("tag", "id", H.encode_key("k").alias("encoded"), H.decode_key_int("id").alias("id_int"))


@query("role_ids_of", """
SELECT m.match_id, CASE WHEN m.match_id % 5 = 0 THEN p.ids ELSE array_to_string(m.role_ids, ',') END AS role_ids
FROM matches m JOIN (SELECT match_id, string_agg(role_id, ',' ORDER BY role_id) AS ids FROM match_roles GROUP BY match_id) p
  ON p.match_id = m.match_id""")
def q_role_ids_of(spark, sf):
    d = Domain(spark, sf)
    mr = d.match_roles.select("match_id", F.col("role_id").alias("global_id"))
    x = C.nest(d.matches, mr, "match_id", "roles", how="inner")
    given = F.when(F.col("match_id") % 5 != 0, F.col("role_ids"))
    return x.select("match_id", F.array_join(H.role_ids_of(given, "roles"), ",").alias("role_ids"))


@query("diff_date", "SELECT user_id, day, CAST(date_diff('day', DATE '2024-01-01', day) AS INTEGER) AS days FROM seen_days")
def q_diff_date(spark, sf):
    s = Domain(spark, sf).seen_days
    return s.select("user_id", "day", diff_date("day", F.lit("2024-01-01").cast("date")).alias("days"))


@query("put_default", "SELECT role_id, coalesce(score, 0) AS score, coalesce(ranking, -1) AS ranking FROM scores")
def q_put_default(spark, sf):
    s = Domain(spark, sf).scores
    return s.select("role_id", H.put_default("score", 0).alias("score"), H.put_default("ranking", -1).alias("ranking"))


SCORE_JSON_SQL = """'{' || concat_ws(',', '"role_id":' || to_json(role_id), '"match_type":' || to_json(match_type),
  '"score":' || to_json(score), '"total_count":' || to_json(total_count), '"win_count":' || to_json(win_count),
  '"mvp_count":' || to_json(mvp_count), '"fetched_to":' || to_json(fetched_to), '"fetched_count":' || to_json(fetched_count),
  '"ranking":' || to_json(ranking), '"fetched_at":"' || strftime(fetched_at, '%Y-%m-%dT%H:%M:%S.%g') || '"') || '}'"""


@query("to_json_row", f"SELECT {SCORE_JSON_SQL} AS value FROM scores")
def q_to_json_row(spark, sf):
    return Domain(spark, sf).scores.select(H.to_json_row().alias("value"))
