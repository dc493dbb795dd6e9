"""Queries for J1–J10: payload JSON is built from the driver tables with
``to_json`` (one response per page of at most 200 entries), flattened by
the J operators, and compared with the same rows selected straight from
the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skirmish.functions.scalars import flat, grade_of_score
from skirmish.operators.ordered import dictionary_versions
from skirmish.plans.catalog import query
from skirmish.plans.q_reports import MATCH_COLS_SQL, flat_matches
from skirmish.sources import payloads as J
from skirmish.sources.fixtures import Domain

CDN = "https://cdn.example/"
PAGE = 200


def _page(df, key, entry, extra=()):
    """One JSON array per (extra…, key div PAGE) — a bounded response."""
    g = df.groupBy(*extra, F.expr(f"{key} div {PAGE}").alias("_page"))
    return g.agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("payload"))


def _roles_people(d: Domain):
    p = d.persons.select("person_id", F.col("name").alias("person_name"))
    return d.roles.join(p, "person_id", "left")


def top200_payloads(d: Domain):
    r = _roles_people(d)
    k = F.col("role_id")
    entry = F.struct(
        k.alias("_k"),
        F.coalesce("passport_id", F.lit("")).alias("passportId"), F.col("global_id").alias("globalId"),
        F.col("person_id").alias("personId"),
        F.struct(F.when(k % 9 == 0, F.lit("")).otherwise(k.cast("string")).alias("gameRoleId"),
                 F.col("name").alias("roleName"), "server", "zone", "force", F.col("body_type").alias("bodyType"),
                 F.struct(F.col("person_name").alias("nickName"), F.lit("").alias("avatarUrl"),
                          F.when(k % 2 == 0, F.concat(F.lit("sig"), k.cast("string"))).otherwise(F.lit(""))
                          .alias("signature")).alias("person")).alias("personInfo"))
    return d.landed("top200_payloads", _page(r, "role_id", entry))


@query("flatten_top200", """
SELECT r.passport_id, r.global_id, CASE WHEN r.role_id % 9 = 0 THEN NULL ELSE r.role_id END AS role_id, r.name,
       r.server, r.zone, r.force, r.body_type, CAST(NULL AS VARCHAR) AS camp, r.person_id, p.name AS person_name,
       CAST(NULL AS VARCHAR) AS avatar, CASE WHEN r.role_id % 2 = 0 THEN 'sig' || CAST(r.role_id AS VARCHAR) END AS signature
FROM roles r LEFT JOIN persons p ON p.person_id = r.person_id""")
def q_flatten_top200(spark, sf):
    return J.flatten_top200(top200_payloads(Domain(spark, sf)))


def person_roles_payloads(d: Domain):
    r = _roles_people(d)
    k = F.col("role_id")
    entry = F.struct(
        k.alias("_k"), F.col("global_id").alias("gameGlobalRoleId"), k.cast("string").alias("gameRoleId"),
        "passport_id", "name", "server", "zone", "force", F.lit("").alias("bodily"),
        F.when(k % 3 == 0, (k % 100).cast("int")).otherwise(F.lit(100)).alias("level"),
        (k % 5 != 0).alias("valid"), "person_id", "person_name",
        F.concat(F.lit("a"), F.col("person_id")).alias("person_avatar"))
    return d.landed("person_roles_payloads", _page(r, "role_id", entry, extra=["person_id"]))


@query("flatten_person_roles", """
SELECT r.global_id, r.role_id, r.passport_id, r.name, r.server, r.zone, r.force, CAST(NULL AS VARCHAR) AS body_type,
       CAST(NULL AS VARCHAR) AS camp, CASE WHEN r.role_id % 3 = 0 THEN CAST(r.role_id % 100 AS INTEGER) ELSE 100 END AS level,
       r.role_id % 5 <> 0 AS valid, r.person_id, p.name AS person_name, 'a' || r.person_id AS avatar,
       CAST(NULL AS VARCHAR) AS signature
FROM roles r LEFT JOIN persons p ON p.person_id = r.person_id""")
def q_flatten_person_roles(spark, sf):
    return J.flatten_person_roles(person_roles_payloads(Domain(spark, sf)))


def role_kungfu_payloads(d: Domain):
    rk = d.role_kungfus
    skill = F.struct(
        F.concat(F.lit(CDN), F.col("kungfu"), F.lit(".png?v="), F.col("total_count").cast("string")).alias("icon"),
        F.concat(F.col("kungfu"), F.lit("-1")).alias("name"),
        F.when(F.col("total_count") % 2 == 0, F.lit(0.5)).alias("accuracy"),
        F.col("win_count").alias("success_times"), F.col("total_count").alias("times"))
    entry = F.struct(F.col("kungfu").alias("name"), F.array(skill).alias("skills"))
    # one response per role: its classes (a bounded list)
    return d.landed("role_kungfu_payloads", rk.groupBy("role_id", "match_type").agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("payload")))


@query("flatten_role_kungfus", """
SELECT role_id, match_type, kungfu,
       kungfu || '.png|' || kungfu || '-1|' || coalesce(CAST(CASE WHEN total_count % 2 = 0 THEN win_count END AS VARCHAR), '')
       || '|' || CAST(total_count AS VARCHAR) AS skills
FROM role_kungfus""")
def q_flatten_role_kungfus(spark, sf):
    x = J.flatten_role_kungfus(role_kungfu_payloads(Domain(spark, sf)), CDN)
    text = F.array_join(F.transform("skills", lambda s: F.concat_ws(
        "|", s["icon"], s["name"], F.coalesce(s["accuracy"].cast("string"), F.lit("")), s["times"].cast("string"))), ";")
    return x.select("role_id", "match_type", "kungfu", text.alias("skills"))


def role_by_gid_payloads(d: Domain):
    r = _roles_people(d)
    k = F.col("role_id")
    info = F.struct(F.col("global_id").alias("gameGlobalRoleId"), k.cast("string").alias("gameRoleId"),
                    F.col("name").alias("roleName"), "server", "zone", "force", F.col("body_type").alias("bodyType"),
                    F.struct(F.col("person_name").alias("nickName"), F.lit("").alias("avatarUrl")).alias("person"))
    return d.landed("role_by_gid_payloads", r.select(F.to_json(F.struct(F.when(k % 6 != 0, info).alias("personInfo"),
                                       F.col("passport_id").alias("passportId"),
                                       F.col("person_id").alias("personId"))).alias("payload")))


@query("flatten_role_by_gid", """
SELECT r.global_id, r.role_id, r.passport_id, r.name, r.server, r.zone, r.force, r.body_type,
       CAST(NULL AS VARCHAR) AS camp, r.person_id, p.name AS person_name, CAST(NULL AS VARCHAR) AS avatar,
       CAST(NULL AS VARCHAR) AS signature
FROM roles r LEFT JOIN persons p ON p.person_id = r.person_id WHERE r.role_id % 6 <> 0""")
def q_flatten_role_by_gid(spark, sf):
    return J.flatten_role_by_gid(role_by_gid_payloads(Domain(spark, sf)))


def indicator_payloads(d: Domain):
    r = _roles_people(d)
    metric = F.struct("kungfu", F.lit(0).cast("long").alias("mvp_count"), "total_count", "win_count",
                      F.array(F.struct(F.lit(1).alias("grade"), F.lit("dps").alias("name"), F.lit("1.5").alias("value"),
                                       F.lit(3).alias("ranking"))).alias("items"))
    mets = d.role_kungfus.groupBy("role_id", "match_type").agg(F.array_sort(F.collect_list(metric)).alias("metrics"))
    s = d.scores.join(mets, ["role_id", "match_type"], "left")
    ind = F.struct(F.col("match_type").alias("type"), "metrics", F.struct(
        grade_of_score("score").alias("grade"), F.col("score").alias("mmr"), "ranking", "total_count", "win_count",
        "mvp_count").alias("performance"))
    per_role = s.groupBy("role_id").agg(F.collect_list(ind).alias("indicator"))  # one per match type
    x = per_role.join(r, per_role.role_id == r.global_id, "inner")
    return d.landed("indicator_payloads", x.select(F.to_json(F.struct(
        F.struct("person_id", "person_name").alias("person_info"),
        F.struct(F.col("global_id").alias("global_role_id"), r.role_id.cast("string").alias("role_id"), "name",
                 "server", "zone", "force", "body_type", F.lit("").alias("camp"), F.lit("").alias("person_avatar"))
        .alias("role_info"), "indicator")).alias("payload")))


@query("flatten_role_indicator", """
SELECT role_id, match_type, CASE WHEN score IS NULL THEN NULL ELSE CAST(greatest(least(CAST(trunc(score / 100) AS BIGINT) - 10, 13), 0) AS INTEGER) END AS grade,
       score, ranking, total_count, win_count, mvp_count FROM scores""")
def q_flatten_role_indicator(spark, sf):
    _roles, _persons, perf, _metrics = J.flatten_role_indicator(indicator_payloads(Domain(spark, sf)))
    return perf


@query("flatten_role_indicator_metrics", """
SELECT rk.role_id, rk.match_type, rk.kungfu, CAST(0 AS BIGINT) AS mvp_count, rk.total_count, rk.win_count, 'dps' AS metric
FROM role_kungfus rk JOIN scores s ON s.role_id = rk.role_id AND s.match_type = rk.match_type""")
def q_flatten_role_indicator_metrics(spark, sf):
    _roles, _persons, _perf, metrics = J.flatten_role_indicator(indicator_payloads(Domain(spark, sf)))
    return metrics.select("role_id", "match_type", "kungfu", "mvp_count", "total_count", "win_count",
                          F.col("metrics")[0]["name"].alias("metric"))


@query("flatten_role_indicator_roles", """
SELECT CAST(NULL AS VARCHAR) AS passport_id, r.global_id, r.role_id, r.name, r.server, r.zone, r.force, r.body_type,
       CAST(NULL AS VARCHAR) AS camp, r.person_id
FROM roles r WHERE EXISTS (SELECT 1 FROM scores s WHERE s.role_id = r.global_id)""")
def q_flatten_role_indicator_roles(spark, sf):
    roles, _persons, _perf, _metrics = J.flatten_role_indicator(indicator_payloads(Domain(spark, sf)))
    return roles


def corp_payloads(d: Domain):
    r = d.roles
    corp = F.struct(F.expr("cast(role_id * 10 + 1 as string)").alias("corpsId"), F.lit(3).alias("pvpType"),
                    F.concat(F.lit("corp"), F.col("global_id")).alias("corpsName"), "zone", "server")
    return d.landed("corp_payloads", r.select(F.to_json(F.array(corp)).alias("payload")))


@query("flatten_corps", """
SELECT role_id * 10 + 1 AS corp_id, 3 AS pvp_type, 'corp' || global_id AS name, zone, server FROM roles""")
def q_flatten_corps(spark, sf):
    return J.flatten_corps(corp_payloads(Domain(spark, sf)))


def history_payloads(d: Domain):
    m = d.matches.select("match_id", "start_time", "duration", "grade", "winner")
    h = d.match_roles.join(m, "match_id", "inner")
    entry = F.struct(
        "match_id", F.col("role_id").alias("global_role_id"), F.col("grade").alias("avg_grade"), "start_time",
        (F.col("start_time") + F.col("duration")).alias("end_time"), (F.col("seat") == 0).alias("mvp"),
        (F.col("team") == F.col("winner")).alias("won"), (F.col("score2") % 50).alias("mmr"),
        (F.lit(1500) + F.col("score2") % 1000).alias("total_mmr"), "kungfu", F.lit("z").alias("zone"),
        F.lit("s").alias("server"))
    # one history page per (role, block of match ids)
    return d.landed("history_payloads", _page(h, "match_id", entry, extra=["role_id", "match_type"]).drop("role_id"))


@query("flatten_role_history", """
SELECT mr.match_id, mr.match_type, mr.role_id AS global_id, m.grade AS avg_grade, m.start_time,
       m.start_time + m.duration AS end_time, mr.seat = 0 AS mvp, mr.team = m.winner AS won, mr.score2 % 50 AS score_diff,
       1500 + mr.score2 % 1000 AS score, mr.kungfu, 'z' AS zone, 's' AS server
FROM match_roles mr JOIN matches m ON m.match_id = mr.match_id""")
def q_flatten_role_history(spark, sf):
    return J.flatten_role_history(history_payloads(Domain(spark, sf)))


def replay_payloads(d: Domain):
    c = d.raw("conversations")
    g = c.groupBy("conv_id").agg(
        F.max("turn").alias("match_duration"),
        F.array_sort(F.collect_list(F.struct(F.col("turn").alias("ts"), F.col("role").alias("skillName")))).alias("replay"))
    body = F.to_json(F.struct(F.col("conv_id").alias("match_id"), "match_duration", "replay",
                              F.array(F.lit("x")).alias("skill_cate")))
    return d.landed("replay_payloads", g.select(F.lit("3c").alias("match_type"), F.when(F.col("conv_id") % 7 == 0,
                    F.lit('{"error": "No data found"}')).otherwise(body).alias("payload")))


@query("flatten_match_replay", """
SELECT conv_id AS match_id, '3c' AS match_type, max(turn) AS match_duration, count(*) AS n_replay
FROM conversations WHERE conv_id % 7 <> 0 GROUP BY conv_id""")
def q_flatten_match_replay(spark, sf):
    x = J.flatten_match_replay(replay_payloads(Domain(spark, sf)))
    return x.select("match_id", "match_type", "match_duration", F.size("replay").cast("long").alias("n_replay"))


def detail_payloads(d: Domain):
    mr = d.match_roles
    k7, k11 = (F.col("kungfu") % 7).cast("string"), (F.col("kungfu") % 11).cast("string")
    player = F.struct(
        F.col("seat").alias("_seat"), F.col("role_id").alias("global_role_id"), "role_id",
        F.concat(F.lit("r"), F.col("role_id")).alias("role_name"), F.lit("z").alias("zone"), F.lit("s").alias("server"),
        F.col("kungfu").alias("kungfu_id"), F.concat(F.col("kungfu").cast("string"), F.lit("name")).alias("kungfu"),
        (F.col("score2") + 1000).alias("mmr"), F.col("score2").alias("score"), F.col("seat").alias("ranking"),
        F.lit(10).alias("total_count"), F.lit(5).alias("win_count"), F.lit(1).alias("mvp_count"),
        (F.col("score2") % 1000).alias("equip_score"), (F.col("seat") * 10).alias("equip_strength_score"),
        F.lit(5).alias("stone_score"), (F.lit(10000) + F.col("score2")).alias("max_hp"),
        F.array(F.struct(F.lit("dps").alias("name"), F.concat(F.col("score2").cast("string"), F.lit("%")).alias("value")),
                F.struct(F.lit("hps").alias("name"), F.lit("12.5").alias("value"))).alias("metrics"),
        F.array(F.struct(F.concat(F.lit("100"), k7).alias("ui_id"), F.concat(F.lit("armor"), k7).alias("name"),
                         F.concat(F.lit(CDN + "a"), k7, F.lit(".png?v=2")).alias("icon"), F.lit(3).alias("quality"),
                         F.col("seat").alias("strength_level"), F.col("seat").alias("pos"))).alias("armors"),
        F.array(F.struct(k11.alias("id"), F.concat(F.lit("t"), k11).alias("name"),
                         F.lit(CDN + "t.png").alias("icon"), F.lit(1).alias("level"))).alias("talents"),
        F.array(F.struct(F.lit("hp").alias("name"), (F.lit(10000) + F.col("score2")).cast("string").alias("value")))
        .alias("body_qualities"))
    teams = mr.groupBy("match_id").agg(  # one match's seats: bounded
        F.array_sort(F.collect_list(F.when(F.col("team") == 1, player))).alias("t1"),
        F.array_sort(F.collect_list(F.when(F.col("team") == 2, player))).alias("t2"))
    m = d.matches.join(teams, "match_id", "inner")
    body = F.struct("match_id", F.struct("start_time", "duration", F.col("map").cast("string").alias("map"),
                                         F.col("pvp_type").alias("type"), "grade").alias("basic_info"),
                    F.struct((F.col("winner") == 1).alias("won"), F.col("t1").alias("players_info")).alias("team1"),
                    F.struct((F.col("winner") == 2).alias("won"), F.col("t2").alias("players_info")).alias("team2"))
    return d.landed("detail_payloads", m.select("match_type", F.to_json(body).alias("payload")))


@query("flatten_match_detail", f"SELECT {MATCH_COLS_SQL} FROM matches")
def q_flatten_match_detail(spark, sf):
    matches, _roles = J.flatten_match_detail(detail_payloads(Domain(spark, sf)))
    return flat_matches(matches)


@query("flatten_match_detail_roles", """
SELECT mr.match_id, mr.match_type, mr.team, mr.role_id AS global_id, mr.kungfu, mr.score2 + 1000 AS score, mr.score2,
       CAST(greatest(least(CAST(trunc(mr.score2 / 100) AS BIGINT) - 10, 13), 0) AS INTEGER) AS grade,
       mr.seat * 10 + 5 AS equip_addition_score,
       CAST(mr.score2 AS VARCHAR) || ',12.5' AS metrics, 'dps%,hps' AS metric_names,
       '100' || CAST(mr.kungfu % 7 AS VARCHAR) AS equips, CAST(mr.kungfu % 11 AS VARCHAR) AS talents,
       CAST(10000 + mr.score2 AS VARCHAR) AS attrs
FROM match_roles mr JOIN matches m ON m.match_id = mr.match_id""")
def q_flatten_match_detail_roles(spark, sf):
    _matches, roles = J.flatten_match_detail(detail_payloads(Domain(spark, sf)))
    num = lambda c: F.array_join(F.transform(c, lambda x: F.regexp_replace(x.cast("string"), r"\.0$", "")), ",")
    return roles.select("match_id", "match_type", "team", "global_id", "kungfu", "score", "score2", "grade",
                        "equip_addition_score", num("metrics").alias("metrics"),
                        F.array_join("metric_names", ",").alias("metric_names"), flat("equips").alias("equips"),
                        flat("talents").alias("talents"), num("attrs").alias("attrs"))


@query("collect_dictionary", f"""
SELECT DISTINCT 'kungfu' AS tag, CAST(kungfu AS VARCHAR) AS id, '"' || CAST(kungfu AS VARCHAR) || 'name"' AS content
FROM match_roles WHERE match_id IN (SELECT match_id FROM matches)
UNION ALL
SELECT DISTINCT 'equip' AS tag, '100' || CAST(kungfu % 7 AS VARCHAR) AS id,
  '{{"ui_id":"100' || CAST(kungfu % 7 AS VARCHAR) || '","name":"armor' || CAST(kungfu % 7 AS VARCHAR) ||
  '","icon":"a' || CAST(kungfu % 7 AS VARCHAR) || '.png","quality":3}}' AS content
FROM match_roles WHERE match_id IN (SELECT match_id FROM matches)
UNION ALL
SELECT DISTINCT 'talent' AS tag, CAST(kungfu % 11 AS VARCHAR) AS id,
  '{{"id":"' || CAST(kungfu % 11 AS VARCHAR) || '","name":"t' || CAST(kungfu % 11 AS VARCHAR) || '","icon":"t.png"}}' AS content
FROM match_roles WHERE match_id IN (SELECT match_id FROM matches)""")
def q_collect_dictionary(spark, sf):
    return J.collect_dictionary(detail_payloads(Domain(spark, sf)), CDN)


def dictionary_payloads(d: Domain):
    """One payload per participant in which names and entries change from match
    to match, with a field that no schema names, and ids and numbers that
    arrive as numbers or as text."""
    odd = F.col("match_id") % 2 == 1
    k7 = F.col("kungfu") % 7
    armor = lambda ui, quality: F.struct(
        ui.alias("ui_id"), F.concat(F.lit("armor"), F.col("match_id").cast("string")).alias("name"),
        F.concat(F.lit(CDN + "a"), k7.cast("string"), F.lit(".png?v=2")).alias("icon"), quality.alias("quality"),
        F.struct((F.col("match_id") % 3).alias("no")).alias("set"), F.lit(2).alias("strength_level"), F.col("seat").alias("pos"))
    player = lambda a: F.to_json(F.struct(F.struct(F.array(F.struct(
        F.col("kungfu").alias("kungfu_id"), F.concat(F.lit("name"), F.col("match_id").cast("string")).alias("kungfu"),
        F.array(a).alias("armors"))).alias("players_info")).alias("team1")))
    text = player(armor(F.concat(F.lit("100"), k7.cast("string")), F.lit("3")))
    number = player(armor((F.lit(1000) + k7), F.lit(3)))
    return d.match_roles.select("match_id", "role_id", F.when(odd, text).otherwise(number).alias("payload"))


@query("dictionary_by_arrival", """
SELECT 'kungfu' AS tag, CAST(kungfu AS VARCHAR) AS id, '"name' || CAST(max(match_id) AS VARCHAR) || '"' AS content
FROM match_roles GROUP BY kungfu
UNION ALL
SELECT 'equip' AS tag, '100' || CAST(k AS VARCHAR) AS id, '{"icon":"a' || CAST(k AS VARCHAR) || '.png","name":"armor' || CAST(m AS VARCHAR) ||
  '","quality":3,"set":{"no":' || CAST(m % 3 AS VARCHAR) || '},"ui_id":"100' || CAST(k AS VARCHAR) || '"}' AS content
FROM (SELECT kungfu % 7 AS k, min(match_id) AS m FROM match_roles GROUP BY kungfu % 7)""")
def q_dictionary_by_arrival(spark, sf):
    d = Domain(spark, sf)
    p = dictionary_payloads(d)
    e = J.dictionary_entries(p, CDN, ["match_id", "role_id"])
    empty = spark.createDataFrame([], "tag string, id string, content string")
    return J.push_entries(empty, e)


@query("name_list_versions", """
SELECT 'attr_names' AS tag, 'hp' AS value, CAST(0 AS BIGINT) AS id, true AS is_new
UNION ALL SELECT 'metric_names' AS tag, 'dps%|hps' AS value, CAST(0 AS BIGINT) AS id, true AS is_new
FROM (SELECT 1 FROM matches LIMIT 1)""")
def q_name_list_versions(spark, sf):
    _m, roles = J.flatten_match_detail(detail_payloads(Domain(spark, sf)))
    lists = J.name_lists(roles)
    known = lists.where(F.lit(False)).select("tag", "value", F.lit(0).cast("long").alias("id"))
    return dictionary_versions(known, lists, "match_id")


@query("landed_history", """
SELECT mr.match_id, mr.match_type, mr.role_id AS global_id, m.grade AS avg_grade, m.start_time,
       m.start_time + m.duration AS end_time, mr.seat = 0 AS mvp, mr.team = m.winner AS won, mr.score2 % 50 AS score_diff,
       1500 + mr.score2 % 1000 AS score, mr.kungfu, 'z' AS zone, 's' AS server
FROM match_roles mr JOIN matches m ON m.match_id = mr.match_id""")
def q_landed_history(spark, sf):
    """J7 end to end: history pages landed as JSON-lines files partitioned by
    match type, read back as text and flattened."""
    from skirmish.session import scratch_path

    path = scratch_path(spark, "landed-history")
    J.write_payloads(history_payloads(Domain(spark, sf)).select("match_type", "payload"), path, ["match_type"])
    return J.flatten_role_history(J.read_payloads(spark, path))


@query("ingest_match_details", f"SELECT {MATCH_COLS_SQL} FROM matches")
def q_ingest_match_details(spark, sf):
    """§3.3 end to end: landed match details → flattened (J9) → inserted into
    the stored matches when absent (I2); the stored part is the first half
    of the month, the landed part re-delivers every match."""
    from skirmish.functions.scalars import epoch_seconds
    from skirmish.operators import maintain as M
    from skirmish.plans.q_ordered import HALF_MONTH

    d = Domain(spark, sf)
    new, roles = J.flatten_match_detail(detail_payloads(d))
    players = roles.select("match_id", F.struct(F.col("global_id").alias("role_id"), "team", "kungfu", "score2").alias("p"))
    new = new.join(players.groupBy("match_id").agg(F.collect_list("p").alias("roles")), "match_id")
    old = d.matches.where(F.col("start_time") < epoch_seconds(F.lit(HALF_MONTH)))
    old_mr = d.match_roles.join(old.select("match_id"), "match_id", "left_semi")
    m2, _mr2, _s2 = M.insert_matches(old, old_mr, d.scores, new.select(*d.matches.columns, "roles"))
    return flat_matches(m2)
