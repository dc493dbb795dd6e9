"""Queries for I1–I14 (upserts, inserts, routing, dictionary, repairs).

Each query builds the target and an update batch from the driver tables
(old/new split by time where a "before" state is needed) and returns the
maintained table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from skirmish.functions.scalars import epoch_seconds
from skirmish.operators import buckets as K
from skirmish.operators import joins as C
from skirmish.operators import maintain as M
from skirmish.operators import ordered as E
from skirmish.plans.catalog import query
from skirmish.plans.q_ordered import HALF_MONTH, ISLANDS_SQL
from skirmish.plans.q_reports import MATCH_COLS_SQL, flat_matches
from skirmish.session import scratch_path
from skirmish.sources.fixtures import Domain

HALF_EPOCH = f"epoch(TIMESTAMP '{HALF_MONTH}')"


def score_updates(d: Domain):
    o = d.raw("orders")
    k = F.col("o_orderkey")
    return o.select(
        F.col("o_custkey").cast("string").alias("role_id"), F.lit("3c").alias("match_type"),
        F.when(k % 3 == 0, F.lit(None).cast("int")).otherwise((F.lit(1500) + k % 1000).cast("int")).alias("score"),
        F.when(k % 5 == 0, (k % 50).cast("int")).alias("ranking"),
        k.alias("seq"))


UPDATES_SQL = """
SELECT CAST(o_custkey AS VARCHAR) AS role_id, '3c' AS match_type,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(1500 + o_orderkey % 1000 AS INTEGER) END AS score,
       CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderkey % 50 AS INTEGER) END AS ranking, o_orderkey AS seq
FROM orders"""

UPSERT_SQL = f"""
SELECT coalesce(t.role_id, c.role_id) AS role_id, coalesce(t.match_type, c.match_type) AS match_type,
       coalesce(c.score, t.score) AS score, t.total_count, t.win_count, t.mvp_count, t.fetched_to, t.fetched_count,
       coalesce(c.ranking, t.ranking) AS ranking, t.fetched_at
FROM scores t FULL OUTER JOIN (
  SELECT role_id, match_type, arg_max(score, seq) FILTER (WHERE score IS NOT NULL) AS score,
         arg_max(ranking, seq) FILTER (WHERE ranking IS NOT NULL) AS ranking
  FROM ({UPDATES_SQL}) GROUP BY role_id, match_type) c
ON t.role_id = c.role_id AND t.match_type = c.match_type"""


@query("upsert", UPSERT_SQL)
def q_upsert(spark, sf):
    d = Domain(spark, sf)
    return M.upsert(d.scores, score_updates(d), ["role_id", "match_type"], order="seq")


@query("bucketed_upsert", UPSERT_SQL)
def q_bucketed_upsert(spark, sf):
    """The upsert on a stored target of 16 buckets, as two batches of roles."""
    d = Domain(spark, sf)
    table = K.Bucketed(scratch_path(spark, "scores"), ("role_id", "match_type"), 16)
    table.write(d.scores)
    u = score_updates(d)
    for part in (0, 1):
        K.upsert_stored(table, u.where(F.col("role_id").cast("long") % 2 == part), order="seq")
    return table.read(spark)


@query("save_performance", UPSERT_SQL.replace("FROM ({UPDATES_SQL})".format(UPDATES_SQL=UPDATES_SQL),
                                              "FROM ({UPDATES_SQL}) WHERE score IS NOT NULL".format(UPDATES_SQL=UPDATES_SQL)))
def q_save_performance(spark, sf):
    d = Domain(spark, sf)
    scores, _log = M.save_performance(d.scores, score_updates(d), order="seq")
    return scores


@query("guard_fetched_count", """
SELECT role_id, greatest(fetched_count, CAST(total_count % 4 AS INTEGER)) AS fetched_count FROM scores""")
def q_guard_fetched_count(spark, sf):
    s = Domain(spark, sf).scores
    return s.select("role_id", M.guard_fetched_count((F.col("total_count") % 4).cast("int"), F.col("fetched_count"))
                    .alias("fetched_count"))


def _split_matches(d: Domain):
    cut = epoch_seconds(F.lit(HALF_MONTH))
    old = d.matches.where(F.col("start_time") < cut)
    mr = d.match_roles.drop("match_type")
    new = C.nest(d.matches, mr, "match_id", "roles", how="inner")
    old_mr = d.match_roles.join(old.select("match_id"), "match_id", "left_semi")
    return old, old_mr, new


@query("insert_matches", f"SELECT {MATCH_COLS_SQL} FROM matches")
def q_insert_matches(spark, sf):
    d = Domain(spark, sf)
    old, old_mr, new = _split_matches(d)
    m2, _mr2, _s2 = M.insert_matches(old, old_mr, d.scores, new)
    return flat_matches(m2)


@query("insert_matches_roles", """
SELECT match_id, role_id, seat, team, kungfu, score2, inserted_at, match_type
FROM match_roles WHERE match_id IN (SELECT match_id FROM matches)""")
def q_insert_matches_roles(spark, sf):
    d = Domain(spark, sf)
    old, old_mr, new = _split_matches(d)
    _m2, mr2, _s2 = M.insert_matches(old, old_mr, d.scores, new)
    return mr2


@query("insert_matches_scores", f"""
WITH n AS (SELECT mr.role_id, mr.match_type, count(*) AS n FROM match_roles mr
           JOIN matches m ON m.match_id = mr.match_id WHERE m.start_time >= {HALF_EPOCH} GROUP BY mr.role_id, mr.match_type)
SELECT s.role_id, s.match_type, CAST(CASE WHEN n.n IS NULL THEN s.fetched_count ELSE s.fetched_count + n.n END AS INTEGER)
  AS fetched_count
FROM scores s LEFT JOIN n ON n.role_id = s.role_id AND n.match_type = s.match_type""")
def q_insert_matches_scores(spark, sf):
    d = Domain(spark, sf)
    old, old_mr, new = _split_matches(d)
    _m2, _mr2, s2 = M.insert_matches(old, old_mr, d.scores, new)
    return s2.select("role_id", "match_type", "fetched_count")


@query("insert_match_logs", """
SELECT conv_id AS match_id, max(turn) AS match_duration FROM conversations GROUP BY conv_id""")
def q_insert_match_logs(spark, sf):
    logs = Domain(spark, sf).match_logs
    dur = F.get_json_object("replay", "$.match_duration").cast("long")
    old = logs.where(dur < 4)
    return M.insert_match_logs(old, logs).select("match_id", dur.alias("match_duration"))


@query("insert_role_logs", f"""
SELECT CAST(user_id AS VARCHAR) AS global_id, user_id AS role_id, '' AS name, '' AS zone, '' AS server,
       string_agg(CAST(lower AS VARCHAR) || '/' || CAST(upper AS VARCHAR), ';' ORDER BY lower) AS seen
FROM ({ISLANDS_SQL}) GROUP BY user_id""")
def q_insert_role_logs(spark, sf):
    d = Domain(spark, sf)
    keyed = d.seen_days.select(F.col("user_id").cast("string").alias("global_id"), F.col("user_id").alias("role_id"),
                               F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("zone"),
                               F.lit(None).cast("string").alias("server"), "day")
    half = F.lit(HALF_MONTH).cast("date")
    empty = keyed.where(F.lit(False)).select(*M.KEY_DEFAULTS, F.array().cast("array<" + _range_t() + ">").alias("seen"))
    target = M.insert_role_logs(empty, keyed.where(F.col("day") < half))
    out = M.insert_role_logs(target, keyed.where(F.col("day") >= half))
    return out.select(*M.KEY_DEFAULTS, F.array_join(F.transform(
        "seen", lambda r: F.concat(r["lower"].cast("string"), F.lit("/"), r["upper"].cast("string"))), ";").alias("seen"))


@query("bucketed_role_logs", f"""
SELECT CAST(user_id AS VARCHAR) AS global_id, user_id AS role_id, '' AS name, '' AS zone, '' AS server,
       string_agg(CAST(lower AS VARCHAR) || '/' || CAST(upper AS VARCHAR), ';' ORDER BY lower) AS seen
FROM ({ISLANDS_SQL}) GROUP BY user_id""")
def q_bucketed_role_logs(spark, sf):
    """The two halves of the month inserted into stored role logs of 16 buckets."""
    d = Domain(spark, sf)
    keyed = d.seen_days.select(F.col("user_id").cast("string").alias("global_id"), F.col("user_id").alias("role_id"),
                               *[F.lit(None).cast("string").alias(c) for c in ("name", "zone", "server")], "day")
    half = F.lit(HALF_MONTH).cast("date")
    empty = keyed.where(F.lit(False)).select(*M.KEY_DEFAULTS, F.array().cast("array<" + _range_t() + ">").alias("seen"))
    table = K.Bucketed(scratch_path(spark, "role-logs"), tuple(M.KEY_DEFAULTS), 16)
    table.write(M.insert_role_logs(empty, keyed.where(F.col("day") < half)))
    K.insert_role_logs_stored(table, keyed.where(F.col("day") >= half))
    return table.read(spark).select(*M.KEY_DEFAULTS, F.array_join(F.transform(
        "seen", lambda r: F.concat(r["lower"].cast("string"), F.lit("/"), r["upper"].cast("string"))), ";").alias("seen"))


def _range_t():
    from skirmish.functions.ranges import RANGE_TYPE

    return RANGE_TYPE


def _leveled(d: Domain):
    k = F.col("role_id")
    return d.roles.withColumn("level", F.when(k % 3 == 0, (k % 100).cast("int")).otherwise(F.lit(100)))


@query("route_roles", """
SELECT global_id, CASE WHEN role_id % 3 = 0 AND role_id % 100 <> 100 THEN 'lamb_roles' ELSE 'roles' END AS dest
FROM roles""")
def q_route_roles(spark, sf):
    full, lamb = M.route_roles(_leveled(Domain(spark, sf)))
    return full.select("global_id", F.lit("roles").alias("dest")).unionByName(
        lamb.select("global_id", F.lit("lamb_roles").alias("dest")))


@query("retire_lamb_roles", """
SELECT global_id FROM roles WHERE role_id % 3 = 0 AND global_id NOT IN (SELECT DISTINCT role_id FROM match_roles)""")
def q_retire_lamb_roles(spark, sf):
    d = Domain(spark, sf)
    _full, lamb = M.route_roles(_leveled(d))
    seen = d.match_roles.select(F.col("role_id").alias("global_id")).distinct()
    return M.retire_lamb_roles(lamb, seen).select("global_id")


def _entries(d: Domain):
    part = d.raw("part")
    from pyspark.sql import Window

    types = part.select("p_type").distinct()
    kung = types.select(F.lit("kungfu").alias("tag"),
                        (F.lit(10000) + F.dense_rank().over(Window.orderBy("p_type"))).cast("string").alias("id"),
                        F.concat(F.lit('"'), F.upper("p_type"), F.lit('"')).alias("content"))
    sizes = part.select(F.lit("size").alias("tag"), F.col("p_size").cast("string").alias("id"),
                        F.concat(F.lit('"'), F.col("p_size").cast("string"), F.lit('"')).alias("content")).distinct()
    brands = d.items.where(F.col("tag") == "brand")
    return kung.unionByName(sizes).unionByName(brands)


ENTRIES_SQL = """
SELECT 'kungfu' AS tag, CAST(10000 + dense_rank() OVER (ORDER BY p_type) AS VARCHAR) AS id, '"' || upper(p_type) || '"' AS content
FROM (SELECT DISTINCT p_type FROM part)
UNION ALL SELECT DISTINCT 'size' AS tag, CAST(p_size AS VARCHAR) AS id, '"' || CAST(p_size AS VARCHAR) || '"' AS content FROM part
UNION ALL SELECT tag, id, content FROM items WHERE tag = 'brand'"""


@query("dictionary_push_insert_only", f"""
SELECT * FROM items UNION ALL
SELECT e.* FROM ({ENTRIES_SQL}) e WHERE NOT EXISTS (SELECT 1 FROM items i WHERE i.tag = e.tag AND i.id = e.id)""")
def q_dict_insert_only(spark, sf):
    d = Domain(spark, sf)
    return M.dictionary_push(d.items, _entries(d), "insert_only")


@query("dictionary_push_overwrite", f"""
SELECT i.* FROM items i WHERE NOT EXISTS (SELECT 1 FROM ({ENTRIES_SQL}) e WHERE i.tag = e.tag AND i.id = e.id)
UNION ALL SELECT * FROM ({ENTRIES_SQL})""")
def q_dict_overwrite(spark, sf):
    d = Domain(spark, sf)
    return M.dictionary_push(d.items, _entries(d), "overwrite")


@query("dictionary_push_force", f"""
SELECT i.* FROM items i WHERE NOT EXISTS (SELECT 1 FROM ({ENTRIES_SQL}) e WHERE i.tag = e.tag AND i.id = e.id)
UNION ALL SELECT * FROM ({ENTRIES_SQL})""")
def q_dict_force(spark, sf):
    d = Domain(spark, sf)
    return M.dictionary_push(d.items, _entries(d), "force")


@query("dictionary_find", """SELECT tag, id, content FROM items WHERE tag = 'kungfu' AND content = '"economy"'""")
def q_dictionary_find(spark, sf):
    return M.dictionary_find(Domain(spark, sf).items, "kungfu", content='"economy"')


@query("dictionary_find_key", """SELECT tag, id, content FROM items WHERE tag = 'kungfu' AND id = '10021'""")
def q_dictionary_find_key(spark, sf):
    return M.dictionary_find(Domain(spark, sf).items, "kungfu", key="10021")


@query("passport_backfill", "SELECT global_id, passport_id, updated_at AS inserted_at FROM roles WHERE passport_id IS NOT NULL")
def q_passport_backfill(spark, sf):
    return M.passport_backfill(Domain(spark, sf).roles)


@query("repair_matches", f"""
WITH p AS (SELECT match_id, list(role_id ORDER BY inserted_at, role_id) AS ids,
                  list(kungfu ORDER BY inserted_at, role_id) AS ks, list(score2 ORDER BY inserted_at, role_id) AS ss
           FROM match_roles GROUP BY match_id),
inf AS (SELECT m.match_id, p.ids,
  CASE WHEN len(p.ids) <> len(m.team1_kungfu) + len(m.team2_kungfu) THEN 'size_mismatch'
       WHEN list_sort(p.ks[1:len(m.team1_kungfu)]) <> m.team1_kungfu
         OR list_sort(p.ks[len(m.team1_kungfu) + 1:len(m.team1_kungfu) + len(m.team2_kungfu)]) <> m.team2_kungfu
         THEN 'kungfu_mismatch'
       WHEN list_sum(p.ss[1:len(m.team1_kungfu)]) <> m.team1_score
         OR list_sum(p.ss[len(m.team1_kungfu) + 1:len(m.team1_kungfu) + len(m.team2_kungfu)]) <> m.team2_score
         THEN 'score_mismatch'
       ELSE 'fixed' END AS status
  FROM matches m JOIN p ON p.match_id = m.match_id)
SELECT {MATCH_COLS_SQL.replace("array_to_string(role_ids, ',') AS role_ids",
                               "array_to_string(CASE WHEN inf.status = 'fixed' THEN inf.ids ELSE matches.role_ids END, ',') AS role_ids")}
FROM matches LEFT JOIN inf USING (match_id)""")
def q_repair_matches(spark, sf):
    d = Domain(spark, sf)
    return flat_matches(M.repair_matches(d.matches, E.infer_teams(d.match_roles, d.matches)))


@query("role_seen_from_match", """
SELECT mr.role_id AS global_id, r.role_id, r.name, r.zone, r.server, CAST(make_timestamp(m.start_time * 1000000) AS DATE) AS day
FROM match_roles mr JOIN matches m ON m.match_id = mr.match_id LEFT JOIN roles r ON r.global_id = mr.role_id""")
def q_role_seen_from_match(spark, sf):
    d = Domain(spark, sf)
    return M.role_seen_from_match(d.match_roles, d.matches, d.roles)


@query("attach_person", """
SELECT r.global_id, r.name, p.person_id FROM roles r LEFT JOIN (
  SELECT CAST(c_custkey AS VARCHAR) AS global_id, CAST(c_nationkey AS VARCHAR) AS person_id FROM customer
  WHERE c_acctbal > 0) p ON p.global_id = r.global_id""")
def q_attach_person(spark, sf):
    d = Domain(spark, sf)
    payload = d.raw("customer").where(F.col("c_acctbal") > 0).select(
        F.col("c_custkey").cast("string").alias("global_id"), F.col("c_nationkey").cast("string").alias("person_id"))
    return M.attach_person(d.roles.select("global_id", "name"), payload)



@query("dictionary_find_ids", """
SELECT rk.role_id, rk.kungfu, rk.total_count, i.id
FROM role_kungfus rk LEFT JOIN items i ON i.tag = 'kungfu' AND i.content = '"' || rk.kungfu || '"'""")
def q_dictionary_find_ids(spark, sf):
    """I9, set form: class names of role_kungfus → dictionary ids (a join)."""
    d = Domain(spark, sf)
    rk = d.role_kungfus.select("role_id", "kungfu", "total_count",
                               F.concat(F.lit('"'), F.col("kungfu"), F.lit('"')).alias("content"))
    return M.find_ids(rk, "content", d.items, "kungfu").drop("content")
