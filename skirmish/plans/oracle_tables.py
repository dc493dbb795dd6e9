"""Domain tables in DuckDB SQL, the oracle's twin of ``sources.fixtures``.

Each name below is a CTE over the driver's pre-registered views. The
expressions mirror the Spark derivations one for one (integer division is
``//`` here and ``div`` in Spark) so that both engines see the same rows.
"""

from __future__ import annotations

from skirmish.sources.dimension import dimension_values_sql

CTES: dict[str, str] = {}

CTES["ev"] = """
SELECT event_id,
       event_id // 4 AS match_id,
       CAST(event_id % 4 AS INTEGER) AS seat,
       CAST((user_id % 3) * 4 + (event_id % 4 + event_id // 4) % 4 AS VARCHAR) AS role_id,
       CASE event_type WHEN 'signup' THEN 10014 WHEN 'click' THEN 10021
            WHEN 'view' THEN 10080 WHEN 'error' THEN 10145 ELSE 10224 END AS kungfu,
       CAST(round(value * 100) AS INTEGER) AS score2,
       ts AS inserted_at,
       user_id,
       event_type
FROM events
"""

CTES["match_roles"] = """
SELECT match_id, role_id, seat, CASE WHEN seat < 2 THEN 1 ELSE 2 END AS team,
       kungfu, score2, inserted_at,
       CASE WHEN match_id % 10 = 0 THEN '2c' ELSE '3c' END AS match_type
FROM ev
"""

CTES["matches"] = """
SELECT match_id,
       CASE WHEN match_id % 10 = 0 THEN '2c' ELSE '3c' END AS match_type,
       CAST(epoch_us(min(inserted_at)) // 1000000 AS BIGINT) AS start_time,
       CAST(epoch_us(max(inserted_at)) // 1000000 - epoch_us(min(inserted_at)) // 1000000 AS INTEGER) AS duration,
       CASE WHEN match_id % 10 = 0 THEN 2 ELSE 3 END AS pvp_type,
       CAST(match_id % 7 AS INTEGER) AS map,
       CASE WHEN match_id % 17 = 0 THEN NULL WHEN match_id % 19 = 0 THEN 0
            ELSE CAST(match_id % 13 + 1 AS INTEGER) END AS grade,
       CAST(sum(score2) FILTER (WHERE seat < 2) AS INTEGER) AS team1_score,
       CAST(sum(score2) FILTER (WHERE seat >= 2) AS INTEGER) AS team2_score,
       CASE WHEN sum(score2) FILTER (WHERE seat < 2) > sum(score2) FILTER (WHERE seat >= 2)
            THEN 1 ELSE 2 END AS winner,
       list_sort(list(kungfu) FILTER (WHERE seat < 2)) AS team1_kungfu,
       list_sort(list(kungfu) FILTER (WHERE seat >= 2)) AS team2_kungfu,
       list(role_id ORDER BY seat) AS role_ids
FROM ev
GROUP BY match_id
HAVING count(*) = 4
"""

CTES["roles"] = """
SELECT c.c_custkey AS role_id,
       CAST(c.c_custkey AS VARCHAR) AS global_id,
       CASE WHEN c.c_custkey % 4 = 0 THEN NULL ELSE 'pp' || CAST(c.c_custkey % 101 AS VARCHAR) END AS passport_id,
       c.c_name AS name,
       c.c_mktsegment AS force,
       CASE c.c_custkey % 3 WHEN 0 THEN 'little' WHEN 1 THEN 'man' ELSE 'woman' END AS body_type,
       r.r_name AS zone,
       n.n_name AS server,
       CAST(c.c_nationkey AS VARCHAR) AS person_id,
       TIMESTAMP '2024-02-01 00:00:00' AS updated_at
FROM customer c
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
"""

CTES["persons"] = """
SELECT CAST(n_nationkey AS VARCHAR) AS person_id, n_name AS name FROM nation
"""

CTES["scores"] = """
SELECT CAST(o_custkey AS VARCHAR) AS role_id,
       '3c' AS match_type,
       CASE WHEN o_custkey % 11 = 0 THEN NULL
            ELSE CAST(1000 + sum(CAST(round(o_totalprice * 100) AS BIGINT)) // (count(*) * 20000) AS INTEGER)
       END AS score,
       count(*) AS total_count,
       count(*) FILTER (WHERE o_orderstatus = 'F') AS win_count,
       count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS mvp_count,
       CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE CAST(count(*) // 2 AS INTEGER) END AS fetched_to,
       CASE WHEN o_custkey % 13 = 0 THEN NULL
            ELSE CAST(count(*) FILTER (WHERE o_orderstatus = 'P') AS INTEGER) END AS fetched_count,
       CASE WHEN o_custkey % 2 = 0 THEN NULL ELSE CAST(o_custkey % 97 AS INTEGER) END AS ranking,
       CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE max(o_orderdate) END AS fetched_at
FROM orders
GROUP BY o_custkey
"""

CTES["role_kungfus"] = """
SELECT CAST(o.o_custkey AS VARCHAR) AS role_id,
       '3c' AS match_type,
       lower(p.p_type) AS kungfu,
       count(DISTINCT o.o_orderkey) AS total_count,
       count(DISTINCT o.o_orderkey) FILTER (WHERE o.o_orderstatus = 'F') AS win_count
FROM orders o
JOIN lineitem l ON l.l_orderkey = o.o_orderkey
JOIN part p ON p.p_partkey = l.l_partkey
GROUP BY o.o_custkey, lower(p.p_type)
"""

CTES["items"] = """
SELECT 'kungfu' AS tag, CAST(10000 + dense_rank() OVER (ORDER BY p_type) AS VARCHAR) AS id,
       '"' || lower(p_type) || '"' AS content
FROM (SELECT DISTINCT p_type FROM part)
UNION ALL
SELECT 'kungfu' AS tag, CAST(kungfu AS VARCHAR) AS id,
       '"' || CASE min(event_type) WHEN 'signup' THEN 'jingyu' WHEN 'click' THEN 'tianluo' WHEN 'view' THEN 'mowen'
                  WHEN 'error' THEN 'taixu' ELSE min(event_type) END || '"' AS content
FROM ev GROUP BY kungfu
UNION ALL
SELECT 'brand' AS tag, CAST(dense_rank() OVER (ORDER BY p_brand) AS VARCHAR) AS id,
       '"' || p_brand || '"' AS content
FROM (SELECT DISTINCT p_brand FROM part)
"""

CTES["role_updates"] = """
SELECT event_id, CAST(user_id AS VARCHAR) AS global_id,
       CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_type END AS passport_id,
       ts AS inserted_at
FROM events
"""

CTES["seen_days"] = """
SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events
"""

CTES["teams"] = """
WITH guarded AS (
  SELECT *, len(team1_kungfu) AS team1_size, len(team2_kungfu) AS team2_size
  FROM matches
  WHERE len(role_ids) = len(team1_kungfu) + len(team2_kungfu)
), sides AS (
  SELECT match_id, grade, match_type, pvp_type, make_timestamp(start_time * 1000000) AS start_time,
         team1_kungfu AS kungfus, role_ids[1:team1_size] AS role_ids, winner = 1 AS won,
         role_ids[team1_size + 1:team1_size + team2_size] AS anta_role_ids, team2_kungfu AS anta_kungfus
  FROM guarded
  UNION ALL
  SELECT match_id, grade, match_type, pvp_type, make_timestamp(start_time * 1000000) AS start_time,
         team2_kungfu AS kungfus, role_ids[team1_size + 1:team1_size + team2_size] AS role_ids, winner = 2 AS won,
         role_ids[1:team1_size] AS anta_role_ids, team1_kungfu AS anta_kungfus
  FROM guarded
)
SELECT *, CAST(start_time AS DATE) AS start_date FROM sides
"""

CTES["day_team_map"] = """
SELECT start_date, list_sort(role_ids) AS role_ids, count(*) AS count, count(*) > 3 AS in_team
FROM teams GROUP BY start_date, list_sort(role_ids)
"""

# The class dimension comes from the same fixed values as the Spark side.
CTES["class_dim"] = dimension_values_sql()

CTES["kungfu_items"] = """
SELECT CAST(i.id AS INTEGER) AS id, trim(i.content, '"') AS content, d.kungfu, d.short, d.rank
FROM items i LEFT JOIN class_dim d ON trim(i.content, '"') = d.content
WHERE i.tag = 'kungfu'
"""

_ORDER = ["ev", "match_roles", "matches", "roles", "persons", "scores", "role_kungfus",
          "items", "role_updates", "seen_days", "teams", "day_team_map", "class_dim", "kungfu_items"]


def with_domain(sql: str) -> str:
    """Prefix ``sql`` with every domain CTE it names (and their inputs)."""
    import re

    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in _ORDER:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(CTES[name])

    visit(sql)
    parts = [f"{n} AS ({CTES[n].strip()})" for n in _ORDER if n in needed]
    if not parts:
        return sql
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body
