"""Replay logs — JSON text parsed by an explicit schema.

Parsing is ``from_json`` (JVM-side, per row, no Python); the reference's
only user function (first skill of a replay) is the built-in
``try_element_at``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql import types as T

from skirmish.operators.maintain import match_keys

REPLAY_ITEM = T.StructType([
    T.StructField("ts", T.LongType()),
    T.StructField("skillId", T.LongType()),
    T.StructField("casterId", T.StringType()),
    T.StructField("targetId", T.StringType()),
    T.StructField("skillName", T.StringType()),
])
REPLAY_PLAYER = T.StructType([
    T.StructField("team", T.StringType()),
    T.StructField("role_id", T.StringType()),
    T.StructField("role_name", T.StringType()),
    T.StructField("kungfu_name", T.StringType()),
    T.StructField("treat_trend", T.ArrayType(T.LongType())),
    T.StructField("attack_trend", T.ArrayType(T.LongType())),
    T.StructField("global_role_id", T.StringType()),
])
REPLAY_SCHEMA = T.StructType([
    T.StructField("replay", T.ArrayType(REPLAY_ITEM)),
    T.StructField("players", T.ArrayType(REPLAY_PLAYER)),
    T.StructField("match_id", T.LongType()),
    T.StructField("match_duration", T.LongType()),
])


def parse_replay(match_logs: DataFrame, col: str = "replay") -> DataFrame:
    """A5: replay text → typed columns (replay, players, match_duration).

    Blank and NULL texts are dropped first (Q10); a malformed text gives a
    row whose parsed fields are NULL (PERMISSIVE), as the reference's JSON
    reader does. The log's own match_id (and match_type) is kept as the key."""
    x = match_logs.where(F.col(col).isNotNull() & (F.trim(F.col(col)) != ""))
    parsed = F.from_json(F.col(col), REPLAY_SCHEMA, {"mode": "PERMISSIVE"})
    keys = match_keys(match_logs)
    return x.select(*keys, parsed.alias("_r")).select(*keys, "_r.replay", "_r.players", "_r.match_duration")


def first_skill(replay: Column | str = "replay") -> Column:
    """K1: skill name of the first replay entry; NULL for an empty or NULL
    replay (the reference indexes position 0 unguarded)."""
    r = F.col(replay) if isinstance(replay, str) else replay
    return F.try_element_at(r, F.lit(1))["skillName"]


def replay_with_match(replays: DataFrame, matches: DataFrame) -> DataFrame:
    """Parsed replays ⟕ matches, size guard, seat split. Keeps
    the match's key, replay, players, team1_ids, team2_ids, match_duration."""
    keys = match_keys(replays, matches)
    m = matches.select(*keys, "role_ids", "team1_kungfu", "team2_kungfu")
    x = replays.join(m, keys, "left")
    n1, n2 = F.size("team1_kungfu"), F.size("team2_kungfu")
    x = x.where(F.size("role_ids") == n1 + n2)
    return x.select(*keys, "replay", "players",
                    F.slice("role_ids", F.lit(1), n1).alias("team1_ids"),
                    F.slice("role_ids", n1 + 1, n2).alias("team2_ids"),
                    "match_duration")
