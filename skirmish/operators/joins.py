"""C: joins. All are equi joins; the planner picks the strategy.

Dimension-sized sides (the class dimension, the day-team map of one
match) are left to AQE, which converts a shuffle join into a broadcast
only when the runtime size is under the threshold; fact-sized sides
always shuffle on the key. Anti/semi joins replace EXCEPT/IN.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skirmish.functions.scalars import win_rate, zone_suffix_sql
from skirmish.operators.filters import page
from skirmish.operators.maintain import match_keys


def scores_with_kungfus(scores: DataFrame, role_kungfus: DataFrame) -> DataFrame:
    """Scores ⋈ role_kungfus USING (role_id, match_type); the class
    table's total_count becomes kungfu_count."""
    rk = role_kungfus.withColumnRenamed("total_count", "kungfu_count").withColumnRenamed("win_count", "kungfu_win_count")
    return scores.join(rk, ["role_id", "match_type"], "inner")


def roles_with_scores(roles: DataFrame, scores: DataFrame, match_type: str = "3c",
                      offset: int = 0, limit: int | None = None) -> DataFrame:
    """Roles ⟕ scores, kept when the score is of ``match_type`` or
    absent; score DESC NULLS LAST (role id breaks ties); paged (Q3: the
    limit is applied)."""
    s = scores.select(F.col("role_id").alias("global_id"), "match_type", "score", "total_count", "win_count")
    x = roles.join(s, "global_id", "left").where((F.col("match_type") == match_type) | F.col("match_type").isNull())
    x = x.orderBy(F.col("score").desc_nulls_last(), F.col("global_id"))
    return page(x, limit, offset)


def top_roles(roles: DataFrame, scores: DataFrame, limit: int = 200, match_type: str = "3c",
              keep_null_scores: bool = False) -> DataFrame:
    """C7 + E1: the best roles of a match type: win_rate, score, role_id,
    ranking (the score row's own ranking), name, force, and position (the
    1-based place in the list, E1).

    Default drops NULL scores; ``keep_null_scores=True`` keeps them first, as
    PostgreSQL's DESC does (Q4). The sort is a distributed top-k
    (TakeOrderedAndProject); the rank is numbered on the ≤ limit rows only.
    """
    s = scores.where(F.col("match_type") == match_type)
    if not keep_null_scores:
        s = s.where(F.col("score").isNotNull())
    s = s.select(F.col("role_id"), "score", "ranking", win_rate("win_count", "total_count").alias("win_rate"))
    r = roles.select(F.col("global_id").alias("role_id"), "name", "force")
    order = [F.col("score").desc_nulls_first(), F.col("role_id")]
    top = s.join(r, "role_id", "inner").orderBy(*order).limit(limit)
    return with_rank(top, order, "position")


def with_rank(df: DataFrame, order: list, col: str = "position") -> DataFrame:
    """1-based position in a sorted, already small (top-k) frame."""
    return df.withColumn(col, F.row_number().over(Window.orderBy(*order)))


def unknown_roles(roles: DataFrame, scores: DataFrame) -> DataFrame:
    """Roles without any score row (anti join)."""
    return roles.join(scores.select(F.col("role_id").alias("global_id")), "global_id", "left_anti")


def roles_needing_scores(roles: DataFrame, scores: DataFrame, match_roles: DataFrame,
                         offset: int = 0, limit: int | None = None, match_type: str | None = "3c") -> DataFrame:
    """Roles with no score that played a match (of ``match_type``, 3c by
    default); one row per role, ordered by id, paged."""
    mr = match_roles if match_type is None else match_roles.where(F.col("match_type") == match_type)
    played = mr.select(F.col("role_id").alias("global_id"))
    x = unknown_roles(roles, scores).join(played, "global_id", "left_semi").orderBy("global_id")
    return page(x, limit, offset)


def matches_of_role(matches: DataFrame, match_roles: DataFrame, role_id: str | None = None,
                    limit: int | None = 20, offset: int = 0) -> DataFrame:
    """Matches joined with their participant rows (optionally of one
    role), match_id DESC NULLS LAST, paged (default 20)."""
    keys = match_keys(matches, match_roles)
    mr = match_roles.select(*keys, "role_id", "kungfu", "score2", "team")
    if role_id is not None:
        mr = mr.where(F.col("role_id") == role_id)
    x = matches.join(mr, keys, "inner").orderBy(F.col("match_id").desc_nulls_last(), "role_id")
    return page(x, limit, offset)


def match_history(match_roles: DataFrame, matches: DataFrame, role_id: str | None = None) -> DataFrame:
    """C11: a role's participant rows ⟕ matches by start_time ascending,
    NULLs last (PostgreSQL's default, Spark's is the opposite)."""
    mr = match_roles if role_id is None else match_roles.where(F.col("role_id") == role_id)
    keys = match_keys(match_roles, matches)
    m = matches.select(*keys, "start_time", "grade", "winner")
    return mr.join(m, keys, "left").orderBy(F.col("start_time").asc_nulls_last(), "match_id", "role_id")


def role_recent_kungfus(roles: DataFrame, match_roles: DataFrame, matches: DataFrame, n: int = 100,
                        match_type: str | None = "3c") -> DataFrame:
    """C12 + E2: each role's newest ``n`` matches (of one match type, 3c by
    default) with the class played."""
    from skirmish.operators.ordered import last_n_per_key

    r = roles.select(F.col("global_id").alias("role_id"))
    mr = match_roles if match_type is None else match_roles.where(F.col("match_type") == match_type)
    keys = match_keys(match_roles, matches)
    mr = mr.select(*keys, "role_id", "kungfu")
    m = matches.select(*keys, "start_time")
    # The window shuffles by role after the match join on purpose: its partial
    # group limit then cuts a hot role to n rows per map task before that
    # shuffle (joining roles last would reuse the role partitioning but feed a
    # hot role whole into one window task).
    x = r.join(mr, "role_id", "inner").join(m, keys, "left").select("role_id", "match_id", "kungfu", "start_time")
    return last_n_per_key(x, "role_id", [F.col("start_time").desc_nulls_first(), F.col("match_id").desc()], n)


def roles_of_ungraded_matches(matches: DataFrame, match_roles: DataFrame) -> DataFrame:
    """Participants of matches without a grade, counted per role,
    most first."""
    from skirmish.operators.filters import missing_grade

    keys = match_keys(matches, match_roles)
    m = missing_grade(matches).select(*keys)
    return (m.join(match_roles.select(*keys, "role_id"), keys, "left")
            .groupBy("role_id").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), "role_id"))


def dedupe_last(df: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """Keep one row per key: the last by ``order`` (an aggregate, so a hot
    key is pre-reduced on the map side)."""
    if order is None:
        return df.dropDuplicates(keys)
    others = [c for c in df.columns if c not in keys]
    packed = F.max_by(F.struct(*others), F.col(order))
    return df.groupBy(*keys).agg(packed.alias("_r")).select(*keys, "_r.*")


def combine_with(l1: DataFrame, l2: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """C14: full outer merge by key; a field of l1 wins over l2 unless it
    is NULL (Q5). Repeated keys: the last row (by ``order``) of each side."""
    a, b = dedupe_last(l1, keys, order), dedupe_last(l2, keys, order)
    j = a.alias("l1").join(b.alias("l2"), keys, "full_outer")
    cols = list(dict.fromkeys([c for c in a.columns + b.columns if c not in keys]))
    out = []
    for c in cols:
        if c in a.columns and c in b.columns:
            out.append(F.coalesce(F.col(f"l1.{c}"), F.col(f"l2.{c}")).alias(c))
        elif c in a.columns:
            out.append(F.col(f"l1.{c}"))
        else:
            out.append(F.col(f"l2.{c}"))
    return j.select(*keys, *out)


def kungfu_stats_merge(metrics: DataFrame, skills: DataFrame, role_id: str | None = None,
                       match_type: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """C14 of class metrics and class skills; a metrics-only row with
    total_count = 0 is dropped (a NULL total is kept); role_id/match_type
    added when given."""
    keys = keys or ["kungfu"]
    # the marker rides along the one full outer join (no second join)
    x = combine_with(metrics, skills.withColumn("_has_skills", F.lit(True)), keys)
    # only a metrics-only row whose total_count is exactly 0 is dropped (NULL is kept)
    drop = F.col("_has_skills").isNull() & F.col("total_count").isNotNull() & (F.col("total_count") == 0)
    x = x.where(~drop).drop("_has_skills")
    if role_id is not None:
        x = x.withColumn("role_id", F.lit(role_id))
    if match_type is not None:
        x = x.withColumn("match_type", F.lit(match_type))
    return x


def nest(parent: DataFrame, child: DataFrame, key: str, name: str, child_key: str | None = None,
         how: str = "left") -> DataFrame:
    """One-to-many association as a sorted list of child structs.

    For associations bounded by the domain (a role's score lines — one per
    match type; a match's participants — one per seat). Unbounded ones use
    the flat join (see D13)."""
    ck = child_key or key
    fields = [c for c in child.columns if c != ck]
    g = child.groupBy(F.col(ck).alias(key)).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    return parent.join(g, key, how)


def score_match_roles(match_roles: DataFrame, role_id: str, match_type: str, limit: int = 20,
                      offset: int = 0, where=None) -> DataFrame:
    """C17: the participant rows of one score line (role, match type), with
    B11 paging (newest match first)."""
    from skirmish.operators.filters import paged

    x = match_roles.where((F.col("role_id") == role_id) & (F.col("match_type") == match_type))
    return paged(x, [F.col("match_id").desc()], where=where, limit=limit, offset=offset)


def grade_backfill(matches: DataFrame, history: DataFrame) -> DataFrame:
    """Grade NULL or 0 ← the history's avg_grade of the same match
    (both cases are filled, Q6)."""
    keys = match_keys(matches, history)
    h = history.groupBy(*keys).agg(F.max("avg_grade").cast("int").alias("_avg_grade"))
    return (matches.join(h, keys, "left").select(*matches.columns, "_avg_grade")
            .withColumn("grade", F.coalesce(F.nullif(F.col("grade"), F.lit(0)), F.col("_avg_grade")))
            .drop("_avg_grade"))


def recode_match_type(scores: DataFrame, roles: DataFrame) -> DataFrame:
    """match_type digits + the zone family of the role (the SQL twin
    of H8, a correlated lookup written as a left join)."""
    r = roles.select(F.col("global_id").alias("role_id"), "zone")
    digits = F.translate(F.col("match_type"), "cdm", "")
    return (scores.join(r, "role_id", "left")
            .withColumn("match_type", F.concat(digits, zone_suffix_sql("zone"))).drop("zone"))


def participant_of(detail: DataFrame, role_id: str, players: str = "players") -> DataFrame:
    """C20: the participant entries of each match equal to a role."""
    keys = match_keys(detail)
    x = detail.select(*keys, F.explode(players).alias("p")).where(F.col("p.role_id") == role_id)
    return x.select(*keys, *[f"p.{f.name}" for f in x.schema["p"].dataType.fields if f.name not in keys])
