"""B: projections, filters and predicates.

All filters are Column expressions, so Catalyst pushes them into the scan
(``PushedFilters`` on parquet, a WHERE clause on JDBC) where the source
allows it.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skirmish.operators.predicates import refused
from skirmish.operators.trigram import TrigramIndex
from skirmish.sources.tables import read_match_type

# ---------------------------------------------------------------------------
# Fixed values of the refresh rule.
REFRESH_SCORE_SPLIT = 2200          # score below → the slow lane
REFRESH_SLOW_AGE_SECONDS = 6 * 24 * 3600
REFRESH_SLOW_BATCH = 100
REFRESH_FAST_AGE_SECONDS = 18 * 3600
REFRESH_UNKNOWN_TOTAL = 1000        # total_count assumed when unknown
# ---------------------------------------------------------------------------


def recent_matches(df: DataFrame, min_id: int, col: str = "match_id") -> DataFrame:
    """B2: rows with an id above ``min_id`` (pushed to the scan)."""
    return df.where(F.col(col) > min_id)


def recent_days(df: DataFrame, days: int, as_of: str, col: str = "inserted_at") -> DataFrame:
    """Rows newer than ``as_of`` minus ``days`` days."""
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    return df.where(F.col(col) > cutoff)


def items_by_tag(items: DataFrame, tag: str | None = None) -> DataFrame:
    """Dictionary rows grouped by tag (optionally one tag); the list of
    a tag is bounded by the dictionary, not by the fact data."""
    x = items if tag is None else items.where(F.col("tag") == tag)
    return x.groupBy("tag").agg(F.array_sort(F.collect_list(F.struct("id", "content"))).alias("items"))


def get_role(roles: DataFrame, scores: DataFrame, role_id: str, match_type: str | None = None) -> DataFrame:
    """One role (by global id) with its score rows (left join); score
    columns that clash with role columns are prefixed ``score_``."""
    r = roles.where(F.col("global_id") == role_id)
    s = scores.where(F.col("role_id") == role_id)
    if match_type is not None:
        s = s.where(F.col("match_type") == match_type)
    s = s.select(F.col("role_id").alias("global_id"),
                 *[F.col(c).alias(f"score_{c}" if c in r.columns else c) for c in s.columns if c != "role_id"])
    return r.join(s, "global_id", "left")


def get_match(matches: DataFrame, match_id: int, match_type: str | None = None) -> DataFrame:
    """One match by its type and id (by the id alone in a table of one type)."""
    x = matches if match_type is None else read_match_type(matches, match_type)
    return x.where(F.col("match_id") == match_id)


def get_matches(matches: DataFrame) -> DataFrame:
    """All matches ordered by id."""
    return matches.orderBy("match_id")


def search_role(roles: DataFrame, persons: DataFrame, q: str) -> DataFrame:
    """Roles whose name contains ``q`` (``%``/``_`` in q act as LIKE
    wildcards, as in the reference), with their person's name. The name
    filter runs on the roles scan; only the matching roles meet persons (the
    result keys need no score aggregate)."""
    return with_person(roles.where(F.col("name").like(f"%{q}%")), persons)


def search_role_indexed(spark, index: TrigramIndex, persons: DataFrame, q: str) -> DataFrame:
    """B8 over a trigram index of the roles' names: the same rows as
    ``search_role``, reading the postings of the pattern's trigrams and the
    rows of the folders they point to."""
    return with_person(index.search(spark, q), persons)


def with_person(r: DataFrame, persons: DataFrame) -> DataFrame:
    """Found roles with their person's name (B8's columns)."""
    p = persons.select("person_id", F.col("name").alias("person_name"))
    return (r.join(p, "person_id", "left")
            .select(F.col("global_id").alias("role_id"), "force", "name", "zone", "server", "person_name"))


def where_text(df: DataFrame, text: str, alias: str = "x1") -> DataFrame:
    """Caller-given predicate text in Spark SQL spelling over ``alias``.
    Only expressions of one row are accepted, judged on the parsed text
    (``predicates``): no subqueries, no windows, no functions beyond its list."""
    if bad := refused(df.sparkSession, text):
        raise ValueError(f"predicate text may not use {', '.join(bad)}")
    return df.alias(alias).where(F.expr(text))


@dataclass(frozen=True)
class Lit:
    """A literal in a predicate list (a bare ``str`` names a column)."""

    value: Any


_OPS = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b,
    "and": lambda a, b: a & b, "or": lambda a, b: a | b,
}


def term(t: Any) -> Column:
    """A predicate-list atom: column name, number/bool, Lit, or (lhs, op, rhs)."""
    if isinstance(t, Column):
        return t
    if isinstance(t, Lit):
        return F.lit(t.value)
    if isinstance(t, bool) or isinstance(t, (int, float)) or t is None:
        return F.lit(t)
    if isinstance(t, str):
        return F.col(t)
    if isinstance(t, tuple) and len(t) == 3 and t[1] in _OPS:
        return _OPS[t[1]](term(t[0]), term(t[2]))
    raise ValueError(f"unsupported predicate term {t!r}")


def where_list(df: DataFrame, clauses: list) -> DataFrame:
    """AND of clauses; each is ``(lhs, op, rhs)`` or ``(col, value)``
    (equality). Literal strings are given as ``Lit("...")`` (Q16)."""
    cond = F.lit(True)
    for c in clauses:
        if isinstance(c, tuple) and len(c) == 2:
            c = (c[0], "==", c[1] if not isinstance(c[1], str) else Lit(c[1]))
        cond = cond & term(c)
    return df.where(cond)


def paged(df: DataFrame, order_by: list, prefix: str | None = None, where=None,
          limit: int | None = None, offset: int | None = None, **_unknown) -> DataFrame:
    """Options in the order prefix (match type), where, limit, offset,
    over a total order. ``where`` is text (B9) or a clause list (B10);
    unknown options are ignored."""
    x = df
    if prefix is not None:
        x = read_match_type(x, prefix)
    if isinstance(where, str):
        x = where_text(x, where)
    elif where:
        x = where_list(x, where)
    return page(x.orderBy(*order_by), limit, offset)


def page(sorted_df: DataFrame, limit: int | None, offset: int | None = 0) -> DataFrame:
    """skip ``offset`` rows then take ``limit`` of a totally ordered frame.

    Spark runs sort + offset + limit as a distributed top-(offset+limit); an
    offset without a limit would skip rows in one task over the whole
    frame, so it is refused."""
    if offset and limit is None:
        raise ValueError("an offset needs a limit (pages are bounded)")
    x = sorted_df.offset(offset) if offset else sorted_df
    return x.limit(limit) if limit is not None else x


def refresh_due(scores: DataFrame, as_of: str) -> DataFrame:
    """The fetch worklist as (role_id, match_type, limit).

    score < 2200 → due if never fetched or older than 6 days, batch 100;
    otherwise (NULL score included) due if never fetched or older than 18
    hours, batch = total_count − fetched_to (unknown total → 1000, NULL
    fetched_to → 0)."""
    from skirmish.functions.scalars import epoch_micros

    age = (epoch_micros(F.lit(as_of)) - epoch_micros("fetched_at")) / 1_000_000
    slow = F.col("score").isNotNull() & (F.col("score") < REFRESH_SCORE_SPLIT)
    never = F.col("fetched_at").isNull()
    due = F.when(slow, never | (age > REFRESH_SLOW_AGE_SECONDS)).otherwise(never | (age > REFRESH_FAST_AGE_SECONDS))
    batch = F.when(slow, F.lit(REFRESH_SLOW_BATCH).cast("long")).otherwise(
        F.coalesce(F.col("total_count"), F.lit(REFRESH_UNKNOWN_TOTAL)).cast("long")
        - F.coalesce(F.col("fetched_to"), F.lit(0)).cast("long"))
    return scores.where(due).select("role_id", "match_type", batch.alias("limit"))


def missing_grade(matches: DataFrame) -> DataFrame:
    """Grade NULL or 0."""
    return matches.where(F.col("grade").isNull() | (F.col("grade") == 0))


def select_keys(df: DataFrame, keys: list[str], absent_type: str = "string") -> DataFrame:
    """Project to the named keys; absent ones come back NULL."""
    have = set(df.columns)
    return df.select(*[F.col(k) if k in have else F.lit(None).cast(absent_type).alias(k) for k in keys])


def fetched_only(scores: DataFrame) -> DataFrame:
    """Score rows that were fetched."""
    return scores.where(F.col("fetched_at").isNotNull())

