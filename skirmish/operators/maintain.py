"""I: table maintenance as pure functions ``(target, updates) -> new target``.

No MERGE-capable format is assumed: each operation is a dedupe of the
batch (an aggregate, reduced map-side), a join on the key, and a
projection. When the batch's distinct keys are few (a capped count checks
it), they are broadcast and the target is split into touched and untouched
rows by scans — the target is never shuffled against a small batch; a large
batch takes the plain full-outer/anti join. The caller writes the result
(e.g. to a new table version in the shared checkpoint folder), which keeps
jobs restartable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skirmish.operators.ordered import merge_seen_ranges, seen_sets

LEVEL_FULL = 100  # fixed value: roles of this level go to ``roles``, others to ``lamb_roles``
KEY_DEFAULTS = {"global_id": "", "role_id": 0, "name": "", "zone": "", "server": ""}


def match_keys(*frames: DataFrame) -> list[str]:
    """A match is (match_type, match_id): ids repeat across types. Frames of one
    type that do not carry it are met by the id alone; a frame without the type
    cannot meet one that has it."""
    typed = ["match_type" in f.columns for f in frames]
    if any(typed) and not all(typed):
        raise ValueError("match_type is missing on one side: match ids repeat across types")
    return ["match_type", "match_id"] if all(typed) else ["match_id"]


def split_by_keys(target: DataFrame, keys_df: DataFrame, keys: list[str]):
    """(rows of ``target`` whose key is in ``keys_df``, the other rows); AQE
    broadcasts a small key set by its measured size."""
    return target.join(keys_df, keys, "left_semi"), target.join(keys_df, keys, "left_anti")


# --------------------------------------------------------------------- I1
def collapse_updates(updates: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """Per key, the batch's net change: for each field the last non-NULL
    value by ``order`` (two updates of one key apply in order; NULL keeps
    what was there). Without an order column the largest value of each field,
    so that the result does not depend on the plan."""
    fields = [c for c in updates.columns if c not in keys and c != order]
    if order is None:
        aggs = [F.max(c).alias(c) for c in fields]
    else:
        aggs = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in fields]
    return updates.groupBy(*keys).agg(*aggs)


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], order: str | None = None,
           keep_max: tuple[str, ...] = ()) -> DataFrame:
    """Insert new keys, update existing ones; a NULL in an update keeps
    the old value. Columns of the target not in the batch are kept.

    One full outer join of the target with the collapsed batch; columns in
    ``keep_max`` never go down (I7)."""
    return merge_updates(target, collapse_updates(updates, keys, order), keys, target.columns, keep_max)


def merge_updates(target: DataFrame, u: DataFrame, keys: list[str], columns: list[str], keep_max: tuple[str, ...] = ()) -> DataFrame:
    """The target with one collapsed update per key merged in."""
    j = target.alias("t").join(u.alias("u"), keys, "full_outer")
    out = []
    for c in target.columns:
        if c in keys:
            continue
        new = guard_fetched_count(F.col(f"u.{c}"), F.col(f"t.{c}")) if c in keep_max and c in u.columns else None
        if c not in u.columns:
            out.append(F.col(f"t.{c}"))
        else:
            out.append((F.coalesce(F.col(f"u.{c}"), F.col(f"t.{c}")) if new is None else new).alias(c))
    return j.select(*keys, *out).select(*columns)


def guard_fetched_count(new: Column, old: Column) -> Column:
    """A smaller new fetched_count is ignored (NULLs skipped)."""
    return F.greatest(new, old)


# --------------------------------------------------------------------- I2, I3
def insert_if_absent(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """I3 (and the matches part of I2): rows of ``new`` whose key is absent
    from the target (one per key), appended."""
    return target.unionByName(fresh_rows(target, new, keys).select(*target.columns))


def fresh_rows(target: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows of ``new`` (one per key) whose key is absent from ``target``. Of
    several rows of one key the first by ``order``, then by their content:
    every use of the result sees the same one."""
    rest = [c for c in new.columns if c not in keys]
    ranked = F.struct(*([order] if order else []), *rest) if rest else F.lit(True)
    one = new.groupBy(*keys).agg(F.min(ranked).alias("_row"))
    one = one.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in new.columns])
    return one.join(target.select(*keys), keys, "left_anti").select(*new.columns)


def participants(matches: DataFrame, roles_col: str = "roles") -> DataFrame:
    """One row per entry of the participant array. J9's entries carry the
    account-wide id beside the in-game one; ``role_id`` becomes the former."""
    keys = match_keys(matches)
    fields = [f.name for f in matches.schema[roles_col].dataType.elementType.fields if f.name not in ("match_id", "match_type")]
    parts = matches.select(*keys, F.explode(roles_col).alias("p")).select(*keys, *[F.col(f"p.{f}").alias(f) for f in fields])
    return parts.withColumn("role_id", F.col("global_id" if "global_id" in parts.columns else "role_id").cast("string"))


def insert_matches(matches: DataFrame, match_roles: DataFrame, scores: DataFrame,
                   new: DataFrame, roles_col: str = "roles"):
    """Insert new matches (absent ids only), one match_role per
    participant of each inserted match, and raise scores.fetched_count by
    the number of inserted participations (NULL + n stays NULL).

    ``new`` holds match rows plus an array ``roles`` of participant structs
    (J9's form). Returns (matches', match_roles', scores').
    """
    keys = match_keys(matches, new)
    fresh = fresh_rows(matches, new, keys)
    m2 = matches.unionByName(fresh.select(*matches.columns))
    parts = participants(fresh, roles_col)
    mr_new = parts.select(*[F.col(c) if c in parts.columns else F.lit(None).cast(t).alias(c)
                            for c, t in match_roles.dtypes])
    # participant rows already stored for the new match ids (normally none)
    seat = [*match_keys(match_roles, fresh), "role_id"]
    mr2 = match_roles.unionByName(mr_new.join(match_roles.select(*seat), seat, "left_anti"))
    n = parts.groupBy("role_id", "match_type").agg(F.count(F.lit(1)).alias("_n"))
    return m2, mr2, add_counts(scores, n)


def add_counts(scores: DataFrame, n: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """fetched_count raised by ``_n`` per key (NULL + n stays NULL)."""
    keys = keys or ["role_id", "match_type"]
    return (scores.join(n, keys, "left")
            .withColumn("fetched_count", F.when(F.col("_n").isNull(), F.col("fetched_count"))
                        .otherwise(F.col("fetched_count") + F.col("_n")).cast("int"))
            .select(*scores.columns))


def insert_match_logs(target: DataFrame, new: DataFrame) -> DataFrame:
    """Replays inserted when their match is absent."""
    return insert_if_absent(target, new, match_keys(target, new))


# --------------------------------------------------------------------- I4–I6
def role_log_key(df: DataFrame) -> DataFrame:
    """Key columns of a role log with their defaults ("" / 0)."""
    return df.select(*[F.coalesce(F.col(k), F.lit(v)).alias(k) for k, v in KEY_DEFAULTS.items()],
                     *[c for c in df.columns if c not in KEY_DEFAULTS])


def insert_role_logs(target: DataFrame, seen: DataFrame, day: str = "day") -> DataFrame:
    """I4: add seen days to role logs keyed by (global_id, role_id, name,
    zone, server); rows without a global id are skipped; each key's
    ``seen`` set is merged (E7)."""
    from skirmish.functions.ranges import day_range

    keys = list(KEY_DEFAULTS)
    t = role_log_key(target).select(*keys, "seen")
    s = role_log_key(seen.where(F.col("global_id").isNotNull() & (F.col("global_id") != "")))
    days = s.select(*keys, day_range(F.col(day)).alias("seen"))
    # logs of keys without new days are kept as they are; only touched keys are re-merged
    touched, untouched = split_by_keys(t, days.select(*keys).distinct(), keys)
    old = touched.select(*keys, F.explode("seen").alias("seen"))
    return untouched.unionByName(seen_sets(merge_seen_ranges(old.unionByName(days), keys), keys))


def route_roles(rows: DataFrame, level: str = "level"):
    """Level-100 roles → (roles, lamb_roles) split; the level may arrive as
    text or as a number, so it is compared as text."""
    full = F.coalesce(F.trim(F.col(level).cast("string")) == str(LEVEL_FULL), F.lit(False))
    return rows.where(full), rows.where(~full)


def retire_lamb_roles(lamb_roles: DataFrame, roles: DataFrame) -> DataFrame:
    """Lamb roles whose id now appears among the full roles are removed."""
    return lamb_roles.join(roles.select("global_id"), "global_id", "left_anti")


# --------------------------------------------------------------------- I8–I9
def dictionary_push(dictionary: DataFrame, entries: DataFrame, mode: str = "insert_only", order: str | None = None) -> DataFrame:
    """I8: push (tag, id, content) entries.

    insert_only: only absent keys are added; overwrite: absent keys added,
    present ones replaced when the content changed; force: every entry is
    written. Of several entries of one key in the batch, insert_only takes the
    first and the other modes the last by ``order``; without an order column
    the smallest content, so that the result does not depend on the plan."""
    keys = ["tag", "id"]
    if order is None:
        pick = F.min("content")
    else:
        pick = (F.min_by if mode == "insert_only" else F.max_by)("content", F.struct(order, "content"))
    e = entries.groupBy(*keys).agg(pick.alias("content")).select("tag", "id", "content")
    if mode == "insert_only":
        return insert_if_absent(dictionary, e, keys)
    if mode in ("overwrite", "force"):
        kept = dictionary.join(e.select(*keys), keys, "left_anti")
        if mode == "overwrite":
            same = dictionary.join(e, keys + ["content"], "left_semi")
            changed = e.join(same.select(*keys), keys, "left_anti")
            return kept.unionByName(same.select(*dictionary.columns)).unionByName(changed.select(*dictionary.columns))
        return kept.unionByName(e.select(*dictionary.columns))
    raise ValueError(f"unknown mode {mode!r}")


def dictionary_find(dictionary: DataFrame, tag: str, *, content=None, key=None) -> DataFrame:
    """Lookup both ways — content → key rows, or key → content rows."""
    d = dictionary.where(F.col("tag") == tag)
    if content is not None:
        return d.where(F.col("content") == content).select("tag", "id", "content")
    if key is not None:
        return d.where(F.col("id") == key).select("tag", "id", "content")
    raise ValueError("give content or key")


def find_ids(df: DataFrame, col: str, dictionary: DataFrame, tag: str, out: str = "id") -> DataFrame:
    """I9, set form: translate a name column to dictionary ids by a join."""
    d = dictionary.where(F.col("tag") == tag).select(F.col("content").alias(col), F.col("id").alias(out))
    return df.join(d, col, "left")


# --------------------------------------------------------------------- I10–I14
def passport_backfill(roles: DataFrame) -> DataFrame:
    """Initial passport log rows from roles that have a passport."""
    return roles.where(F.col("passport_id").isNotNull()).select(
        "global_id", "passport_id", F.col("updated_at").alias("inserted_at"))


def repair_matches(matches: DataFrame, inferred: DataFrame) -> DataFrame:
    """Take E5's role_ids where the inference was accepted."""
    keys = match_keys(matches, inferred)
    return upsert(matches, inferred.where(F.col("status") == "fixed").select(*keys, "role_ids"), keys)


def role_seen_from_match(participants: DataFrame, matches: DataFrame, roles: DataFrame) -> DataFrame:
    """Each participant seen on its match's start date; missing role
    fields filled from the stored role. Output feeds I4."""
    from skirmish.functions.scalars import start_date, start_time

    keys = match_keys(participants, matches)
    m = matches.select(*keys, start_date(start_time("start_time")).alias("day"))
    r = roles.select("global_id", F.col("role_id").alias("_rid"), F.col("name").alias("_name"),
                     F.col("zone").alias("_zone"), F.col("server").alias("_server"))
    p = participants.select(*keys, F.col("role_id").alias("global_id"),
                            *[F.col(c) if c in participants.columns else F.lit(None).alias(c)
                              for c in ["name", "zone", "server"]])
    x = p.join(m, keys, "inner").join(r, "global_id", "left")
    return x.select("global_id", F.col("_rid").alias("role_id"),
                    F.coalesce("name", "_name").alias("name"), F.coalesce("zone", "_zone").alias("zone"),
                    F.coalesce("server", "_server").alias("server"), "day")


def attach_person(role_rows: DataFrame, person_rows: DataFrame, key: str = "global_id") -> DataFrame:
    """Role rows take the person_id of their payload (NULL clears
    nothing once fed to I1)."""
    p = person_rows.select(key, F.col("person_id").alias("_pid"))
    return role_rows.join(p, key, "left").withColumn("person_id", F.coalesce("_pid", F.lit(None).cast("string"))).drop("_pid")


def save_performance(scores: DataFrame, perf: DataFrame, order: str | None = None):
    """One score row per (role, match type) where the payload has a
    score, with its ranking parsed (H11) and a fetched_count that never goes
    down (I7); returns (scores', score_log rows)."""
    from skirmish.operators.ordered import score_history

    rows = perf.where(F.col("score").isNotNull())
    if dict(rows.dtypes).get("ranking") == "string":
        from skirmish.functions.scalars import parse_ranking

        rows = rows.withColumn("ranking", parse_ranking("ranking"))
    cols = [c for c in rows.columns if c in scores.columns or c == order]
    return upsert(scores, rows.select(*cols), ["role_id", "match_type"], order,
                  keep_max=("fetched_count",)), score_history(rows)
