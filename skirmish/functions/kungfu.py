"""Class items, display order and line-up labels.

The class dictionary (items with tag kungfu) is a dimension of a few dozen
rows. It reaches the line-ups as one map, a scalar subquery, so that labelling
is a projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.functions.scalars import trim_quotes
from skirmish.sources.dimension import CLASS_ORDER, CLASS_ORDER_EXCEPTIONS, UNKNOWN_LABEL

# Sort key of a class the dimension does not know: after every known one.
UNKNOWN_RANK = 1_000_000.0


def kungfu_items(items: DataFrame, dim: DataFrame) -> DataFrame:
    """Items with tag kungfu, id as INT, quotes trimmed, joined to the
    (broadcast, fixed-size) class dimension. Columns: id, content, kungfu,
    short, rank."""
    k = items.where(F.col("tag") == "kungfu").select(
        F.col("id").try_cast("int").alias("id"), trim_quotes("content").alias("content"))
    return k.join(F.broadcast(dim), "content", "left").select("id", "content", "kungfu", "short", "rank")


def _order_key(entries: F.Column) -> F.Column:
    """Per element sort key: the display rank, except that for each fixed
    exception pair (a, b) present together, a sorts just before b (Q14)."""
    rank = {name: i + 1 for i, name in enumerate(CLASS_ORDER)}

    def key(e):
        base = F.coalesce(e["rank"].cast("double"), F.lit(UNKNOWN_RANK))
        for a, b in CLASS_ORDER_EXCEPTIONS:
            has_b = F.exists(entries, lambda x: x["content"] == b)
            base = F.when((e["content"] == a) & has_b, F.lit(rank[b] - 0.5)).otherwise(base)
        return base

    return F.transform(entries, lambda e: F.struct(key(e).alias("k"), e["id"].alias("id"),
                                                     F.coalesce(e["short"], F.lit(UNKNOWN_LABEL)).alias("short")))


# More class items than this make the labels fail: they are one row's map.
MAX_CLASS_ITEMS = 100_000


def class_map(kitems: DataFrame) -> DataFrame:
    """One row, one map: id → (content, short, rank) of the items of known
    classes. Of duplicate ids the smallest (content, short) counts."""
    first = (kitems.where(F.col("id").isNotNull())
             .groupBy("id").agg(F.min(F.struct("content", "short", "rank")).alias("_s"))
             .where(F.col("_s.short").isNotNull()))
    few = first.limit(MAX_CLASS_ITEMS + 1)
    return few.agg(F.when(F.count(F.lit(1)) <= MAX_CLASS_ITEMS, F.map_from_entries(F.collect_list(F.struct("id", "_s"))))
                   .otherwise(F.raise_error(F.lit(f"more than {MAX_CLASS_ITEMS} class items"))).alias("m"))


def lineup_labels(df: DataFrame, ids_col: str, kitems: DataFrame, out: str = "short") -> DataFrame:
    """H2: add ``out`` = short labels of the ids in ``ids_col``, sorted in
    class display order and concatenated. Unknown ids give ``?`` (last).

    The class items reach the rows as a scalar subquery, so labelling is a
    projection: building the plan starts no job, and ``df`` is neither
    shuffled nor read again."""
    x = df.withColumn("_m", class_map(kitems).scalar())
    entries = F.transform(F.col(ids_col), lambda i: F.struct(i.alias("id"), F.try_element_at(F.col("_m"), i).alias("c")))
    flat = F.transform(entries, lambda e: F.struct(e["id"].alias("id"), e["c"]["content"].alias("content"),
                                                   e["c"]["short"].alias("short"), e["c"]["rank"].alias("rank")))
    label = F.array_join(F.transform(F.array_sort(_order_key(flat)), lambda e: e["short"]), "")
    return x.withColumn(out, F.when(F.col(ids_col).isNull(), F.lit(None)).otherwise(label)).drop("_m")


def label_sql(lineups: str, key: str = "k") -> str:
    """The DuckDB twin of ``lineup_labels`` over a relation ``lineups`` with
    a list column ``key``; returns (key, short)."""
    exc = []
    for a, b in CLASS_ORDER_EXCEPTIONS:
        rank_b = CLASS_ORDER.index(b) + 1
        exc.append(f"WHEN e.content = '{a}' AND bool_or(e.content = '{b}') OVER (PARTITION BY e.{key}) "
                   f"THEN {rank_b - 0.5}")
    order = "CASE " + " ".join(exc) + f" ELSE coalesce(CAST(e.rank AS DOUBLE), {UNKNOWN_RANK}) END"
    return f"""(SELECT {key}, string_agg(short, '' ORDER BY ok, id) AS short FROM (
  SELECT e.{key}, e.id, coalesce(e.short, '{UNKNOWN_LABEL}') AS short, {order} AS ok
  FROM (SELECT x.{key}, x.id, ki.content, ki.short, ki.rank
        FROM (SELECT {key}, unnest({key}) AS id FROM (SELECT DISTINCT {key} FROM {lineups})) x
        LEFT JOIN kungfu_items ki ON ki.id = x.id) e
) GROUP BY {key})"""
