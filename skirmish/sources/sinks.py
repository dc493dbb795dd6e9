"""Result rows to clients and the documents sink.

Documents (tag, content = array of JSON rows) are built only from
aggregates, whose size is bounded by their keys, never from fact rows.
Writes go to the caller's path (shared storage on a cluster) with Spark's
file committer, so a lost executor just re-runs its task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_TAKE = 200
REPORT_TAKE = 2000


def take_rows(df: DataFrame, n: int = DEFAULT_TAKE, order: list | None = None) -> DataFrame:
    """The first ``n`` rows as JSON text (NULL fields are left out, so a
    row's key set is the fields it has)."""
    x = df.orderBy(*order) if order else df
    return x.limit(n).select(F.to_json(F.struct("*")).alias("value"))


def union_rows(*frames: DataFrame) -> DataFrame:
    """Rows of several frames together; absent columns are NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def to_document(df: DataFrame, tag: str | None = None) -> DataFrame:
    """All rows of an aggregate → one row whose ``content`` is the
    sorted array of JSON rows (one reducer: use on aggregates only)."""
    rows = df.select(F.to_json(F.struct("*")).alias("value"))
    doc = rows.agg(F.sort_array(F.collect_list("value")).alias("content"))
    return doc if tag is None else doc.select(F.lit(tag).alias("tag"), "content")


def stamp(df: DataFrame, tag: str | None = None) -> DataFrame:
    """Add the tag and insert/update timestamps (set on insert)."""
    x = df if tag is None else df.withColumn("tag", F.lit(tag))
    now = F.current_timestamp()
    return x.withColumn("inserted_at", now).withColumn("updated_at", now)


def save_document(df: DataFrame, tag: str, path: str, mode: str = "append", fmt: str = "parquet",
                  options: dict | None = None) -> None:
    """Append a tagged document to the documents sink (parquet folder
    partitioned by tag, or ``fmt="jdbc"`` with connection options)."""
    w = stamp(df, tag).write.mode(mode)
    if fmt == "jdbc":
        w.format("jdbc").options(**(options or {})).save()
    else:
        w.partitionBy("tag").format(fmt).options(**(options or {})).save(path)


def tagged_report_set(matches: DataFrame, grades: list[int] | None = None) -> DataFrame:
    """The batch report set in one pass — the grade count document
    (``grade_count``) and one line-up report per grade (``kungfus_<g>``),
    as (tag, content). One grouped aggregate replaces a job per grade."""
    from skirmish.operators.reports import split_team

    grades = grades or list(range(1, 14))
    gc = matches.groupBy("grade").agg(F.count(F.lit(1)).alias("count"))
    gc_doc = gc.agg(F.sort_array(F.collect_list(F.to_json(F.struct("grade", "count")))).alias("content")) \
               .select(F.lit("grade_count").alias("tag"), "content")
    t = split_team(matches.where(F.col("grade").isin(grades)))
    per = t.groupBy("grade", "kungfus").agg(F.count(F.lit(1)).alias("count"), F.count_if("won").alias("won"))
    docs = per.groupBy("grade").agg(F.sort_array(F.collect_list(
        F.to_json(F.struct("kungfus", "count", "won")))).alias("content"))
    docs = docs.select(F.concat(F.lit("kungfus_"), F.col("grade").cast("string")).alias("tag"), "content")
    return gc_doc.unionByName(docs)


def save_report_set(docs: DataFrame, path: str, mode: str = "append") -> None:
    """Write every document of the set in one job, partitioned by tag."""
    stamp(docs).write.mode(mode).partitionBy("tag").parquet(path)


def replace_report_set(docs: DataFrame, path: str, run: str) -> None:
    """A8/A9 as a repeatable write: the documents of one ``run`` are stored by
    (run, tag) and replace what an earlier try of the same run left; other runs
    and tags keep their files (dynamic partition overwrite)."""
    (stamp(docs).withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run", "tag").parquet(path))
