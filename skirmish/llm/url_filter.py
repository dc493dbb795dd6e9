"""URL filters: a blocked Bloom filter over listed canonical URLs passes
possible hits to an exact hash join that removes the false positives.

A listed entry is a host and a path prefix with a verdict. A page's url can
only hit an entry whose host is one of its host's suffixes and whose path is
one of its path's prefixes, so each url becomes a few canonical keys
``suffix + prefix``; keys that the Bloom filter does not hold are dropped
before anything is shuffled, the others meet the list in an exact join.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skirmish.llm.common import BlockedBloom, read

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
         ("block", "net/es/"), ("block", "net/fr/")]


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` and ``path``; both empty without ``://`` or for null."""
    rest = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"host": host, "path": path})


def rule_frame(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, rule string")


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
                default: str = "allow", filter_blocks: int = 1 << 16) -> DataFrame:
    """``pages`` × ``rules`` (verdict, rule = host/path-prefix) → one row per
    page: id, host, path, rule, verdict.

    The longest fitting rule wins (ties: longer host, then smaller text; a rule
    listed twice: block before allow). Pages without a fitting rule get a null
    rule and ``default``. Null or odd urls, null ids and repeated rows each give
    their own row; empty tables give empty (or all-default) results; null rules
    and rules without ``/`` are ignored. The filter has ``filter_blocks`` words
    whatever the list's length; a longer list only passes more keys on to the
    join, whose result is exact.
    """
    listed = (rules.where(F.instr("rule", "/") > 0)
              .groupBy("rule").agg(F.max("verdict").alias("rule_verdict"))
              .withColumns({"h": F.xxhash64("rule"), "path_len": F.length(F.regexp_extract("rule", r"(?s)^[^/]*(/.*)$", 1))}))
    bloom = BlockedBloom.build(listed, "h", filter_blocks)
    # the lengths of listed path prefixes: at most one per possible url length
    lengths = sorted(r[0] for r in listed.select("path_len").distinct().collect())
    held = pages.sparkSession.sparkContext.broadcast(bloom)

    @F.pandas_udf(T.BooleanType())
    def passes(h: pd.Series) -> pd.Series:
        return pd.Series(held.value.may_hold(h.to_numpy("int64")))

    base = with_parts(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")), "url").drop("url")
    # equal (host, path) are judged once: a hot url is pre-aggregated away
    urls = base.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.array_distinct(F.transform(
        F.filter(F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>"),
                 lambda n: n <= F.length("path")),
        lambda n: F.substring(F.col("path"), F.lit(1), n)))
    keys = (urls.select("host", "path", F.explode(suffixes).alias("suffix"))
            .select("host", "path", F.explode(F.transform(prefixes, lambda p: F.concat("suffix", p))).alias("key"))
            .withColumn("h", F.xxhash64("key"))
            .where(passes("h")))
    hits = keys.join(listed, [keys.h == listed.h, keys.key == listed.rule]).select(
        "host", "path", "rule", "rule_verdict",
        F.length("rule").alias("n"), (F.length("rule") - F.col("path_len")).alias("host_n"))
    best = hits.groupBy("host", "path").agg(F.min_by(
        F.struct("rule", "rule_verdict"), F.struct(-F.col("n"), -F.col("host_n"), "rule")).alias("w"))
    return (base.join(best, ["host", "path"], "left")
            .select("page_id", "host", "path", F.col("w.rule").alias("rule"),
                    F.coalesce("w.rule_verdict", F.lit(default)).alias("verdict")))


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"), rule_frame(spark))


ORACLE_SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules(verdict, rule, rhost, rpath) AS (VALUES
  ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'),
  ('allow', 'www.example.com/en/', 'www.example.com', '/en/'),
  ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')),
hits AS (
  SELECT s.page_id, s.host, s.path, r.rule, r.verdict,
         row_number() OVER (PARTITION BY s.page_id, s.host, s.path ORDER BY length(r.rule) DESC NULLS LAST) AS k
  FROM split s LEFT JOIN rules r
    ON (s.host = r.rhost OR ends_with(s.host, '.' || r.rhost)) AND starts_with(s.path, r.rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM hits WHERE k = 1
"""
