"""B8 over an index: names found by their trigrams.

The index is two stored tables: the rows in folders by a hash of their id
(``Bucketed``), and the postings, one row per id and distinct trigram of its
name, in folders by a hash of the trigram. A search reads the postings of its
own trigrams, keeps the ids that have all of them, reads the rows of these
ids' folders and checks the pattern on the names themselves, so it returns
what a scan returns. A pattern without three literal characters in a row
has no trigram and scans the rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from skirmish.operators.buckets import Bucketed
from skirmish.session import partitions_of, written

GRAM = 3
# Rows whose postings one task groups, then sorts.
ROWS_EACH = 1 << 16
# A search asks for at most this many trigrams (one bit of a long each); more can only narrow further.
MASK = 62


def trigrams(text: Column) -> Column:
    """The distinct trigrams of a text (null or shorter: none)."""
    n = F.length(text)
    grams = F.transform(F.sequence(F.lit(1), n - (GRAM - 1)), lambda i: F.substr(text, i, F.lit(GRAM)))
    return F.when(n >= GRAM, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def pattern_trigrams(q: str) -> list[str]:
    """The trigrams that every match of the LIKE pattern ``%q%`` holds: those of
    its literal runs, cut at unescaped ``%`` and ``_``."""
    runs, escaped = [""], False
    for c in q:
        if escaped or c not in "%_\\":
            runs[-1] += c
            escaped = False
        elif c == "\\":
            escaped = True
        else:
            runs.append("")
    return sorted({r[i:i + GRAM] for r in runs for i in range(len(r) - GRAM + 1)})


@dataclass(frozen=True)
class TrigramIndex:
    """An index under ``path`` over the column ``name`` of rows known by ``id``
    (``schema``: theirs); ``n`` folders for each of the two tables."""

    path: str
    id: str
    name: str
    schema: StructType
    n: int = 16
    rows_each: int = ROWS_EACH

    @property
    def rows(self) -> Bucketed:
        return Bucketed(f"{self.path}/rows", (self.id,), self.n, self.schema)

    def write(self, df: DataFrame) -> None:
        """Build both tables. Rows are dealt by their id before their names are cut
        up: equal postings are of one id, so they meet in its task, and no task
        groups the postings of a whole file. Postings are dealt by ranges of (trigram, id), so a
        trigram that a third of the names hold is spread over tasks. Rows without an id are left out."""
        self.rows.write(df.where(F.col(self.id).isNotNull()))
        names = self.rows.read(df.sparkSession).select(F.col(self.id).alias("id"), F.col(self.name).alias("name"))
        parts = partitions_of(names, self.rows_each)
        p = (names.repartition(parts, "id").select("id", F.explode(trigrams(F.col("name"))).alias("gram"))
             .distinct().withColumn("bucket", F.pmod(F.crc32(F.col("gram").cast("binary")), F.lit(self.n)).cast("int")))
        (p.repartitionByRange(parts, "bucket", "gram", "id").sortWithinPartitions("bucket", "gram", "id")
         .write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings"))

    def postings(self, spark: SparkSession, grams: list[str]) -> DataFrame:
        """The postings of ``grams``: their folders only, the trigrams pushed down."""
        buckets = sorted({zlib.crc32(g.encode()) % self.n for g in grams})
        schema = StructType([StructField("id", self.schema[self.id].dataType), StructField("gram", StringType()),
                             StructField("bucket", IntegerType())])
        return (spark.read.schema(schema).parquet(f"{self.path}/postings")
                .where(F.col("bucket").isin(buckets) & F.col("gram").isin(grams)))

    def candidates(self, spark: SparkSession, grams: list[str]) -> DataFrame:
        """Ids whose names hold all of ``grams``: one bit each, combined before the shuffle."""
        grams = grams[:MASK]
        bit = F.lit(0).cast("long")
        for i, g in enumerate(grams):
            bit = F.when(F.col("gram") == g, F.lit(1 << i).cast("long")).otherwise(bit)
        return (self.postings(spark, grams).groupBy("id").agg(F.bit_or(bit).alias("_all"))
                .where(F.col("_all") == (1 << len(grams)) - 1).select(F.col("id").alias(self.id)))

    def search(self, spark: SparkSession, q: str) -> DataFrame:
        """The stored rows whose name is LIKE ``%q%``."""
        like = F.col(self.name).like(f"%{q}%")
        grams = pattern_trigrams(q)
        if not grams:
            return self.rows.read(spark).where(like)
        ids = written(self.candidates(spark, grams), "candidates")
        return self.rows.read(spark, self.rows.touched(ids)).where(like).join(ids, self.id, "left_semi")
