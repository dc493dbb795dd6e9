"""The corpus pipeline: STAGES over ``documents``, each written and read again.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents. A stage sees what its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.llm import decontaminate, jaccard_join, packing, pii, quality
from skirmish.llm.common import drop_keys, fresh, read, stored

THRESHOLD = 0.7


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the classifier accepts (score at least THRESHOLD). The model is
    fit on labelled documents of this input; every row is scored by its text."""
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    name = fresh(docs, "quality_score")
    return quality.score(docs, model, out_col=name).where(F.col(name) >= THRESHOLD).drop(name)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: five-word shingles,
    a Jaccard similarity of 0.8 or more, groups closed over links."""
    return jaccard_join.keep_one(docs, size=5, num=80)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item (rows are told apart by a hash
    of id and text, so that rows without an id are judged too)."""
    digest = F.xxhash64("doc_id", "text")
    bad = decontaminate.contamination(docs.select(digest.alias("doc_id"), "text"), read(spark, sf_dir, "benchmark"))
    return drop_keys(docs, digest, stored(bad.select("doc_id").distinct(), "contaminated"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind in brackets; n_chars follows the text."""
    return pii.redact_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed training sequences."""
    return packing.pack(docs, packing.public_tokenizer())


STAGES = [
    ("quality_classifier", quality_stage),
    ("ngram_jaccard_join", jaccard_stage),
    ("benchmark_decontamination", decontaminate_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

# the stages learn, hash and tokenize: SQL cannot express them (tests/llm compare with brute force)
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
