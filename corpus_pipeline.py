"""The training-data pipeline: documents in, packed sequences of token ids out.

Each stage takes all rows that its predecessor kept and returns the columns of
``documents``, the last one the places of all pieces. :func:`run` writes each
stage's result to the shared folder and reads it again, so a lost executor
costs at most the stage at hand.
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from callscope.llm import jaccard, packing, pii, quality, repeats  # noqa: E402
from callscope.llm.common import table  # noqa: E402
from callscope.session import new_folder  # noqa: E402

#: Of production: from the job's settings. This one makes results repeatable.
PII_KEY = b"callscope-example-key"


def _sized(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    order = [e.rule for e in quality.estimate(docs, [*quality.BASE, *quality.MORE])]
    return quality.cascade(docs, order).where("rejected_by is null").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of texts that are 0.8 alike in five-word shingles.

    Rows that repeat an id count once, with the least of their texts; rows without an id cannot be told apart and stay.
    """
    groups = jaccard.components(docs.where("doc_id is not null"), width=5, num=80, den=100)
    kept = groups.where("doc_id = component_id").select("doc_id").distinct()
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    order = F.struct(F.col("text").isNull(), F.col("text"), F.xxhash64(F.lit(0), *others))
    rows = docs.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), order).alias("row"))
    out = rows.select(*[F.col("row")[c].alias(c) for c in docs.columns])
    return out.union(docs.where("doc_id is null"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 100 bytes and more that start earlier."""
    return _sized(repeats.remove_repeats(docs), docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data and secrets."""
    return _sized(pii.replace(docs, PII_KEY), docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: SQL expresses neither the token ids nor the packing; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
