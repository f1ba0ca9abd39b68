"""The corpus pipeline: quality, exact and near duplicates, decontamination, tokenising.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``. All but the
last return the columns of their input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.llm import bpe, decontaminate, exact_dedup, minhash, quality
from trialspark.llm.common import limit_batches, shared_dir

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose quality score is under the threshold; all stay where no label says anything."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels, quality.training_fold(F.col("doc_id")))
    if not model.trained:
        return docs
    return docs.where(quality.score(docs["text"], model) >= quality.THRESHOLD)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts."""
    return exact_dedup.keep_first(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by five-word shingles at 0.8 or more."""
    return minhash.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ids (packed little-endian 32-bit), n_tokens, and whether they decode to the text.

    Columns of these names that ``docs`` has already are replaced.
    """
    limit_batches(spark)
    names = [c for c in docs.columns if c not in ("ids", "n_tokens", "round_trip")]
    done = docs.select(*[F.col(f"`{c}`") for c in names], bpe.round_trip(docs["text"], RANKS, public_tokenizers.PATTERN).alias("ids"))
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return done.select(*[F.col(f"`{c}`") for c in names], F.col("ids.ids").alias("ids"), (F.octet_length("ids.ids") / 4).cast("long").alias("n_tokens"),
                       (F.col("ids.decoded") == text).alias("round_trip"))


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicates),
    ("decontaminate", benchmark_leaks),
    ("byte_bpe", tokens),
]

#: SQL expresses neither a fitted classifier nor the merges; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
