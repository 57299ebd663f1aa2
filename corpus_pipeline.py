"""A corpus from raw documents in five stages; each works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.llm import decontaminate, minhash, mixing, quality, shards
from proofline.llm.shared import written

#: SQL has no way to write the permutation and its checksums; tests/llm holds the stages against brute force instead.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the lines that are common on their host; n_chars follows the text.

    The verdicts are written before rows are taken out: Spark would else move the filter below the rules' columns, and
    work out the arrays that they share once for each word.
    """
    columns = docs.columns
    judged = written(quality.quality(docs).select(*[c for c in columns if c != "text"], "clean_text", "kept"), "judged")
    kept = judged.filter("kept").withColumn("text", F.col("clean_text"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates by five-word shingles, the one with the smallest doc_id.

    Rows are told apart by doc_id and text: other texts under the same doc_id are documents of their own, and so are
    texts without a doc_id. Of rows equal in both one stays; two hashes tell whether they are.
    """
    first = minhash.near_duplicates(docs, shingle=5).filter("first").select(F.col("id").alias("_row")).distinct()
    named = docs.withColumns({"_row": F.xxhash64("doc_id", "text"), "_own": F.xxhash64(F.lit("own"), "text", "doc_id")})
    return named.join(first, "_row", "left_semi").dropDuplicates(["_row", "_own"]).drop("_row", "_own")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.judged(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("clean").select(*docs.columns)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks, in one random order."""
    return mixing.mix(docs).select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the shard and the slot that each goes to."""
    placed = shards.shard(docs, carry=tuple(c for c in docs.columns if c != "doc_id"))
    return placed.select(*docs.columns, "shard", "slot")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing_sources", mixing_sources),
    ("sharding", sharding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each but the last written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
