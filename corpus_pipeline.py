"""The corpus pipeline: each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecforest.llm.common import quoted, table
from vecforest.llm.exact import drop_exact_duplicates
from vecforest.llm.neardup import drop_near_duplicates
from vecforest.llm.packing import pack_documents
from vecforest.llm.quality import drop_low_quality
from vecforest.llm.queries import END_ID, JSON_TOKENIZER
from vecforest.llm.suffixes import without_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the classifier rejects; null and empty texts have nothing to reject and stay."""
    return drop_low_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text stays, the one with the largest id; null counts as empty."""
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays, the one with the smallest id; texts without words are linked with nothing."""
    return drop_near_duplicates(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes strings of 400 bytes that occur twice out of the texts; a null text becomes an empty one."""
    out = without_repeats(docs, keep=tuple(docs.columns))
    row = F.col("row").withField("text", F.col("kept_text")).withField("n_chars", F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("row.n_chars")))  # the other columns stay as they are
    return out.select(row.alias("row")).select("row.*").select(*[quoted(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens; a null text is an empty one with an end id. Other columns go."""
    return pack_documents(docs, JSON_TOKENIZER, END_ID)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("near dedup", near), ("suffix-array dedup", repeats), ("best-fit packing", packed)]

#: SQL cannot express the language model, the shingles or the packing; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = table(docs, "stage")
    return docs
