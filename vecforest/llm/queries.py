"""The queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

END_ID, VOCAB = 2, 50257
JSON_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vecforest.llm.exact import exact_duplicates

    return exact_duplicates(read(spark, sf_dir, "documents"))


ORACLES["op3_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


@query
def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vecforest.llm.binary import token_file_digests

    return token_file_digests(read(spark, sf_dir, "documents"), JSON_TOKENIZER, END_ID, VOCAB)


@query
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vecforest.llm.bpe import bpe_round_trip

    return bpe_round_trip(read(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vecforest.llm.packing import pack_documents

    return pack_documents(read(spark, sf_dir, "documents"), JSON_TOKENIZER, END_ID)


@query
def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vecforest.llm.neardup import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"))


@query
def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vecforest.llm.ann import nearest_neighbours

    return nearest_neighbours(read(spark, sf_dir, "embeddings"))


@query
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vecforest.llm.suffixes import without_repeats

    return without_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vecforest.llm.lines import without_repeated_lines

    return without_repeated_lines(read(spark, sf_dir, "documents")).drop("kept_text", "row")


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vecforest.llm.unigram import token_counts

    return token_counts(read(spark, sf_dir, "documents"), PIECES)


@query
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vecforest.llm.quality import quality

    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).drop("key")


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


@query
def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vecforest.llm.topk import exact_top_k

    return exact_top_k(read(spark, sf_dir, "embeddings"))


WHOLE = """v AS (SELECT vec_id, label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)"""

ORACLES["op11_exact_top_k"] = f"""
WITH {WHOLE}, p AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.x, b.x)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, (row_number() OVER w)::INT AS rank, vec_id, score FROM p WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vecforest.llm.whitening import whitening

    out = whitening(read(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", out["deviation"].cast("long"))


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vecforest.llm.negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(read(spark, sf_dir, "embeddings"), label=label)


ORACLES["op13_hard_negatives"] = f"""
WITH {WHOLE}, r AS (SELECT vec_id, x, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS l FROM v WHERE label IS NOT NULL),
p AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.l = b.l AS alike, list_dot_product(a.x, b.x)::BIGINT AS score FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
pos AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM p WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN p USING (anchor_id) WHERE NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 3
"""
