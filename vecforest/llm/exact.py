"""Exact duplicates: two-pass Bloom filtering, DataFrame functions only.

The texts are read once, for a narrow table of ids and SHA-256 sums. The first pass
over it marks the bits that two or more sums hit. In the second, rows with a sum that
cannot be repeated pass straight through; the others alone are shuffled. The filter
is cut by hash range into shards of SHARD_BITS (common.py), each with a pass over its
own rows, so that it has 16 bits a row at any size.

Defined results: null text counts as empty; empty texts equal each other, and so do
long ones, byte for byte; of equal texts the row with the largest id stays (a null id
is below any other; if all ids of a group are null, all its rows stay, as none can be
told from another). An empty table gives an empty result. Other columns are not touched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecforest.llm.common import filter_size, flagged, quoted, repeated_filter, shard_of, table, text_rows, whole_text


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    size = filter_size(df.count())
    sums = text_rows(df, id_col, text_col).select("doc_id", F.unhex(F.sha2("text", 256)).alias("sha"))
    narrow = table(sums.withColumn("__key", F.xxhash64("sha")).withColumn("shard", shard_of(F.col("__key"), size[0])), "exact", "shard" if size[0] > 1 else None)
    rows = flagged(narrow, "__key", narrow, size, repeated_filter, "maybe").select("doc_id", "sha", "maybe")
    hexed = F.lower(F.hex("sha")).alias("text_sha256")
    alone = rows.filter(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), hexed
    )
    maybe = rows.filter("maybe")
    # Summed before the shuffle; a hot group is one row a task. Its members meet it in a join that Spark can split.
    groups = table(maybe.groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    met = maybe.join(groups, "sha").select(
        "doc_id", "keep_id", "group_size", (F.col("keep_id").isNull() | F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False))).alias("kept"), hexed
    )
    return alone.unionByName(met)


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; one row for each distinct text.

    Of the possibly repeated rows each task keeps only the best row of a text
    before the shuffle (a maximum of structs), so a hot text costs a row a task.
    """
    sha = F.sha2(whole_text(text_col), 256).alias("sha")
    size = filter_size(df.count())
    keys = table(df.select(sha).select(F.xxhash64("sha").alias("__key")).withColumn("shard", shard_of(F.col("__key"), size[0])), "exact", "shard" if size[0] > 1 else None)
    rows = df.select(F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("row"), sha, F.col(id_col).alias("id"))
    found = flagged(rows.withColumn("__key", F.xxhash64("sha")), "__key", keys, size, repeated_filter, "maybe")
    alone = found.filter(~F.col("maybe")).select("row.*")
    met = found.filter("maybe").groupBy("sha").agg(F.max_by("row", F.struct(F.col("id").isNotNull(), "id")).alias("row")).select("row.*")
    return alone.unionByName(met)
