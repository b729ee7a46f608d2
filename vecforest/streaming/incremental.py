"""New documents as they arrive: vectors for what the cache lacks, and places among fixed themes and planes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecforest.operators.clustering import assign_themes, cells
from vecforest.operators.embed import Embedder, embed_missing, row_key


def embed_stream(stream: DataFrame, cache_path: str, out_path: str, embedder: Embedder, config: str, checkpoint: str):
    """Starts a query that writes vectors of new documents and adds new texts to the cache.

    Files are written under the batch's number, so a batch that is run again after
    a failure replaces what it wrote before. It does not take its own earlier rows for
    known ones; and a document without a vector is an error, never a lost row. The cache
    lies in a folder for each first two digits of its keys, and a batch reads only the
    folders that its own keys may be in.
    """
    schema = "row_key string, vector array<double>"

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        rows = df.withColumn("row_key", row_key(config))
        shard = F.substring("row_key", 1, 2).alias("shard")
        wanted = "|".join(sorted(r.shard for r in rows.select(shard).distinct().collect()))  # at most 256
        every = spark.read.option("recursiveFileLookup", True).schema(schema).parquet(cache_path)
        path = F.col("_metadata.file_path")
        mine = ~path.contains("/shard=") | path.rlike(f"/shard=({wanted})/")
        known = every.filter(~path.contains(f"/batch={number}/") & mine).dropDuplicates(["row_key"])
        missing = rows.select("row_key", "text").dropDuplicates(["row_key"]).join(known, "row_key", "left_anti")
        fresh = embed_missing(missing, embedder).withColumn("shard", F.substring("row_key", 1, 2))
        fresh.repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(f"{cache_path}/batch={number}")
        found = known.unionByName(spark.read.option("recursiveFileLookup", True).schema(schema).parquet(f"{cache_path}/batch={number}"))
        vector = F.coalesce("vector", F.raise_error(F.concat(F.lit("no vector for "), F.col("row_key"))).cast("array<double>"))
        rows.join(found, "row_key", "left").select("doc_id", "row_key", vector.alias("vector")).write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def assign_stream(stream: DataFrame, themes: DataFrame | None = None) -> DataFrame:
    """The theme, or else the root cell, of each arriving vector. Both depend on the vector alone, so earlier documents never move."""
    if themes is not None:
        return assign_themes(stream, themes)
    return cells(stream.withColumn("path", F.lit("r"))).select("doc_id", "cell")
