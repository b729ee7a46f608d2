"""Reading the given tables, and tables kept between jobs."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecforest.functions.vectors import doubles


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own in local mode and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isEmpty():
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="vecforest-"))
            found = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = found.get()
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str = "table") -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it back, so that loops do not grow the plan and lost executors cost nothing."""
    path = fresh_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The vectors as doc_id, vector, leaf and root; label is the leaf, and four roots share the leaves."""
    e = read_table(spark, folder, "embeddings")
    return e.select(F.col("vec_id").alias("doc_id"), doubles(F.col("embedding")).alias("vector"), F.col("label").cast("string").alias("leaf"), (F.col("label") % 4).cast("string").alias("root"))


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents")
