"""Summaries with exact ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vecforest.sources.tables import materialize


def at_ranks(df: DataFrame, col: str, ranks: list[int]) -> DataFrame:
    """(rank, value) at these ranks from 0 of the ascending column, by counts of its values and a running sum.

    Equal values are counted together before they are ordered. The running sum is
    kept per partition of a range sort, with one number carried between partitions.
    """
    counts = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).count()
    # Written once: the bounds of a range sort are sampled anew whenever it runs.
    sorted_counts = materialize(counts.repartitionByRange("value").withColumn("part", F.spark_partition_id()))
    before = sorted_counts.groupBy("part").agg(F.sum("count").alias("n"))
    base = before.withColumn("base", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("part", "base")  # one row per partition
    upto = F.sum("count").over(W.partitionBy("part").orderBy("value"))
    ends = sorted_counts.join(base, "part").select("value", (F.col("base") + upto).alias("end"), "count")
    wanted = F.array(*map(F.lit, ranks)) if ranks else F.array().cast("array<int>")
    return ends.select("value", F.explode(F.filter(wanted, lambda r: (r < F.col("end")) & (r >= F.col("end") - F.col("count")))).alias("rank"))


def stats(df: DataFrame, col: str) -> DataFrame:
    """Minimum, upper median (sorted[n // 2]), maximum and mean in one row."""
    n = df.filter(F.col(col).isNotNull()).count()
    middle = at_ranks(df, col, [n // 2]).agg(F.max("value").alias("median"))
    return df.agg(F.min(col).alias("minimum"), F.max(col).alias("maximum"), F.avg(col).alias("mean")).crossJoin(middle)


def quantile_floor(df: DataFrame, col: str, q: float) -> DataFrame:
    """sorted[floor((n - 1) * q)] in one row."""
    n = df.filter(F.col(col).isNotNull()).count()
    return at_ranks(df, col, [int((n - 1) * q)] if n else []).agg(F.max("value").alias("quantile"))


def ranks(df: DataFrame, keys: list, name: str) -> DataFrame:
    """Adds the rank, from 0, within g by the keys: a range sort and one number carried for each partition and group."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = df.repartitionByRange(parts, "g", *keys).sortWithinPartitions("g", *keys)
    t = materialize(t.withColumns({"_i": F.monotonically_increasing_id(), "_p": F.spark_partition_id()}))
    heads = t.groupBy("g", "_p").agg(F.min("_i").alias("_first"), F.count("*").alias("_n"))
    heads = heads.withColumn("_off", F.coalesce(F.sum("_n").over(W.partitionBy("g").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return t.join(heads.drop("_n"), ["g", "_p"]).withColumn(name, F.col("_i") - F.col("_first") + F.col("_off")).drop("_i", "_p", "_first", "_off")
