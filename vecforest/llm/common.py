"""Shared tables and small helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of one shard of a filter: what is sent to an executor at once, 32 MB. Larger tables have more shards.
SHARD_BITS = 1 << 28
BITMAP_BITS = 32768
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Rows carry whole texts here, so fewer of them go to a Python worker at once than by default."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, one of our own in local mode and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isEmpty():
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="vecforest-"))
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return found.get().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/vecforest/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends here, and lost executors cost nothing. by: a column of few values, of which each gets a folder."""
    spark = df.sparkSession
    path = new_path(spark, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Deletes the files of a table() that nothing reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for file in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(file)
        while path.getParent().getName() != "vecforest":  # the folder of new_path(), above those of a column
            path = path.getParent()
        path.getFileSystem(conf).delete(path, True)


def whole_text(name: str) -> Column:
    """The text as a string; null counts as empty."""
    small_batches(SparkSession.active())
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def text_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Only the columns an operator needs, so that other columns' names cannot clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"), *keep)


def row_key(id_col: Column | str, text_col: str) -> Column:
    """A 128-bit key of a row's id and text, by which spans, scores and decisions find their rows again."""
    number = F.coalesce((F.col(id_col) if isinstance(id_col, str) else id_col).cast("string"), F.lit(""))
    return F.substring(F.unhex(F.sha2(F.concat_ws("|", number, F.coalesce(F.col(text_col).cast("string"), F.lit(""))), 256)), 1, 16)


def quoted(name: str) -> str:
    """A column's name as an expression, whatever signs it holds."""
    return "`" + name.replace("`", "``") + "`"


def kept_row(keep: tuple[str, ...]) -> Column:
    """The kept columns in one struct, whatever their names; one field `_` where nothing is kept."""
    return F.struct(*[F.col(quoted(c)) for c in keep]) if keep else F.struct(F.lit(0).alias("_"))


def with_row(fields: str, rows: DataFrame) -> T.StructType:
    """A schema of fields and the struct of kept columns, whatever their names."""
    return T.StructType([*T.StructType.fromDDL(fields).fields, rows.schema["row"]])


def filter_size(n: int) -> tuple[int, int]:
    """Shards of a filter over n rows, and bitmaps of a shard: 16 to 32 bits a row at any size, both powers of two."""
    bits = 1 << max(15, (16 * max(n, 1) - 1).bit_length())
    return max(1, bits // SHARD_BITS), min(bits, SHARD_BITS) // BITMAP_BITS


def shard_of(key: Column, shards: int) -> Column:
    return F.shiftrightunsigned(key, 43).bitwiseAND(F.lit(shards - 1)).cast("int")


def filter_positions(key: Column, buckets: int) -> tuple[Column, Column, Column]:
    """Bitmap number and two bit positions of a 64-bit key."""
    return (
        key.bitwiseAND(F.lit(buckets - 1)).cast("int"),
        F.shiftrightunsigned(key, 13).bitwiseAND(F.lit(BITMAP_BITS - 1)),
        F.shiftrightunsigned(key, 28).bitwiseAND(F.lit(BITMAP_BITS - 1)),
    )


def bits_hit(keys: DataFrame, key: str, buckets: int) -> DataFrame:
    bucket, one, two = filter_positions(F.col(key), buckets)
    return keys.select(bucket.alias("bucket"), F.explode(F.array(one, two)).alias("bit"))


def repeated_filter(keys: DataFrame, key: str, buckets: int) -> DataFrame:
    """First pass: a blocked Bloom filter of the keys that may stand in two or more rows.

    A bit is set where two or more rows hit it, so each repeated key has both its
    bits set. Only (bitmap, bit) pairs are shuffled, summed before the shuffle.
    """
    hit = bits_hit(keys, key, buckets).groupBy("bucket", "bit").count().filter("count > 1")
    return table(hit.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")), "filter")


def may_repeat(rows: DataFrame, key: str, bitmaps: DataFrame, buckets: int, flag: str) -> DataFrame:
    """Second pass: adds a flag that is true for each row whose key may be repeated. The bitmaps are one shard, at most SHARD_BITS, and are broadcast."""
    bucket, one, two = filter_positions(F.col(key), buckets)
    bit = lambda p: F.expr(f"coalesce(getbit(cast(conv(hex(substring(__bits, cast({p} div 8 as int) + 1, 1)), 16, 10) as bigint), cast({p} % 8 as int)), 0) = 1")
    bitmaps = bitmaps.select(F.col("bucket").alias("__bucket"), F.col("bits").alias("__bits"))
    return (
        rows.withColumns({"__b": bucket, "__one": one, "__two": two})
        .join(F.broadcast(bitmaps), F.col("__b") == F.col("__bucket"), "left")
        .withColumn(flag, bit("__one") & bit("__two"))
        .drop("__b", "__one", "__two", "__bucket", "__bits")
    )


def union_of(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def flagged(rows: DataFrame, key: str, keys: DataFrame, size: tuple[int, int], first_pass: Callable[[DataFrame, str, int], DataFrame], flag: str) -> DataFrame:
    """Adds a flag to rows by a filter over a table with a column __key, one shard after another.

    A shard of the filter holds a share of the hash range, so its bits a row stay
    constant however many rows there are; a row is tested in its own shard only.
    """
    shards, buckets = size
    out = []
    for s in range(shards):
        mine = lambda df, c: df if shards == 1 else df.filter((F.col("shard") if "shard" in df.columns else shard_of(F.col(c), shards)) == s)  # noqa: B023, E731
        out.append(may_repeat(mine(rows, key), key, first_pass(mine(keys, "__key"), "__key", buckets), buckets, flag))
    return union_of(out)


def member_filter(keys: DataFrame, key: str, buckets: int) -> DataFrame:
    """A blocked Bloom filter of a table's 64-bit keys, for may_repeat()."""
    return bits_hit(keys, key, buckets).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def split_by(rows: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose key may be among the keys, and the rest, by a filter instead of a shuffle of the rows."""
    hashed = keys.select(F.xxhash64(key).alias("__key"))
    found = flagged(rows.withColumn("__key", F.xxhash64(key)), "__key", hashed, filter_size(hashed.count()), member_filter, "__may").drop("__key")
    return found.filter("__may").drop("__may"), found.filter("not __may").drop("__may")
