"""Import of many files: duplicates, conflicts and reports, by file and record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecforest.operators.stats import ranks
from vecforest.sources.tables import materialize


def dedupe_files(files: DataFrame) -> DataFrame:
    """Files (path, hash): the first path of each content, and how many other paths it has. file_aliases() lists these."""
    return files.select("path", "hash").distinct().groupBy("hash").agg(F.min("path").alias("path"), (F.count("*") - 1).alias("aliases"))


def file_aliases(files: DataFrame) -> DataFrame:
    """(path, alias): every further path of a content, with its first path; one row for each, as a content may have any number of paths."""
    first = materialize(files.groupBy("hash").agg(F.min("path").alias("path")))
    return files.select("hash", F.col("path").alias("alias")).distinct().join(first, "hash").filter("alias <> path").select("path", "alias")


def dedupe_records(records: DataFrame) -> DataFrame:
    """Records (file, position, hash, ...): the first of equal bodies in a file, and how many there are; equal bodies of different files stay. mark_duplicates() has all positions."""
    groups = materialize(records.groupBy("file", "hash").agg(F.min("position").alias("position"), F.count("*").alias("copies")))
    rest = [c for c in records.columns if c not in ("file", "hash", "position")]
    return groups.join(records.select("file", "position", *rest), ["file", "position"])


def mark_duplicates(records: DataFrame) -> DataFrame:
    """Adds the number of each record among those of its file with the same body, from 1.

    One range sort by file, body and position numbers all records, and what stands before
    a body in a partition is carried, so a body that fills a file is spread over tasks.
    """
    body = F.concat_ws("|", F.xxhash64("file").cast("string"), F.coalesce("hash", F.lit("")), F.coalesce("file", F.lit("")))
    return ranks(records.withColumn("g", body), ["position"], "copy").withColumn("copy", F.col("copy") + 1).drop("g")


def key_conflicts(records: DataFrame) -> DataFrame:
    """Keys that stand for several bodies in one file."""
    return records.groupBy("file", "key").agg(F.count_distinct("hash").alias("bodies")).filter("bodies > 1")


def path_conflicts(files: DataFrame) -> DataFrame:
    """Paths that stand for several contents."""
    return files.groupBy("path").agg(F.count_distinct("hash").alias("contents")).filter("contents > 1")


def vector_conflicts(records: DataFrame) -> DataFrame:
    """Equal bodies of a file whose vectors differ."""
    return records.groupBy("file", "hash").agg(F.count_distinct("vector_hash").alias("vectors")).filter("vectors > 1")


def import_report(records: DataFrame, max_records: int = 20_000) -> DataFrame:
    """Per file: records, distinct bodies, duplicates, and whether it is over the limit, which is reported and cuts nothing."""
    return records.groupBy("file").agg(F.count("*").alias("records"), F.count_distinct("hash").alias("unique_records")).select(
        "file", "records", "unique_records", (F.col("records") - F.col("unique_records")).alias("duplicates"), (F.col("records") > max_records).alias("over_limit")
    )


#: What one import may hold, where it is one person's: files, bytes and records. Reported, never cut.
LIMITS = {"files": 2000, "bytes": 40 << 20, "records": 20_000}


def file_report(files: DataFrame, records: DataFrame) -> DataFrame:
    """Per file (path, bytes, hash, status) with its records (file, hash): path, bytes, status, duplicate_of, records, unique_records, duplicates.

    Of files with equal contents the first path counts, the others are duplicates of it
    and bring no records. A file with another status than ready keeps it.
    """
    first = materialize(files.filter("status = 'ready'").groupBy("hash").agg(F.min("path").alias("first")))
    met = files.join(first, "hash", "left")
    again = (F.col("status") == "ready") & (F.col("path") != F.col("first"))
    met = met.select("path", "bytes", F.when(again, "duplicate").otherwise(F.col("status")).alias("status"), F.when(again, F.col("first")).alias("duplicate_of"))
    held = records.groupBy(F.col("file").alias("path")).agg(F.count("*").alias("records"), F.count_distinct("hash").alias("unique_records"))
    count = lambda c: F.when(F.col("status") == "ready", F.coalesce(c, F.lit(0))).otherwise(0).cast("long")
    out = met.join(held, "path", "left").select("path", "bytes", "status", "duplicate_of", count("records").alias("records"), count("unique_records").alias("unique_records"))
    return out.withColumn("duplicates", F.col("records") - F.col("unique_records"))


def import_totals(report: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """One row over a file_report(): files, bytes, records, unique_records, duplicates, duplicate_files, failed_files, the limits passed, and the status: ok, or what stands against the import."""
    limits = LIMITS | (limits or {})
    total = report.agg(
        F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("unique_records"), F.lit(0)).alias("records"), F.coalesce(F.sum("duplicates"), F.lit(0)).alias("duplicates"),
        F.count_if(F.col("status") == "duplicate").alias("duplicate_files"), F.count_if(F.col("status") == "error").alias("failed_files"),
    )
    over = F.filter(F.array(*[F.when(F.col(c) > most, c) for c, most in limits.items()]), lambda c: c.isNotNull())
    status = F.when(F.col("files") == 0, "no files").when(F.size("over") > 0, "over limits").when(F.col("failed_files") > 0, "failed files").otherwise("ok")
    return total.withColumn("over", over).withColumn("status", status)


def dataset_warnings(records: DataFrame, declared: DataFrame) -> DataFrame:
    """Per file: declared and found number of records, and how many lie outside the window; files in order are left out."""
    found = records.groupBy("file").agg(F.count("*").alias("found"), F.count_if(F.col("in_window") == F.lit(False)).alias("outside"))
    return declared.join(found, "file", "left").fillna(0, ["found", "outside"]).filter("declared <> found or outside > 0")


def vectors_compatible(files: DataFrame) -> DataFrame:
    """One row: whether all files have vectors, of one signature."""
    return files.agg(F.coalesce(F.bool_and("has_vectors") & (F.count_distinct("signature") == 1), F.lit(False)).alias("compatible"), F.count_distinct("signature").alias("signatures"))


def reconcile_manifest(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest entries (directory, file, count, bytes) against files (path, records, bytes): entries with a fault."""
    path = F.concat(F.col("directory"), F.when(F.col("directory") == "", "").otherwise("/"), F.col("file"))
    met = entries.withColumn("path", path).join(files.select("path", "records", F.col("bytes").alias("found_bytes")), "path", "left")
    fault = F.when(F.col("records").isNull(), "missing").when(F.col("records") != F.col("count"), "count").when(F.col("found_bytes") != F.col("bytes"), "bytes")
    return met.select("path", fault.alias("fault")).filter("fault is not null")


def verify_checksums(files: DataFrame, pinned: DataFrame) -> DataFrame:
    """Files (path, bytes, sha256) against pinned values: path and fault."""
    met = pinned.select("path", F.col("bytes").alias("b"), F.col("sha256").alias("s")).join(files, "path", "full")
    fault = F.when(F.col("sha256").isNull(), "missing").when(F.col("s").isNull(), "not pinned").when((F.col("b") != F.col("bytes")) | (F.col("s") != F.col("sha256")), "changed")
    return met.select("path", fault.alias("fault")).filter("fault is not null")


def same_ids(a: DataFrame, b: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids that only one of two tables has, with multiplicity: id, side."""
    x, y = a.select(id_col), b.select(id_col)
    return x.exceptAll(y).withColumn("side", F.lit("left")).unionByName(y.exceptAll(x).withColumn("side", F.lit("right")))
