"""The published catalogue: shards of documents and edges, an index, a manifest, and graphs as tables."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vecforest.functions.scalars import fnv1a32, short_label
from vecforest.sources.tables import materialize

ROWS_A_CHUNK = 32


def chunk_numbers(docs: DataFrame, order: str, rows: int = ROWS_A_CHUNK) -> DataFrame:
    """Adds the position of each document, its rank in the order from 0, and its chunk: the position over `rows`.

    The range sort is written once, as its bounds are sampled anew whenever it runs;
    places within partitions and the partitions' counts then come from the same sort.
    """
    part = docs.repartitionByRange(order).sortWithinPartitions(order).withColumn("__at", F.monotonically_increasing_id())
    part = materialize(part.withColumns({"__part": F.shiftright("__at", 33).cast("int"), "__at": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))}))
    before = F.sum("count").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1))  # one row per partition
    base = part.groupBy("__part").count().select("__part", F.coalesce(before, F.lit(0)).alias("__base"))
    return part.join(base, "__part").withColumn("position", F.col("__base") + F.col("__at")).withColumn("chunk", F.floor(F.col("position") / rows).cast("long")).drop("__part", "__at", "__base")


def page_slice(df: DataFrame, order: str, page: int, rows: int) -> DataFrame:
    return df.orderBy(order).offset(page * rows).limit(rows)


def catalog_edges(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each edge with the one chunk that holds it: that of its source if it has one, else of its target."""
    c = chunks.select("doc_id", "chunk")
    return (
        edges.join(c.select(F.col("doc_id").alias("src"), F.col("chunk").alias("a")), "src", "left").join(c.select(F.col("doc_id").alias("dst"), F.col("chunk").alias("b")), "dst", "left")
        .select("src", "dst", "score", F.coalesce("a", "b").alias("chunk"))
    )


#: The fields of a record that its row in the index holds, where the record has them.
INDEX_FIELDS = ("id", "title", "text", "date", "event_date", "published_date", "category", "topic", "vendor", "model_name", "evidence_category", "verification_status", "inWindow")


def catalog_index(chunks: DataFrame, members: DataFrame, title: str = "text", fields: tuple[str, ...] = INDEX_FIELDS) -> DataFrame:
    """A row for each document: its position in the original order, node, parent, chunk, label, facets and those of the fields that it has."""
    held = [c for c in fields if c in chunks.columns]
    facets = [c for c in ("lang", "source") if c in chunks.columns and c not in held]
    return chunks.join(members, "doc_id", "left").select("doc_id", "position", F.concat(F.lit("text:"), F.col("doc_id").cast("string")).alias("node"), F.col("path").alias("parent"), "chunk", short_label(F.col(title)).alias("label"), *facets, *held)


def catalog_manifest(edges: DataFrame) -> DataFrame:
    """Edge counts by type."""
    return edges.groupBy("type").agg(F.count("*").alias("n"))


def topic_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the manifest holds of a graph: nodes that are no texts, and edges (src, dst, type) between two of them, tree edges included."""
    topics = nodes.filter("kind <> 'text'")
    tree = topics.filter("parent is not null").select(F.col("parent").alias("src"), F.col("node").alias("dst"), F.lit("tree").alias("type"))
    every = tree.unionByName(edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "type"))
    ends = topics.select("node")
    return topics, every.join(ends.withColumnRenamed("node", "src"), "src", "left_semi").join(ends.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst", "type")


def by_chunk(df: DataFrame) -> DataFrame:
    return df.repartitionByRange("chunk").sortWithinPartitions("chunk")


def write_catalog(docs: DataFrame, edges: DataFrame, members: DataFrame, path: str, order: str = "doc_id") -> None:
    """Documents and edges in files sorted by chunk: a chunk is found by the files' least and greatest values, without a folder for each."""
    by_chunk(chunk_numbers(docs, order)).write.mode("overwrite").parquet(f"{path}/documents")
    chunks = docs.sparkSession.read.parquet(f"{path}/documents")
    by_chunk(catalog_edges(edges, chunks)).write.mode("overwrite").parquet(f"{path}/edges")
    catalog_index(chunks, members).write.mode("overwrite").parquet(f"{path}/index")


def read_catalog(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The documents of a catalogue; with ids only the chunks that the index names are read."""
    docs = spark.read.parquet(f"{path}/documents")
    if doc_ids is None:
        return docs
    chunks = [r.chunk for r in spark.read.parquet(f"{path}/index").filter(F.col("doc_id").isin(doc_ids)).select("chunk").distinct().collect()]
    return docs.filter(F.col("chunk").isin(chunks) & F.col("doc_id").isin(doc_ids))


def write_graph(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_graph(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def save_snapshot(tables: dict[str, DataFrame], path: str, at: datetime | None = None) -> str:
    """Writes all tables under a new version and its time last, so that a half-written version is never the newest."""
    at = at or datetime.now(timezone.utc)
    version = at.strftime("%Y%m%dT%H%M%S%fZ")
    write_graph(tables, f"{path}/versions/{version}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(version, at.isoformat())], "version string, saved_at string").coalesce(1).write.mode("append").parquet(f"{path}/saved")
    return version


def load_snapshot(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    newest = spark.read.parquet(f"{path}/saved").agg(F.max("version").alias("v")).first().v
    return read_graph(spark, f"{path}/versions/{newest}", names)


def scope_chunk(role, scope_id):
    """The shard key of a scope: its role and a hash of its id."""
    return F.concat(role, F.lit("-"), F.lower(F.hex(fnv1a32(scope_id))))


def write_scopes(scopes: DataFrame, path: str) -> None:
    by_chunk(scopes.withColumn("chunk", scope_chunk(F.col("role"), F.col("scope_id")))).write.mode("overwrite").parquet(path)
