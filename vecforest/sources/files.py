"""Many JSON files, vectors in NPY files, saved graphs and lists of source files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecforest.functions.scalars import article_date, canonical_json, flatten_text, sha256_hex, uri_component


def read_json_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file below a folder: path, bytes, text, doc (variant), sha256, canonical, format, status. A file that is no JSON is a row with the status error."""
    raw = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
    text = F.regexp_replace("value", "^﻿", "")
    rows = raw.select("path", "bytes", text.alias("text")).withColumn("doc", F.try_parse_json("text"))
    form = identify_format(F.col("doc"))
    return rows.select("path", "bytes", "text", "doc", sha256_hex(F.col("text")).alias("sha256"), sha256_hex(canonical_json(F.col("text"))).alias("canonical"), form.alias("format"), F.when(form.isNull(), "error").when(form == "manifest", "manifest").otherwise("ready").alias("status"))


def identify_format(doc: Column) -> Column:
    """The kind of a JSON document by its shape; the first that fits."""
    has = lambda p: F.try_variant_get(doc, p, "variant").isNotNull()
    is_list = lambda p: F.schema_of_variant(F.try_variant_get(doc, p, "variant")).startswith("ARRAY")
    meta = lambda k: has(f"$.meta.{k}")
    return (
        F.when(doc.isNull(), None).when(F.coalesce(is_list("$.files"), F.lit(False)), "manifest").when(F.coalesce(is_list("$.nodes") & is_list("$.edges"), F.lit(False)), "graph")
        .when(has("$.overview_cards") | has("$.deep_dive_analysis") | has("$.briefing_flash"), "briefing").when(F.schema_of_variant(doc).startswith("ARRAY"), "array")
        .when(has("$.items") & meta("saved_at"), "timestamp-items").when(has("$.items") & meta("part"), "corpus-items").when(has("$.items"), "items").when(has("$.texts"), "texts").when(has("$.records"), "records")
    )


ITEM = "id string, title string, text string, summary string, full_content string, date string, event_date string, published string, category string, url string, discussion_url string, sources array<struct<title:string,name:string,url:string>>"


def adapt_items(files: DataFrame) -> DataFrame:
    """Records of item, text, record and plain list files: links become sources, full content follows the summary, which is kept."""
    field = F.when(F.col("format") == "array", F.col("text")).when(F.col("format") == "texts", F.get_json_object("text", "$.texts")).when(F.col("format") == "records", F.get_json_object("text", "$.records")).otherwise(F.get_json_object("text", "$.items"))
    rows = files.filter(F.col("format").isin("array", "items", "timestamp-items", "corpus-items", "texts", "records")).select("path", field.alias("list"))
    each = rows.select("path", F.posexplode(F.from_json("list", "array<string>")).alias("position", "item"))
    item = F.from_json("item", ITEM)
    met = each.withColumn("r", F.when(F.col("item").startswith("{"), item))
    link = lambda c, t: F.when(F.col(c).isNotNull(), F.struct(F.lit(t).alias("title"), F.lit(None).cast("string").alias("name"), F.col(c).alias("url")))
    links = F.filter(F.concat(F.coalesce("r.sources", F.array().cast("array<struct<title:string,name:string,url:string>>")), F.array(link("r.url", "url"), link("r.discussion_url", "discussion"))), lambda s: s.isNotNull())
    plain = F.when(F.col("r").isNull(), F.col("item"))
    summary = F.coalesce("r.summary", "r.text", plain)
    body = F.when(F.col("r.full_content").isNotNull(), F.concat_ws("\n\n", summary, "r.full_content")).otherwise(summary)
    day = F.coalesce("r.event_date", "r.date", article_date(F.col("r.published")))
    return met.select("path", "position", F.col("r.id").alias("id"), F.coalesce("r.title", plain.substr(1, 60)).alias("title"), body.alias("text"), F.when(F.col("r.full_content").isNotNull(), F.col("r.summary")).alias("original_summary"), day.alias("date"), F.col("r.category").alias("category"), links.alias("sources"))


def adapt_briefing(files: DataFrame) -> DataFrame:
    """Records of daily briefings: cards, analyses and flashes, each a document. The time of making is never a document's date."""
    rows = files.filter("format = 'briefing'")
    part = lambda name: rows.select("path", F.lit(name).alias("section"), F.posexplode(F.from_json(F.get_json_object("text", f"$.{name}"), "array<string>")).alias("position", "item"))
    each = part("overview_cards").unionByName(part("deep_dive_analysis")).unionByName(part("briefing_flash"))
    get = lambda k: F.get_json_object("item", f"$.{k}")
    lines = F.concat_ws("\n\n", *[F.nullif(flatten_text(_as_json(get(k))), F.lit("")) for k in ("evolution_and_updates", "perspectives", "long_term_impact")])
    text = F.when(F.col("section") == "deep_dive_analysis", lines).otherwise(F.coalesce(get("summary"), get("headline"), get("title")))
    return each.select("path", "section", "position", get("id").alias("id"), F.coalesce(get("title"), get("topic"), get("headline")).alias("title"), text.alias("text"), get("category").alias("category"), F.lit(None).cast("string").alias("date"))


def _as_json(c: Column) -> Column:
    """get_json_object gives texts without quotes; they get them back, in a list of one."""
    return F.when(c.rlike(r"^\s*[\[{]"), c).otherwise(F.to_json(F.array(c)))


def local_ids(records: DataFrame, section: str | None = None) -> DataFrame:
    """Adds doc_id: file, section and the record's id, or a hash of its text where it has none."""
    key = F.coalesce(F.col("id"), F.concat(F.lit("sha256-"), sha256_hex(F.coalesce("text", F.lit("")))))
    key = F.concat(F.col(section), F.lit("/"), key) if section else key
    return records.withColumn("doc_id", F.concat(F.lit("local:"), uri_component(F.col("path")), F.lit(":"), uri_component(key)))


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of files, by name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def select_source_files(listing: DataFrame, mode: str, path: str, base: str) -> DataFrame:
    """JSON blobs of a listing (type, path, size): the one path (blob), or those below it (tree), with a pinned address."""
    json = listing.filter((F.col("type") == "blob") & F.col("path").rlike(r"\.json$"))
    mine = json.filter(F.col("path") == path) if mode == "blob" else json.filter(F.col("path").startswith(path.rstrip("/") + "/")) if path else json
    parts = F.transform(F.split("path", "/"), uri_component)
    return mine.select("path", "size", F.concat(F.lit(base.rstrip("/") + "/"), F.array_join(parts, "/")).alias("url"))


def synthetic_corpus(spark: SparkSession, n: int, dims: int = 64, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """n unit vectors around eight axes. Row i takes its numbers from place i * dims of one linear congruential sequence, so partitions do not depend on each other."""
    a, c, m = 1664525, 1013904223, 1 << 32

    def jump(steps: int) -> tuple[int, int]:
        mul, add, x, y = 1, 0, a, c
        while steps:
            if steps & 1:
                mul, add = x * mul % m, (x * add + y) % m
            x, y, steps = x * x % m, (x * y + y) % m, steps >> 1
        return mul, add

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i in batch["id"]:
                mul, add = jump(int(i) * dims)
                s = (mul * seed + add) % m
                v = np.empty(dims)
                for j in range(dims):
                    s = (a * s + c) % m
                    v[j] = (3 if j == i % 8 else 0) + s / m - 0.5
                out.append(v / np.linalg.norm(v))
            yield pd.DataFrame({"doc_id": batch["id"], "vector": out})

    return spark.range(0, n, 1, partitions).mapInPandas(run, "doc_id long, vector array<double>")
