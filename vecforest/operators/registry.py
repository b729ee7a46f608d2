"""Curated records over original ones, and checks of their evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CATEGORIES = ("官方公告", "权威报道", "社区讨论", "未证实观点")
DEFAULTS = {"evidence": "未证实观点", "verification": "legacy-unverified"}


def overlay(original: DataFrame, curated: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Originals with the values of curated rows of the same key and defaults elsewhere; the replaced row stays as legacy_record. Curated rows without an original are appended."""
    legacy = F.struct(*[F.col(c) for c in original.columns])
    c = curated.select(key, *[F.col(v).alias(f"new_{v}") for v in values], F.lit(True).alias("hit"))
    met = original.withColumn("legacy", legacy).join(c, key, "left")
    fill = lambda v: F.coalesce(F.col(f"new_{v}"), F.col(v) if v in original.columns else F.lit(DEFAULTS.get(v)))
    top = met.select(key, *[fill(v).alias(v) for v in values], F.when(F.col("hit"), F.to_json("legacy")).alias("legacy_record"))
    new = curated.join(original.select(key), key, "left_anti").select(key, *values, F.lit(None).cast("string").alias("legacy_record"))
    return top.unionByName(new)


def registry_summary(df: DataFrame) -> DataFrame:
    """Counts of an overlaid table (day, verification, legacy_record) in one row."""
    return df.agg(
        F.count("*").alias("items"), F.count_if(F.col("legacy_record").isNotNull()).alias("replaced"), F.count_if(F.col("day").isNotNull()).alias("dated"),
        F.count_if(F.col("day").isNull()).alias("undated"), F.count_if(F.col("verification") == "verified").alias("verified"), F.min("day").alias("first_day"), F.max("day").alias("last_day"),
    )


def evidence_audit(events: DataFrame) -> DataFrame:
    """Events (event_key, verification, sources array<struct<url, category>>): sources and distinct hosts of each verification status."""
    each = events.select("event_key", "verification", F.explode_outer("sources").alias("s"))
    return each.groupBy("verification").agg(F.count_distinct("event_key").alias("events"), F.count("s.url").alias("sources"), F.count_distinct(F.parse_url("s.url", F.lit("HOST"))).alias("hosts"), F.count_if(F.col("s.url").isNull()).alias("without_source"))


def evidence_lists(events: DataFrame, listed: tuple[str, ...] = ("partial", "unresolved")) -> DataFrame:
    """(verification, event_key, url): the sources of events that are verified in part or not at all, one row for each; an event without sources has one with a null url."""
    return events.filter(F.col("verification").isin(*listed)).select("verification", "event_key", F.explode_outer("sources").alias("s")).select("verification", "event_key", "s.url")


def evidence_violations(events: DataFrame, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """(event_key, rule) over rows (event_key, category, published, limitations, sources)."""
    good = F.exists("sources", lambda s: s["url"].rlike("^https?://") & s["category"].isNotNull())
    rules = F.array(
        F.when(~F.coalesce(F.col("category").isin(*categories), F.lit(False)), "category"), F.when(F.col("published").isNull(), "published"),
        F.when(F.coalesce(F.trim("limitations"), F.lit("")) == "", "limitations"), F.when(~F.coalesce(good, F.lit(False)), "sources"),
    )
    one = events.select("event_key", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"))
    twice = events.groupBy("event_key").count().filter("count > 1").select("event_key", F.lit("repeated").alias("rule"))
    return one.unionByName(twice)
