"""Records in the common form, their checks, and search over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecforest.functions.scalars import has_content


def blank_to_null(c: Column) -> Column:
    return F.nullif(c.cast("string"), F.lit(""))


def normalize_documents(df: DataFrame, id_col: str = "id", title: str = "title", text: str = "text", summary: str = "summary", category: str = "category", position: str = "position", entities: str = "entities", bare: str = "bare") -> DataFrame:
    """Defaults of the common record form: doc_id, title, text, summary, category, entities.

    The id falls back to doc-<position>, the title to the text's first 60
    characters and then to a numbered name, the text to summary, text, title and
    then nothing, the category to `uncategorized`. Entities are made texts, an empty list
    where there are none. A row with a text in the column `bare` is a record that is only
    that text: its title is the first 60 characters.
    """
    have = set(df.columns)
    get = lambda c: blank_to_null(F.col(c)) if c in have else F.lit(None).cast("string")
    alone = get(bare)
    listed = F.col(entities).cast("array<string>") if entities in have else F.lit(None).cast("array<string>")
    body = F.coalesce(alone, get(summary), get(text), get(title), F.lit(""))
    number = F.col(position).cast("long")
    return df.select(
        F.coalesce(get(id_col), F.concat(F.lit("doc-"), number.cast("string"))).alias("doc_id"),
        F.coalesce(alone.substr(1, 60), get(title), get(text).substr(1, 60), F.concat(F.lit("文本 "), (number + 1).cast("string"))).alias("title"),
        body.alias("text"), body.alias("summary"), F.coalesce(get(category), F.lit("uncategorized")).alias("category"), F.coalesce(listed, F.array().cast("array<string>")).alias("entities"),
    )


def event_date(event: Column, day: Column) -> Column:
    """The event's date if there is one, else the record's."""
    return F.coalesce(event, day)


def record_date(record: Column) -> Column:
    """The date of a record in JSON (variant): that of the event if it has one, else its own, and only if the value chosen is a text."""
    at = lambda p: F.try_variant_get(record, p, "variant")
    there = lambda v: F.when(~F.is_variant_null(v), v)
    chosen = F.coalesce(there(at("$.event_date")), there(at("$.date")))
    return F.when(F.schema_of_variant(chosen) == "STRING", F.try_variant_get(chosen, "$", "string"))


def clean_sources(items: Column) -> Column:
    """Of structs (title, name, url): those with a url, titled by title, name or url; of equal urls the first."""
    with_url = F.filter(items, lambda s: s["url"].isNotNull())
    titled = F.transform(with_url, lambda s: F.struct(F.coalesce(s["title"], s["name"], s["url"]).alias("title"), s["url"].alias("url")))
    urls = F.transform(titled, lambda s: s["url"])
    return F.filter(titled, lambda s, i: F.array_position(urls, s["url"]) == i + 1)


def explode_sources(df: DataFrame, id_col: str, sources: str, limit: int = 6) -> DataFrame:
    """One row per web source, numbered from 0, at most `limit` a document: the feature is a short list."""
    web = F.filter(F.col(sources), lambda s: s["url"].rlike("^https?://"))
    return df.select(id_col, F.posexplode(F.slice(web, 1, limit)).alias("index", "s")).select(id_col, "index", "s.title", "s.url")


def facet_filter(df: DataFrame, window: Column | None = None, evidence: tuple[Column, str] | None = None, vendor: tuple[Column, str] | None = None) -> DataFrame:
    rules = [window] if window is not None else []
    rules += [evidence[0] == evidence[1]] if evidence else []
    rules += [vendor[0].contains(vendor[1])] if vendor else []
    return df.filter(reduce(lambda a, b: a & b, rules, F.lit(True)))


def matches_query(query: str, *fields: Column) -> Column:
    """Whether the lower-case fields, joined by blanks, hold the lower-case query."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields])).contains(query.strip().lower())


def keyword_search(df: DataFrame, query: str, fields: list[Column], order: str, limit: int = 150) -> DataFrame:
    """The first matches by id with the number of all matches; only the page is sorted."""
    found = df.filter(matches_query(query, *fields))
    total = found.agg(F.count("*").alias("total"))
    return found.orderBy(order).limit(limit).crossJoin(F.broadcast(total))  # total is one row


def normalize_themes(df: DataFrame) -> DataFrame:
    return df.filter("title is not null").withColumn("theme_id", F.coalesce("theme_id", "title"))


def record_violations(df: DataFrame, id_col: str = "doc_id", *fields: str) -> DataFrame:
    """(doc_id, rule): no content, no id, or an id that is repeated."""
    key = F.col(id_col).cast("string")
    rows = df.select(key.alias("doc_id"), has_content(*[F.col(f) for f in fields or ("text",)]).alias("filled"))
    return (
        rows.filter("not filled").select("doc_id", F.lit("empty").alias("rule"))
        .unionByName(rows.filter("doc_id is null or trim(doc_id) = ''").select("doc_id", F.lit("no id").alias("rule")))
        .unionByName(id_violations(rows, "doc_id").select("doc_id", F.lit("repeated id").alias("rule")))
    )


def id_violations(df: DataFrame, id_col: str) -> DataFrame:
    return df.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("n")).filter("n > 1")
