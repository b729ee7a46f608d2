"""Text, date, link and JSON functions as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys of an embedding configuration that belong to one run and say nothing about the vectors.
RUN_KEYS = ("inputSha256", "generatedAt", "durationMs", "reusedRows", "computedRows", "uniqueInputs", "gpuAdapter")


def article_date(s: Column) -> Column:
    """The leading YYYY-MM-DD of a text if it is a real day and ends there, at T or at a blank."""
    day = F.regexp_extract(s, r"^(\d{4}-\d{2}-\d{2})(?:$|[T ])", 1)
    return F.when(F.try_to_date(day, "yyyy-MM-dd").isNotNull(), day)


def in_window(day: Column, start: Column, end: Column) -> Column:
    """Whether a date text lies between two others; null if any is missing."""
    return F.when(day.isNotNull() & start.isNotNull() & end.isNotNull(), (day >= start) & (day <= end))


def sha256_hex(s: Column) -> Column:
    return F.sha2(s, 256)


def fnv1a32(s: Column) -> Column:
    """32-bit FNV-1a over code points."""
    codes = F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.ascii(s.substr(i, F.lit(1))).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * 16777619).bitwiseAND(F.lit(4294967295)))


def uri_component(s: Column) -> Column:
    """Percent-encoding that leaves letters, digits and -_.!~*'() as they are."""
    out = F.url_encode(s)
    for old, new in (("+", "%20"), ("%21", "!"), ("%7E", "~"), ("%27", "'"), ("%28", "("), ("%29", ")")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def doc_uri(path: Column, key: Column) -> Column:
    return F.concat(F.lit("local:"), uri_component(path), F.lit(":"), uri_component(key))


def short_label(title: Column, most: int = 22) -> Column:
    return F.when(F.length(title) > most, F.concat(title.substr(1, most - 1), F.lit("…"))).otherwise(title)


def canonical_json(s: Column) -> Column:
    """JSON with sorted keys; null where the text is no JSON or repeats a key."""
    return F.to_json(F.try_parse_json(s))


def embedding_text(title: Column, text: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit("。"), F.coalesce(text, F.lit("")))


def has_content(*fields: Column) -> Column:
    found = F.lit(False)
    for f in fields:
        found = found | (F.length(F.trim(F.coalesce(f, F.lit("")))) > 0)
    return found


def config_signature(config: Column, model: Column, dimension: Column) -> Column:
    """A configuration map without run-specific keys, with model and dimension, as sorted JSON."""
    kept = F.map_filter(config, lambda k, _: ~k.isin(*RUN_KEYS, "model", "dimension"))
    entries = F.sort_array(F.concat(F.map_entries(kept), F.array(F.struct(F.lit("model").alias("key"), model.alias("value")), F.struct(F.lit("dimension").alias("key"), dimension.cast("string").alias("value")))))
    return F.to_json(F.map_from_entries(entries))


def relative_path(path: Column, root: str | None = None) -> Column:
    """A path below the chosen folder with forward slashes; null if it is absolute or has an empty, . or .. part."""
    p = F.regexp_replace(path, r"\\", "/")
    if root:
        p = F.when(F.startswith(p, F.lit(root + "/")), p.substr(F.lit(len(root) + 2), F.length(p))).otherwise(p)
    bad = p.rlike(r"^/|^[A-Za-z]:|(^|/)(\.{1,2})?(/|$)")
    return F.when(~bad, p)


def parse_source_link(url: Column) -> Column:
    """Parts of a link to a public source: https without credentials or port; host, kind and path."""
    m = lambda g: F.regexp_extract(url, r"^https://([^/?#@:]+)(/[^?#]*)?(?:[?#].*)?$", g)
    host, path = F.lower(m(1)), F.regexp_replace(m(2), "^/", "")
    parts = F.split(path, "/")
    at = lambda i: F.nullif(F.try_element_at(parts, F.lit(i)), F.lit(""))
    kind = F.when(host == "", None).when((host == "github.com") & at(3).isin("blob", "tree"), at(3)).when((host == "github.com") & at(2).isNotNull(), "repo").when(host == "drive.google.com", "drive").otherwise("page")
    return F.struct(kind.alias("kind"), F.nullif(host, F.lit("")).alias("host"), at(1).alias("first"), at(2).alias("second"), F.nullif(path, F.lit("")).alias("path"))


def source_parts(url: Column) -> Column:
    """Where a public source lies: kind (github or drive), owner, repo, mode (tree or blob), ref and path, or id and folder; null for any other link.

    Only https without credentials or port. A repository's name loses its .git; a tree
    needs a ref, a blob a path as well; a drive link needs the id of a file or folder.
    """
    m = lambda g: F.regexp_extract(F.trim(url), r"^https://([^/?#@:]+)(/[^?#]*)?(\?[^#]*)?(?:#.*)?$", g)
    host = F.lower(m(1))
    parts = F.transform(F.filter(F.split(m(2), "/"), lambda p: p != ""), lambda p: F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))))
    at = lambda i: F.try_element_at(parts, F.lit(i))
    repo = F.regexp_replace(at(2), r"\.git$", "")
    mode = at(3)
    named = at(1).rlike(r"^[\w.-]+$") & repo.rlike(r"^[\w.-]+$")
    whole = mode.isNull() | (mode.isin("tree", "blob") & (F.size(parts) >= F.when(mode == "blob", 5).otherwise(4)))
    github = (host == "github.com") & F.coalesce(named & whole, F.lit(False)) & F.forall(parts, lambda p: p.isNotNull())
    after = lambda word: F.try_element_at(parts, (F.array_position(parts, F.lit(word)) + 1).cast("int"))
    folder = F.coalesce(F.array_contains(parts, F.lit("folders")), F.lit(False))
    number = F.when(folder, after("folders")).when(F.array_contains(parts, F.lit("d")), after("d")).otherwise(F.regexp_extract(m(3), r"[?&]id=([^&]*)", 1))
    drive = host.isin("drive.google.com", "docs.google.com") & F.coalesce(number.rlike(r"^[\w-]+$"), F.lit(False))
    empty = F.lit(None).cast("string")
    git = F.struct(F.lit("github").alias("kind"), at(1).alias("owner"), repo.alias("repo"), mode.alias("mode"), F.coalesce(at(4), F.lit("")).alias("ref"), F.array_join(F.slice(parts, 5, 1 << 20), "/").alias("path"), empty.alias("id"), F.lit(None).cast("boolean").alias("folder"))
    own = F.struct(F.lit("drive").alias("kind"), *[empty.alias(c) for c in ("owner", "repo", "mode", "ref", "path")], number.alias("id"), folder.alias("folder"))
    return F.when(github, git).when(drive, own)


def flat(value: object) -> str:
    if value is None:
        return ""
    if isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, list):
        return "\n".join(x for x in map(flat, value) if x)
    if isinstance(value, dict):
        return "\n".join(f"{k}：{x}" for k, x in ((k, flat(v)) for k, v in value.items()) if x)
    return json.dumps(value)


def flatten_text(text: Column) -> Column:
    """Readable lines of a JSON value: texts as they are, lists by line, objects as key：value lines."""

    def one(text: str | None) -> str | None:
        try:
            return flat(json.loads(text)) if text is not None else ""
        except ValueError:
            return None

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(one)

    return F.pandas_udf(run, "string")(text)
