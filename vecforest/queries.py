"""Registered queries over the given tables, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecforest.functions import scalars as S
from vecforest.functions import vectors as V
from vecforest.operators import bridges as B
from vecforest.operators import clustering as C
from vecforest.operators import embed as E
from vecforest.operators import imports as I
from vecforest.operators import layout as L
from vecforest.operators import neighbours as H
from vecforest.operators import normalize as N
from vecforest.operators import registry as G
from vecforest.operators import relations as R
from vecforest.operators import stats as A
from vecforest.operators import topics as P
from vecforest.operators import tree as T
from vecforest.plans import catalog as K
from vecforest.plans import forest as Forest
from vecforest.sources import files as Files
from vecforest.sources import ranges as Ranges
from vecforest.sources.tables import fresh_path, read_documents, read_table, read_vectors
from vecforest.streaming import incremental as Inc

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


VSQL = "v AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS vector, CAST(label AS VARCHAR) AS leaf, CAST(label % 4 AS VARCHAR) AS root FROM embeddings)"
POS = "pos AS (SELECT doc_id, vector[1] * 225 AS x, vector[2] * 225 AS y, vector[3] * 225 AS z FROM v)"
KNN = f"""{VSQL}, p AS (SELECT a.doc_id AS src, b.doc_id AS dst, round(list_dot_product(a.vector, b.vector), 6) AS score FROM v a JOIN v b ON a.leaf = b.leaf AND a.doc_id <> b.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS k FROM p),
knn AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst, score FROM r WHERE k <= 4)"""
SUMS = f"""{VSQL}, each AS (SELECT leaf, doc_id, i AS pos, vector[i] AS x FROM (SELECT *, unnest(generate_series(1, 64)) AS i FROM v)), s AS (SELECT leaf, pos, sum(x) AS x FROM each GROUP BY ALL),
c AS (SELECT leaf, list(x / n ORDER BY pos) AS centroid FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY leaf)) AS n FROM s) GROUP BY leaf)"""
CROSS = f"""{VSQL}, cand AS (SELECT a.doc_id AS i, b.doc_id AS j, round(list_dot_product(a.vector, b.vector), 6) AS score, a.leaf AS leaf_i, b.leaf AS leaf_j
FROM v a JOIN v b ON a.doc_id < b.doc_id AND a.root <> b.root WHERE round(list_dot_product(a.vector, b.vector), 6) >= 0.3)"""
MEMBERS = "m AS (SELECT vec_id AS doc_id, 'r' || (label % 4) || '/' || label || '/system' AS path FROM embeddings)"
NODES = f"""{MEMBERS}, nodes AS (SELECT node, CASE WHEN node LIKE '%system' THEN 'leaf' WHEN node LIKE '%/%' THEN 'branch' ELSE 'root' END AS kind, len(string_split(node, '/')) - 1 AS depth, split_part(node, '/', 1) AS root,
CASE WHEN node LIKE '%/%' THEN regexp_replace(node, '/[^/]*$', '') END AS parent, count(*) AS n
FROM (SELECT unnest([split_part(path, '/', 1), split_part(path, '/', 1) || '/' || split_part(path, '/', 2), path]) AS node FROM m) GROUP BY node)"""


def vecs(s: SparkSession, d: str) -> DataFrame:
    return read_vectors(s, d)


def positions(s: SparkSession, d: str) -> DataFrame:
    return vecs(s, d).select("doc_id", *[(F.col("vector")[i] * 225).alias(c) for i, c in enumerate("xyz")])


def edges(s: SparkSession, d: str) -> DataFrame:
    return R.knn_edges(vecs(s, d), "leaf", 4)


def members(s: SparkSession, d: str) -> DataFrame:
    return vecs(s, d).select("doc_id", F.concat(F.lit("r"), "root", F.lit("/"), "leaf", F.lit("/system")).alias("path"))


def nodes(s: SparkSession, d: str) -> DataFrame:
    return T.node_table(members(s, d))


# Relations


@query(f"WITH {KNN} SELECT k.src, k.dst, k.score, d.source AS src_source FROM knn k LEFT JOIN documents d ON d.doc_id = k.src")
def knn_with_sources(s: SparkSession, d: str) -> DataFrame:
    docs = read_documents(s, d).select(F.col("doc_id").alias("src"), F.col("source").alias("src_source"))
    return edges(s, d).join(docs, "src", "left").select("src", "dst", "score", "src_source")


@query(f"WITH {KNN} SELECT src, dst, score FROM knn")
def knn_edges(s: SparkSession, d: str) -> DataFrame:
    return edges(s, d)


@query(f"""WITH {VSQL}, p AS (SELECT a.doc_id AS src, b.doc_id AS dst, round(list_dot_product(a.vector, b.vector), 6) AS score FROM v a JOIN v b ON a.root = b.root AND a.doc_id <> b.doc_id)
SELECT src, dst, score FROM p QUALIFY row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) <= 4""")
def knn_in_root(s: SparkSession, d: str) -> DataFrame:
    return R.knn(vecs(s, d), "root", 4)


@query(f"WITH {CROSS} SELECT * FROM cand")
def cross_candidates(s: SparkSession, d: str) -> DataFrame:
    return R.cross_candidates(vecs(s, d), 0.3)


@query(f"WITH {CROSS} SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY least(leaf_i, leaf_j), greatest(leaf_i, leaf_j) ORDER BY score DESC, i, j) = 1")
def best_leaf_pairs(s: SparkSession, d: str) -> DataFrame:
    return R.best_leaf_pairs(R.cross_candidates(vecs(s, d), 0.3, best_per_leaf_pair=True))


#: The greedy choice, one link after another: k numbers the links, a and b are their ends, each of which may be used `cap` times.
GREEDY = """g AS (SELECT 0::BIGINT AS k, []::VARCHAR[] AS used, false AS ok UNION ALL
SELECT o.k, CASE WHEN fits THEN used || [a, b] ELSE used END, fits FROM (SELECT o.*, used, len(list_filter(used, lambda u: u = a)) < cap AND len(list_filter(used, lambda u: u = b)) < cap AS fits FROM g JOIN o ON o.k = g.k + 1) o)"""


LINKS = f"""{POS}, short AS (SELECT cand.* FROM cand JOIN pos a ON a.doc_id = i JOIN pos b ON b.doc_id = j WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) / 225 <= 0.65 + 1e-9),
best AS (SELECT * FROM short QUALIFY row_number() OVER (PARTITION BY least(leaf_i, leaf_j), greatest(leaf_i, leaf_j) ORDER BY score DESC, i, j) = 1),
o AS (SELECT *, leaf_i AS a, leaf_j AS b, 2 AS cap, row_number() OVER (ORDER BY score DESC, i, j) AS k FROM best), {GREEDY}"""


@query(f"WITH RECURSIVE {CROSS}, {LINKS} SELECT i, j, score, leaf_i, leaf_j FROM o JOIN g USING (k) WHERE ok")
def cross_links(s: SparkSession, d: str) -> DataFrame:
    return R.cross_links(vecs(s, d), positions(s, d), 0.3, 0.65, 2)


@query("SELECT m * (m + 1) // 2 AS pairs FROM (SELECT CAST(ceil(count(*) / 64) AS BIGINT) AS m FROM embeddings)")
def cross_pruning(s: SparkSession, d: str) -> DataFrame:
    """Every pair of blocks is either compared or left out for a reason."""
    pairs = B.block_pairs(B.block_summaries(B.like_blocks(vecs(s, d), 64)), 0.3)
    return B.pruning(pairs).agg(F.sum("n").alias("pairs"))


@query()
def approximate_knn(s: SparkSession, d: str) -> DataFrame:
    return H.approximate_knn(vecs(s, d), "root", 4)


@query(f"WITH {KNN} SELECT src AS node, dst AS other, score FROM knn UNION ALL SELECT dst, src, score FROM knn")
def adjacency(s: SparkSession, d: str) -> DataFrame:
    return R.adjacency(edges(s, d))


@query(f"WITH {KNN}, {POS} SELECT src, dst, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) / 225, 6) AS length FROM knn JOIN pos a ON a.doc_id = src JOIN pos b ON b.doc_id = dst")
def link_length(s: SparkSession, d: str) -> DataFrame:
    return R.link_length(edges(s, d), positions(s, d)).select("src", "dst", F.round("length", 6).alias("length"))


@query(f"WITH {KNN}, {POS} SELECT src, dst FROM knn JOIN pos a ON a.doc_id = src JOIN pos b ON b.doc_id = dst WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) / 225 <= 0.2 + 1e-9")
def drop_long_links(s: SparkSession, d: str) -> DataFrame:
    return R.drop_long_links(edges(s, d), positions(s, d), 0.2).select("src", "dst")


@query("SELECT coalesce(d.doc_id, e.vec_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'no document' WHEN e.vec_id IS NULL THEN 'no vector' ELSE 'aligned' END AS status FROM documents d FULL JOIN embeddings e ON d.doc_id = e.vec_id")
def align_vectors(s: SparkSession, d: str) -> DataFrame:
    return R.align_vectors(read_documents(s, d), vecs(s, d))


@query("""SELECT vec_id AS doc_id, 'zero' AS rule FROM embeddings WHERE vec_id % 50 = 0 UNION ALL SELECT vec_id, 'dimension' FROM embeddings WHERE vec_id % 50 = 1
UNION ALL SELECT vec_id, 'not finite' FROM embeddings WHERE vec_id % 50 = 2""")
def vector_violations(s: SparkSession, d: str) -> DataFrame:
    v = F.col("vector")
    n = F.col("doc_id") % 50
    spoilt = F.when(n == 0, F.transform(v, lambda x: x * 0)).when(n == 1, F.slice(v, 1, 63)).when(n == 2, F.transform(v, lambda x, i: F.when(i == 5, float("nan")).otherwise(x))).otherwise(v)
    return R.vector_violations(vecs(s, d).withColumn("vector", spoilt), 64)


# Scalar functions


@query(f"""WITH {VSQL} SELECT doc_id, round(sqrt(list_dot_product(vector, vector)), 6) AS norm, round(vector[1] / sqrt(list_dot_product(vector, vector)), 6) AS first,
round(list_dot_product(vector, list_reverse(vector)) / list_dot_product(vector, vector), 6) AS cosine FROM v""")
def vector_functions(s: SparkSession, d: str) -> DataFrame:
    v = F.col("vector")
    return vecs(s, d).select("doc_id", F.round(V.norm(v), 6).alias("norm"), F.round(V.unit(v)[0], 6).alias("first"), F.round(V.cosine(v, F.reverse(v)), 6).alias("cosine"))


@query(f"""WITH {VSQL}, {POS} SELECT a.doc_id, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), 6) AS distance,
sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) <= 0.25 * 225 + 1e-6 AS short FROM pos a JOIN pos b ON b.doc_id = a.doc_id + 1""")
def distance_links(s: SparkSession, d: str) -> DataFrame:
    p = positions(s, d)
    q = p.select((F.col("doc_id") - 1).alias("doc_id"), *[F.col(c).alias(f"o{c}") for c in "xyz"])
    far = V.distance3([F.col(c) for c in "xyz"], [F.col(f"o{c}") for c in "xyz"])
    return p.join(q, "doc_id").select("doc_id", F.round(far, 6).alias("distance"), V.short_link(far, 0.25, 225).alias("short"))


@query("SELECT l_discount AS similarity, count(*) AS n, round(225 * (0.075 + sqrt(greatest(0, 2 - 2 * greatest(-1, least(1, l_discount * 20 - 1))))) * (1 - 0.4 * 0.8), 6) AS target FROM lineitem GROUP BY l_discount")
def topic_targets(s: SparkSession, d: str) -> DataFrame:
    c = F.col("similarity")
    return read_table(s, d, "lineitem").groupBy(F.col("l_discount").alias("similarity")).agg(F.count("*").alias("n")).select("similarity", "n", F.round(V.topic_target(c * 20 - 1, 0.8), 6).alias("target"))


@query("SELECT n, n * n * 4 AS dense_bytes, n * 64 * 8 AS vector_bytes, n * 4 * 12 + (n + 1) * 4 AS sparse_bytes FROM (SELECT count(*) AS n FROM embeddings)")
def memory_estimate(s: SparkSession, d: str) -> DataFrame:
    n = vecs(s, d).agg(F.count("*").alias("n"))
    return n.select("n", *[c.alias(k) for k, c in V.memory_estimate(F.col("n"), F.lit(64), 8, 4, 8).items()])


@query(r"""WITH u AS (SELECT page_id, regexp_extract(replace(url, 'http:', 'https:'), '^https://([^/?#@:]+)(/[^?#]*)?(?:[?#].*)?$', 1) AS host, regexp_replace(regexp_extract(replace(url, 'http:', 'https:'), '^https://([^/?#@:]+)(/[^?#]*)?(?:[?#].*)?$', 2), '^/', '') AS path FROM pages)
SELECT page_id, CASE WHEN host <> '' THEN 'page' END AS kind, nullif(lower(host), '') AS host, nullif(path, '') AS path, nullif(split_part(path, '/', 1), '') AS first FROM u""")
def source_links(s: SparkSession, d: str) -> DataFrame:
    link = S.parse_source_link(F.regexp_replace("url", "http:", "https:"))
    return read_table(s, d, "pages").select("page_id", link.alias("l")).select("page_id", "l.kind", "l.host", "l.path", "l.first")


@query("""WITH u AS (SELECT page_id, list_filter(string_split(regexp_replace(regexp_replace(url, '^https?://[^/]+', ''), '[?#].*$', ''), '/'), lambda p: p <> '') AS q FROM pages),
l AS (SELECT page_id, q, page_id % 5 AS k, CASE page_id % 5 WHEN 4 THEN ['d', page_id::VARCHAR] ELSE ['own-' || page_id, 'repo.x'] END AS own FROM u)
SELECT page_id, CASE k WHEN 4 THEN 'drive' ELSE 'github' END AS kind, CASE WHEN k < 4 THEN own[1] END AS owner, CASE WHEN k < 4 THEN 'repo.x' END AS repo, CASE k WHEN 1 THEN 'tree' WHEN 2 THEN 'blob' END AS mode, CASE k WHEN 0 THEN '' WHEN 3 THEN '' WHEN 4 THEN NULL ELSE 'main' END AS ref,
CASE k WHEN 1 THEN array_to_string(q, '/') WHEN 2 THEN array_to_string(q || ['a b.json'], '/') WHEN 4 THEN NULL ELSE '' END AS path, CASE WHEN k = 4 THEN page_id::VARCHAR END AS id, CASE WHEN k = 4 THEN false END AS folder FROM l""")
def source_parts(s: SparkSession, d: str) -> DataFrame:
    """Links to places in repositories, with the pages' paths, and to files of a drive."""
    tail, own = F.regexp_replace("url", "^https?://[^/]+|[?#].*$", ""), F.concat(F.lit("https://github.com/own-"), "page_id")
    k = F.col("page_id") % 5
    link = F.when(k == 0, F.concat(own, F.lit("/repo.x.git"))).when(k == 1, F.concat(own, F.lit("/repo.x/tree/main"), tail)).when(k == 2, F.concat(own, F.lit("/repo.x/blob/main"), tail, F.lit("/a%20b.json?raw=1#L1")))
    link = link.when(k == 3, F.concat(own, F.lit("/repo.x/"))).otherwise(F.concat(F.lit("https://drive.google.com/file/d/"), "page_id", F.lit("/view?usp=sharing")))
    return read_table(s, d, "pages").select("page_id", S.source_parts(link).alias("p")).select("page_id", "p.*")


@query("""SELECT event_id, '{"dimension":"64","dtype":"q8","model":"m","pooling":"' || event_type || '","updatedAt":"' || strftime(ts, '%Y-%m-%d') || '"}' AS signature FROM events""")
def config_signature(s: SparkSession, d: str) -> DataFrame:
    of_the_run = ("inputSha256", "generatedAt", "durationMs", "reusedRows", "computedRows", "uniqueInputs", "gpuAdapter")
    config = F.create_map(F.lit("pooling"), "event_type", F.lit("updatedAt"), F.col("ts").cast("date").cast("string"), F.lit("dtype"), F.lit("q8"), *[x for k in of_the_run for x in (F.lit(k), F.col("value").cast("string"))])
    return read_table(s, d, "events").select("event_id", S.config_signature(config, F.lit("m"), F.lit(64)).alias("signature"))


@query("""WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M') WHEN 2 THEN '2026-02-' || lpad(CAST(user_id % 40 AS VARCHAR), 2, '0') ELSE strftime(ts, '%Y-%m-%dx') END AS s FROM events)
SELECT event_id, CASE WHEN regexp_matches(s, '^\\d{4}-\\d{2}-\\d{2}($|[T ])') AND try_cast(left(s, 10) AS DATE) IS NOT NULL THEN left(s, 10) END AS day FROM t""".replace("\\\\", "\\"))
def article_date(s: SparkSession, d: str) -> DataFrame:
    n, day = F.col("event_id") % 4, F.date_format("ts", "yyyy-MM-dd")
    text = F.when(n == 0, day).when(n == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm")).when(n == 2, F.concat(F.lit("2026-02-"), F.lpad((F.col("user_id") % 40).cast("string"), 2, "0"))).otherwise(F.concat(day, F.lit("x")))
    return read_table(s, d, "events").select("event_id", S.article_date(text).alias("day"))


@query("SELECT event_id, 'k：' || json_extract_string(props, '$.k') AS lines FROM events")
def flatten_text(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "events").select("event_id", S.flatten_text(F.col("props")).alias("lines"))


@query("""SELECT event_id, '{"a":"' || event_type || '","k":' || json_extract_string(props, '$.k') || '}' AS canonical FROM events""")
def canonical_json(s: SparkSession, d: str) -> DataFrame:
    mixed = F.concat(F.regexp_replace("props", r"\}\s*$", ', "a": "'), F.col("event_type"), F.lit('"}'))
    return read_table(s, d, "events").select("event_id", S.canonical_json(mixed).alias("canonical"))


@query("SELECT doc_id, sha256(text) AS sha FROM documents")
def text_sha256(s: SparkSession, d: str) -> DataFrame:
    return read_documents(s, d).select("doc_id", S.sha256_hex(F.col("text")).alias("sha"))


@query("SELECT c_custkey, list_reduce(list_transform(string_split(c_name, ''), lambda c: ascii(c)::BIGINT), lambda h, c: (xor(h, c) * 16777619) & 4294967295, 2166136261::BIGINT) AS hash FROM customer")
def fnv_hash(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "customer").select("c_custkey", S.fnv1a32(F.col("c_name")).alias("hash"))


@query("SELECT doc_id, 'local:' || url_encode(source || '/ü ' || lang || '.json') || ':' || url_encode('items/' || doc_id) AS uri FROM documents")
def doc_uri(s: SparkSession, d: str) -> DataFrame:
    return read_documents(s, d).select("doc_id", S.doc_uri(F.concat("source", F.lit("/ü "), "lang", F.lit(".json")), F.concat(F.lit("items/"), F.col("doc_id").cast("string"))).alias("uri"))


@query("SELECT doc_id, CASE WHEN length(text) > 22 THEN left(text, 21) || '…' ELSE text END AS label FROM documents")
def short_label(s: SparkSession, d: str) -> DataFrame:
    return read_documents(s, d).select("doc_id", S.short_label(F.col("text")).alias("label"))


@query("SELECT doc_id, sha256(source || '。' || coalesce(text, '')) AS input FROM documents")
def embedding_text(s: SparkSession, d: str) -> DataFrame:
    return read_documents(s, d).select("doc_id", S.sha256_hex(S.embedding_text(F.col("source"), F.col("text"))).alias("input"))


# Records


@query("""WITH b AS (SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN source END AS title, CASE WHEN doc_id % 5 > 0 THEN text END AS text, CASE WHEN doc_id % 7 > 0 THEN lang ELSE '' END AS category, CASE WHEN doc_id % 4 > 0 THEN 'id' || doc_id END AS id, CASE WHEN doc_id % 11 = 0 THEN nullif(text, '') END AS bare, CASE WHEN doc_id % 6 > 0 THEN doc_id || ',' || n_chars ELSE '' END AS entities FROM documents)
SELECT coalesce(id, 'doc-' || doc_id) AS doc_id, coalesce(left(bare, 60), title, nullif(left(text, 60), ''), '文本 ' || (doc_id + 1)) AS title, sha256(coalesce(bare, nullif(text, ''), title, '')) AS text, coalesce(nullif(category, ''), 'uncategorized') AS category, entities FROM b""")
def normalize_documents(s: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    raw = read_documents(s, d).select(
        F.when(n % 4 > 0, F.concat(F.lit("id"), n.cast("string"))).alias("id"), F.when(n % 3 > 0, F.col("source")).alias("title"), F.when(n % 5 > 0, F.col("text")).alias("text"),
        F.when(n % 7 > 0, F.col("lang")).otherwise("").alias("category"), n.alias("position"), F.when(n % 11 == 0, F.col("text")).alias("bare"), F.when(n % 6 > 0, F.array(n, F.col("n_chars"))).alias("entities"),
    )
    return N.normalize_documents(raw).select("doc_id", "title", S.sha256_hex(F.col("text")).alias("text"), "category", F.array_join("entities", ",").alias("entities"))


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 'e' || strftime(o_orderdate, '%Y-%m') END, strftime(o_orderdate, '%Y-%m-%d')) AS day FROM orders")
def event_dates(s: SparkSession, d: str) -> DataFrame:
    event = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("e"), F.date_format("o_orderdate", "yyyy-MM")))
    return read_table(s, d, "orders").select("o_orderkey", N.event_date(event, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m') WHEN 1 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def record_dates(s: SparkSession, d: str) -> DataFrame:
    """Records in JSON: with a month for the event, a number for it, null for it, and none."""
    k = F.col("o_orderkey") % 4
    own = F.concat(F.lit(', "date": "'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('"}'))
    event = F.when(k == 0, F.concat(F.lit('"'), F.date_format("o_orderdate", "yyyy-MM"), F.lit('"'))).when(k == 1, "2026").otherwise("null")
    record = F.when(k == 3, F.concat(F.lit('{"id": 1'), own)).otherwise(F.concat(F.lit('{"event_date": '), event, own))
    return read_table(s, d, "orders").select("o_orderkey", N.record_date(F.try_parse_json(record)).alias("day"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') BETWEEN '1995-01-01' AND '1996-12' END AS inside FROM orders")
def in_window(s: SparkSession, d: str) -> DataFrame:
    day = F.when(F.col("o_orderkey") % 5 > 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    return read_table(s, d, "orders").select("o_orderkey", S.in_window(day, F.lit("1995-01-01"), F.lit("1996-12")).alias("inside"))


def page_sources(s: SparkSession, d: str, group: int) -> DataFrame:
    n = F.col("page_id")
    item = F.struct(n.alias("n"), F.when(n % 3 == 0, F.concat(F.lit("t"), n.cast("string"))).alias("title"), F.when(n % 3 == 1, F.concat(F.lit("n"), n.cast("string"))).alias("name"), F.when(n % 7 > 0, F.regexp_extract("url", "^(https?://..)", 1)).alias("url"))
    return read_table(s, d, "pages").groupBy(F.floor(n / group).alias("g")).agg(F.sort_array(F.collect_list(item)).alias("sources"))


PAGE_SOURCES = "SELECT page_id, page_id // {} AS g, CASE WHEN page_id % 3 = 0 THEN 't' || page_id WHEN page_id % 3 = 1 THEN 'n' || page_id END AS t, CASE WHEN page_id % 7 > 0 THEN regexp_extract(url, '^(https?://..)', 1) END AS url FROM pages"


@query(f"""WITH p AS ({PAGE_SOURCES.format(8)}), f AS (SELECT * FROM p WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY g, url ORDER BY page_id) = 1)
SELECT g, row_number() OVER (PARTITION BY g ORDER BY page_id) - 1 AS at, coalesce(t, url) AS title, url FROM f""")
def clean_sources(s: SparkSession, d: str) -> DataFrame:
    return page_sources(s, d, 8).select("g", F.posexplode(N.clean_sources(F.col("sources"))).alias("at", "x")).select("g", "at", "x.title", "x.url")


@query(f"""WITH p AS ({PAGE_SOURCES.format(12)}) SELECT g, row_number() OVER (PARTITION BY g ORDER BY page_id) - 1 AS "index", CASE WHEN page_id % 3 = 0 THEN t END AS title, url FROM p WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY g ORDER BY page_id) <= 6""")
def explode_sources(s: SparkSession, d: str) -> DataFrame:
    return N.explode_sources(page_sources(s, d, 12), "g", "sources")


@query("SELECT doc_id FROM documents WHERE trim(CASE WHEN doc_id % 4 > 0 THEN trim(text) ELSE ' ' END) <> '' OR trim(CASE WHEN doc_id % 8 > 0 THEN source ELSE '' END) <> ''")
def has_content(s: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    return read_documents(s, d).filter(S.has_content(F.when(n % 4 > 0, F.col("text")).otherwise(" "), F.when(n % 8 > 0, F.col("source")).otherwise(""))).select("doc_id")


@query("SELECT doc_id FROM documents WHERE n_chars > 500 AND lang = 'en' AND contains(source, '1')")
def facet_filter(s: SparkSession, d: str) -> DataFrame:
    return N.facet_filter(read_documents(s, d), F.col("n_chars") > 500, (F.col("lang"), "en"), (F.col("source"), "1")).select("doc_id")


@query("SELECT doc_id, (SELECT count(*) FROM documents WHERE contains(lower(concat_ws(' ', text, lang, source)), 'erheit')) AS total FROM documents WHERE contains(lower(concat_ws(' ', text, lang, source)), 'erheit') ORDER BY doc_id LIMIT 150")
def keyword_search(s: SparkSession, d: str) -> DataFrame:
    return N.keyword_search(read_documents(s, d), " ERHEIT ", [F.col(c) for c in ("text", "lang", "source")], "doc_id").select("doc_id", "total")


@query("SELECT CASE WHEN doc_id % 2 = 0 THEN 'id' || doc_id ELSE source END AS theme_id, source AS title FROM documents WHERE doc_id % 3 > 0")
def normalize_themes(s: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    return N.normalize_themes(read_documents(s, d).select(F.when(n % 2 == 0, F.concat(F.lit("id"), n.cast("string"))).alias("theme_id"), F.when(n % 3 > 0, F.col("source")).alias("title")))


@query("""WITH p AS (SELECT page_id, page_id % 7 AS k, CAST(page_id AS VARCHAR) AS t FROM pages)
SELECT page_id, CASE k WHEN 0 THEN 'a/' || t || '.json' WHEN 1 THEN t || '/b.json' END AS path FROM p""")
def relative_path(s: SparkSession, d: str) -> DataFrame:
    t = F.col("page_id").cast("string")
    forms = [F.concat(F.lit("a\\"), t, F.lit(".json")), F.concat(F.lit("root/"), t, F.lit("/b.json")), F.concat(F.lit("/"), t), F.concat(F.lit("a/../"), t), F.concat(F.lit("C:\\"), t), F.concat(F.lit("a//"), t), F.concat(t, F.lit("/."))]
    return read_table(s, d, "pages").select("page_id", S.relative_path(F.element_at(F.array(*forms), (F.col("page_id") % 7 + 1).cast("int")), "root").alias("path"))


RECORDS = "r AS (SELECT CASE WHEN doc_id % 50 = 1 THEN doc_id - 1 WHEN doc_id % 50 = 2 THEN NULL ELSE doc_id END AS id, CASE WHEN doc_id % 50 = 3 THEN ' ' ELSE text END AS text FROM documents)"


def records(s: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    return read_documents(s, d).select(F.when(n % 50 == 1, n - 1).when(n % 50 == 2, None).otherwise(n).alias("id"), F.when(n % 50 == 3, " ").otherwise(F.col("text")).alias("text"))


@query(f"""WITH {RECORDS} SELECT CAST(id AS VARCHAR) AS doc_id, 'empty' AS rule FROM r WHERE trim(text) = '' UNION ALL SELECT NULL, 'no id' FROM r WHERE id IS NULL
UNION ALL SELECT CAST(id AS VARCHAR), 'repeated id' FROM r WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1""")
def record_violations(s: SparkSession, d: str) -> DataFrame:
    return N.record_violations(records(s, d), "id", "text")


@query(f"WITH {RECORDS} SELECT id, count(*) AS n FROM r WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1")
def id_violations(s: SparkSession, d: str) -> DataFrame:
    return N.id_violations(records(s, d), "id")


# Imports


def imported(s: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    return read_documents(s, d).select(F.col("source").alias("file"), n.alias("position"), S.sha256_hex(F.col("text")).alias("hash"), F.floor(n / 100).alias("key"), F.xxhash64(n % 3).cast("string").alias("vector_hash"))


IMPORTED = "i AS (SELECT source AS file, doc_id AS position, sha256(text) AS hash, doc_id // 100 AS key, doc_id % 3 AS vh FROM documents)"


@query(f"WITH {IMPORTED} SELECT hash, min(file) AS path, len(list(DISTINCT file)) - 1 AS aliases FROM i GROUP BY hash")
def dedupe_files(s: SparkSession, d: str) -> DataFrame:
    return I.dedupe_files(imported(s, d).select(F.col("file").alias("path"), "hash")).select("hash", "path", "aliases")


@query(f"WITH {IMPORTED}, h AS (SELECT hash, min(file) AS path FROM i GROUP BY hash) SELECT DISTINCT path, file AS alias FROM i JOIN h USING (hash) WHERE file <> path")
def file_aliases(s: SparkSession, d: str) -> DataFrame:
    return I.file_aliases(imported(s, d).select(F.col("file").alias("path"), "hash")).distinct()


@query(f"WITH {IMPORTED} SELECT file, hash, min(position) AS position, count(*) AS copies FROM i GROUP BY file, hash")
def dedupe_records(s: SparkSession, d: str) -> DataFrame:
    return I.dedupe_records(imported(s, d)).select("file", "hash", "position", "copies")


@query(f"WITH {IMPORTED} SELECT file, position, row_number() OVER (PARTITION BY file, hash ORDER BY position) AS copy FROM i")
def mark_duplicates(s: SparkSession, d: str) -> DataFrame:
    return I.mark_duplicates(imported(s, d)).select("file", "position", "copy")


@query(f"WITH {IMPORTED} SELECT file, key, count(DISTINCT hash) AS bodies FROM i GROUP BY file, key HAVING count(DISTINCT hash) > 1")
def key_conflicts(s: SparkSession, d: str) -> DataFrame:
    return I.key_conflicts(imported(s, d))


@query(f"WITH {IMPORTED} SELECT file AS path, count(DISTINCT hash) AS contents FROM i GROUP BY file HAVING count(DISTINCT hash) > 1")
def path_conflicts(s: SparkSession, d: str) -> DataFrame:
    return I.path_conflicts(imported(s, d).withColumnRenamed("file", "path"))


@query(f"WITH {IMPORTED} SELECT file, hash, count(DISTINCT vh) AS vectors FROM i GROUP BY file, hash HAVING count(DISTINCT vh) > 1")
def vector_conflicts(s: SparkSession, d: str) -> DataFrame:
    return I.vector_conflicts(imported(s, d))


@query(f"WITH {IMPORTED} SELECT file, count(*) AS records, count(DISTINCT hash) AS unique_records, count(*) - count(DISTINCT hash) AS duplicates, count(*) > 40 AS over_limit FROM i GROUP BY file")
def import_report(s: SparkSession, d: str) -> DataFrame:
    return I.import_report(imported(s, d), 40)


FILES = "f AS (SELECT source || '/' || doc_id || '.json' AS path, n_chars AS bytes, sha256(text) AS hash, CASE WHEN doc_id % 97 = 5 THEN 'error' ELSE 'ready' END AS status FROM documents), a AS (SELECT *, min(path) FILTER (status = 'ready') OVER (PARTITION BY hash) AS first FROM f), rep AS (SELECT path, bytes, CASE WHEN status = 'ready' AND path <> first THEN 'duplicate' ELSE status END AS status, CASE WHEN status = 'ready' AND path <> first THEN first END AS duplicate_of FROM a), full_report AS (SELECT *, CASE WHEN status = 'ready' THEN 2 ELSE 0 END AS records, CASE WHEN status = 'ready' THEN 1 ELSE 0 END AS unique_records, CASE WHEN status = 'ready' THEN 1 ELSE 0 END AS duplicates FROM rep)"


def reported(s: SparkSession, d: str) -> DataFrame:
    """Each document as a file that holds it twice."""
    docs = read_documents(s, d).select(F.concat("source", F.lit("/"), "doc_id", F.lit(".json")).alias("path"), F.col("n_chars").alias("bytes"), S.sha256_hex(F.col("text")).alias("hash"), F.when(F.col("doc_id") % 97 == 5, "error").otherwise("ready").alias("status"))
    records = docs.select(F.col("path").alias("file"), "hash")
    return I.file_report(docs, records.unionAll(records))


@query(f"WITH {FILES} SELECT * FROM full_report")
def file_report(s: SparkSession, d: str) -> DataFrame:
    return reported(s, d)


@query(f"""WITH {FILES} SELECT count(*) AS files, sum(bytes)::BIGINT AS bytes, sum(unique_records)::BIGINT AS records, sum(duplicates)::BIGINT AS duplicates, count_if(status = 'duplicate') AS duplicate_files, count_if(status = 'error') AS failed_files,
array_to_string(list_filter([CASE WHEN count(*) > 500 THEN 'files' END, CASE WHEN sum(bytes) > 40 * 1024 * 1024 THEN 'bytes' END, CASE WHEN sum(unique_records) > 20000 THEN 'records' END], lambda c: c IS NOT NULL), ',') AS over,
CASE WHEN count(*) > 500 OR sum(bytes) > 40 * 1024 * 1024 OR sum(unique_records) > 20000 THEN 'over limits' WHEN count_if(status = 'error') > 0 THEN 'failed files' ELSE 'ok' END AS status FROM full_report""")
def import_totals(s: SparkSession, d: str) -> DataFrame:
    return I.import_totals(reported(s, d), {"files": 500}).withColumn("over", F.array_join("over", ","))


@query("""WITH f AS (SELECT source AS file, count(*) AS found, count_if(n_chars > 5000)::BIGINT AS outside FROM documents GROUP BY source), k AS (SELECT file, found - (found % 2) AS declared FROM f)
SELECT file, declared, found, outside FROM f JOIN k USING (file) WHERE declared <> found OR outside > 0""")
def dataset_warnings(s: SparkSession, d: str) -> DataFrame:
    docs = read_documents(s, d).select(F.col("source").alias("file"), (F.col("n_chars") <= 5000).alias("in_window"))
    n = F.count("*")
    return I.dataset_warnings(docs, docs.groupBy("file").agg((n - n % 2).alias("declared")))


@query("SELECT bool_and(c > 0) AND count(DISTINCT lang) = 1 AS compatible, count(DISTINCT lang) AS signatures FROM (SELECT source, count(*) AS c, min(lang) AS lang FROM documents GROUP BY source)")
def vectors_compatible(s: SparkSession, d: str) -> DataFrame:
    return I.vectors_compatible(read_documents(s, d).groupBy("source").agg((F.count("*") > 0).alias("has_vectors"), F.min("lang").alias("signature")))


@query("""WITH f AS (SELECT source, count(*) AS c, sum(n_chars) AS b, max(doc_id) AS m FROM documents GROUP BY source)
SELECT 'd/' || source || CASE WHEN m % 4 = 0 THEN '.missing' ELSE '.json' END AS path, CASE WHEN m % 4 = 0 THEN 'missing' WHEN m % 4 = 1 THEN 'count' ELSE 'bytes' END AS fault FROM f WHERE m % 4 < 3""")
def reconcile_manifest(s: SparkSession, d: str) -> DataFrame:
    f = read_documents(s, d).groupBy("source").agg(F.count("*").alias("records"), F.sum("n_chars").alias("bytes"), F.max("doc_id").alias("m"))
    k = F.col("m") % 4
    entries = f.select(F.lit("d").alias("directory"), F.concat("source", F.when(k == 0, ".missing").otherwise(".json")).alias("file"), (F.col("records") + (k == 1).cast("int")).alias("count"), (F.col("bytes") + (k == 2).cast("int")).alias("bytes"))
    return I.reconcile_manifest(entries, f.select(F.concat(F.lit("d/"), "source", F.lit(".json")).alias("path"), "records", "bytes"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS path, CASE doc_id % 20 WHEN 0 THEN 'missing' WHEN 1 THEN 'not pinned' ELSE 'changed' END AS fault FROM documents WHERE doc_id % 20 < 3""")
def verify_checksums(s: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 20
    rows = read_documents(s, d).select(k.alias("k"), F.col("doc_id").cast("string").alias("path"), F.octet_length("text").cast("long").alias("bytes"), S.sha256_hex(F.col("text")).alias("sha256"))
    pinned = rows.filter("k <> 1").withColumn("sha256", F.when(F.col("k") == 2, F.reverse("sha256")).otherwise(F.col("sha256"))).drop("k")
    return I.verify_checksums(rows.filter("k <> 0").drop("k"), pinned)


@query("SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT vec_id, 'right' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)")
def same_ids(s: SparkSession, d: str) -> DataFrame:
    return I.same_ids(read_documents(s, d), vecs(s, d))


# Registry


def overlaid(s: SparkSession, d: str) -> DataFrame:
    o = read_table(s, d, "orders").select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderkey") % 3 > 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"), F.col("o_orderstatus").alias("vendor"))
    n = F.col("key")
    new = lambda df: df.select("key", F.lit("2026-07").alias("day"), F.lit("c").alias("vendor"), F.lit("verified").alias("verification"))
    curated = new(o.filter(n % 10 == 0)).unionByName(new(o.filter(n % 100 == 0).withColumn("key", n + 10**9)))
    return G.overlay(o, curated, "key", ["day", "vendor", "verification"])


OVERLAID = """o AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 10 = 0 THEN '2026-07' WHEN o_orderkey % 3 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day, CASE WHEN o_orderkey % 10 = 0 THEN 'c' ELSE o_orderstatus END AS vendor,
CASE WHEN o_orderkey % 10 = 0 THEN 'verified' ELSE 'legacy-unverified' END AS verification, o_orderkey % 10 = 0 AS replaced FROM orders UNION ALL SELECT o_orderkey + 1000000000, '2026-07', 'c', 'verified', false FROM orders WHERE o_orderkey % 100 = 0)"""


@query(f"WITH {OVERLAID} SELECT * FROM o")
def overlay(s: SparkSession, d: str) -> DataFrame:
    return overlaid(s, d).select("key", "day", "vendor", "verification", F.col("legacy_record").isNotNull().alias("replaced"))


@query(f"WITH {OVERLAID} SELECT count(*) AS items, count_if(replaced)::BIGINT AS replaced, count(day) AS dated, count(*) - count(day) AS undated, count_if(verification = 'verified')::BIGINT AS verified, min(day) AS first_day, max(day) AS last_day FROM o")
def registry_summary(s: SparkSession, d: str) -> DataFrame:
    return G.registry_summary(overlaid(s, d))


def evidence(s: SparkSession, d: str) -> DataFrame:
    n = F.col("g")
    item = F.struct(F.col("url"), F.when(F.col("page_id") % 4 > 0, "c").alias("category"))
    rows = read_table(s, d, "pages").groupBy(F.floor(F.col("page_id") / 3).alias("g")).agg(F.collect_list(item).alias("sources"))
    status = F.when(n % 3 == 0, "verified").when(n % 3 == 1, "partial").otherwise("unresolved")
    return rows.select(F.when(n % 40 == 1, n - 1).otherwise(n).alias("event_key"), status.alias("verification"), F.when(n % 5 > 0, F.col("sources")).alias("sources"), F.when(n % 6 > 0, G.CATEGORIES[0]).otherwise("x").alias("category"), F.when(n % 7 > 0, "2026").alias("published"), F.when(n % 8 > 0, "some").otherwise(" ").alias("limitations"))


EVIDENCE = """e AS (SELECT g, CASE WHEN g % 40 = 1 THEN g - 1 ELSE g END AS event_key, CASE g % 3 WHEN 0 THEN 'verified' WHEN 1 THEN 'partial' ELSE 'unresolved' END AS verification, page_id, url FROM (SELECT *, page_id // 3 AS g FROM pages))"""


@query(f"""WITH {EVIDENCE} SELECT verification, count(DISTINCT event_key) AS events, count(CASE WHEN g % 5 > 0 THEN url END) AS sources, count(DISTINCT CASE WHEN g % 5 > 0 THEN regexp_extract(url, '^https?://([^/:]+)', 1) END) AS hosts,
count(DISTINCT CASE WHEN g % 5 = 0 THEN g END) AS without_source FROM e GROUP BY verification""")
def evidence_audit(s: SparkSession, d: str) -> DataFrame:
    return G.evidence_audit(evidence(s, d))


@query(f"WITH {EVIDENCE} SELECT DISTINCT verification, event_key, CASE WHEN g % 5 > 0 THEN url END AS url FROM e WHERE verification <> 'verified'")
def evidence_lists(s: SparkSession, d: str) -> DataFrame:
    return G.evidence_lists(evidence(s, d)).distinct()


@query(f"""WITH {EVIDENCE}, k AS (SELECT g, event_key, max(CASE WHEN page_id % 4 > 0 AND g % 5 > 0 THEN 1 ELSE 0 END) AS good FROM e GROUP BY ALL)
SELECT event_key, 'category' AS rule FROM k WHERE g % 6 = 0 UNION ALL SELECT event_key, 'published' FROM k WHERE g % 7 = 0 UNION ALL SELECT event_key, 'limitations' FROM k WHERE g % 8 = 0
UNION ALL SELECT event_key, 'sources' FROM k WHERE good = 0 UNION ALL SELECT event_key, 'repeated' FROM k GROUP BY event_key HAVING count(*) > 1""")
def evidence_violations(s: SparkSession, d: str) -> DataFrame:
    return G.evidence_violations(evidence(s, d))


# Embedding


def cache_of(s: SparkSession, d: str) -> DataFrame:
    docs = read_documents(s, d).filter("doc_id % 2 = 0")
    return docs.select(E.row_key("cfg").alias("row_key"), F.array(F.lit(1.0), F.lit(0.0)).alias("vector"))


@query("""WITH k AS (SELECT DISTINCT sha256('cfg' || chr(10) || text) AS row_key FROM documents), c AS (SELECT DISTINCT sha256('cfg' || chr(10) || text) AS row_key FROM documents WHERE doc_id % 2 = 0)
SELECT row_key, row_key IN (SELECT row_key FROM c) AS cached FROM k""")
def split_cached(s: SparkSession, d: str) -> DataFrame:
    known, missing = E.split_cached(read_documents(s, d).select(E.row_key("cfg").alias("row_key"), "text"), cache_of(s, d))
    return known.select("row_key", F.lit(True).alias("cached")).unionByName(missing.select("row_key", F.lit(False).alias("cached")))


@query("""WITH k AS (SELECT text, bool_or(doc_id % 2 = 0) AS hit, count(*) AS n FROM documents GROUP BY text)
SELECT sum(n)::BIGINT AS inputs, count(*) AS unique_inputs, coalesce(sum(n) FILTER (hit), 0)::BIGINT AS reused_rows, count_if(NOT hit)::BIGINT AS computed_rows FROM k""")
def embed_metrics(s: SparkSession, d: str) -> DataFrame:
    rows = read_documents(s, d).select(E.row_key("cfg").alias("row_key"), "text")
    return E.embed_metrics(rows, E.split_cached(rows, cache_of(s, d))[0])


@query()
def embed_documents(s: SparkSession, d: str) -> DataFrame:
    empty = s.createDataFrame([], "row_key string, vector array<double>")
    return E.embed_documents(read_documents(s, d), empty, E.hashed_ngrams(), "hashed")[0].select("doc_id", "row_key", "vector")


@query("""SELECT doc_id, sha256('hashed' || chr(10) || text) AS row_key, count(*) OVER (PARTITION BY text) AS rows_of_text, 1 AS vectors_of_text, 1.0::DOUBLE AS length FROM documents""")
def embed_rows(s: SparkSession, d: str) -> DataFrame:
    """Every document has one unit vector, equal texts the same, computed once."""
    made = embed_documents(s, d)
    of = made.groupBy("row_key").agg(F.count("*").alias("rows_of_text"), F.count_distinct("vector").cast("int").alias("vectors_of_text"))
    return made.join(of, "row_key").select("doc_id", "row_key", "rows_of_text", "vectors_of_text", F.round(V.norm(F.col("vector")), 9).alias("length"))


@query(f"""WITH {VSQL}, b AS (SELECT doc_id, vector, list_transform(vector, lambda x, i: x + 0.1 * list_reverse(vector)[i]) AS other FROM v)
SELECT doc_id, round(list_dot_product(vector, other) / sqrt(list_dot_product(vector, vector) * list_dot_product(other, other)), 6) AS cosine, round(sqrt(list_dot_product(vector, vector)), 6) AS norm_a, round(sqrt(list_dot_product(other, other)), 6) AS norm_b FROM b""")
def embedding_agreement(s: SparkSession, d: str) -> DataFrame:
    a = vecs(s, d)
    b = a.withColumn("vector", F.zip_with("vector", F.reverse("vector"), lambda x, y: x + 0.1 * y))
    return E.embedding_agreement(a, b).select("doc_id", *[F.round(c, 6).alias(c) for c in ("cosine", "norm_a", "norm_b")])


@query(f"""WITH {VSQL}, b AS (SELECT doc_id, vector AS x, list_transform(vector, lambda x, i: x + 0.1 * list_reverse(vector)[i]) AS y FROM v), u AS (SELECT doc_id, list_transform(x, lambda t: t / sqrt(list_dot_product(x, x))) AS x, list_transform(y, lambda t: t / sqrt(list_dot_product(y, y))) AS y FROM b),
p AS (SELECT list_dot_product(a.x, b.x) AS s, list_dot_product(a.y, b.y) AS t FROM u a JOIN u b ON a.doc_id < b.doc_id)
SELECT count(*) AS pairs, round(avg(s), 9) AS mean_a, round(var_pop(s), 9) AS variance_a, round(avg(t), 9) AS mean_b, round(var_pop(t), 9) AS variance_b, round(avg(s - t), 9) AS mean_difference, round(sqrt(avg((s - t) ** 2)), 9) AS rms_difference, round(max(abs(s - t)), 9) AS largest_difference FROM p""")
def pair_agreement(s: SparkSession, d: str) -> DataFrame:
    a = vecs(s, d)
    b = a.withColumn("vector", F.zip_with("vector", F.reverse("vector"), lambda x, y: x + 0.1 * y))
    out = E.pair_agreement(a, b)
    return out.select("pairs", *[F.round(c, 9).alias(c) for c in out.columns if c not in ("pairs", "compared")])


# Aggregates


@query("""WITH c AS (SELECT source, lang, count(*) AS n FROM documents WHERE lang <> 'de' GROUP BY ALL), b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) = 1)
SELECT s.source, coalesce(b.lang, 'none') AS value FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN b USING (source)""")
def majority(s: SparkSession, d: str) -> DataFrame:
    return C.majority(read_documents(s, d).withColumn("lang", F.when(F.col("lang") == "de", " ").otherwise(F.col("lang"))), "source", "lang", "none")


@query(f"WITH {SUMS} SELECT leaf, i - 1 AS pos, round(centroid[i], 6) AS x FROM (SELECT *, unnest(generate_series(1, 64)) AS i FROM c)")
def centroids(s: SparkSession, d: str) -> DataFrame:
    return C.centroids(vecs(s, d), "leaf").select("leaf", F.posexplode("centroid").alias("pos", "x")).select("leaf", "pos", F.round("x", 6).alias("x"))


TOPICS = f"{SUMS}, t AS (SELECT leaf, centroid[1] * 225 AS x, centroid[2] * 225 AS y, centroid[3] * 225 AS z FROM c)"


@query(f"""WITH {TOPICS}, h AS (SELECT leaf, avg(list_dot_product(vector, centroid)) AS h FROM v JOIN c USING (leaf) GROUP BY leaf),
n AS (SELECT a.leaf, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)) AS n FROM t a JOIN t b ON a.leaf <> b.leaf GROUP BY a.leaf)
SELECT leaf, round(h, 6) AS cohesion, round(n, 6) AS nearest, round(greatest(8, least(225 * (0.12 + 0.3 * sqrt(greatest(0, 2 - 2 * h))) * (1 - 0.5 * 0.8), greatest(8, 0.65 * n))), 6) AS radius FROM h JOIN n USING (leaf)""")
def topic_radius(s: SparkSession, d: str) -> DataFrame:
    c = C.centroids(vecs(s, d), "leaf")
    topics = c.select("leaf", *[(F.col("centroid")[i] * 225).alias(x) for i, x in enumerate("xyz")])
    return L.topic_radius(topics, L.cohesion(vecs(s, d), c), 0.8).select("leaf", *[F.round(x, 6).alias(x) for x in ("cohesion", "nearest", "radius")])


@query("SELECT min(value) AS minimum, max(value) AS maximum, round(avg(value), 6) AS mean, (SELECT value FROM events ORDER BY value OFFSET (SELECT count(*) // 2 FROM events) LIMIT 1) AS median FROM events")
def value_stats(s: SparkSession, d: str) -> DataFrame:
    return A.stats(read_table(s, d, "events"), "value").withColumn("mean", F.round("mean", 6))


@query("SELECT value AS quantile FROM events ORDER BY value OFFSET (SELECT CAST(floor((count(*) - 1) * 0.95) AS BIGINT) FROM events) LIMIT 1")
def quantile_floor(s: SparkSession, d: str) -> DataFrame:
    return A.quantile_floor(read_table(s, d, "events"), "value", 0.95)


# Clusters


@query(f"""WITH {SUMS} SELECT doc_id, theme, score FROM (SELECT doc_id, c.leaf AS theme, round(list_dot_product(vector, centroid), 6) AS score FROM v CROSS JOIN c) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, theme) = 1""")
def assign_themes(s: SparkSession, d: str) -> DataFrame:
    return C.assign_themes(vecs(s, d), C.centroids(vecs(s, d), "leaf").withColumnRenamed("leaf", "theme"))


@query(f"WITH {SUMS} SELECT leaf, doc_id, round(list_dot_product(vector, centroid), 6) AS score FROM v JOIN c USING (leaf) QUALIFY row_number() OVER (PARTITION BY leaf ORDER BY round(list_dot_product(vector, centroid), 6) DESC, doc_id) = 1")
def topic_representatives(s: SparkSession, d: str) -> DataFrame:
    return C.representatives(vecs(s, d), C.centroids(vecs(s, d), "leaf"), "leaf")


@query(f"""WITH {SUMS}, b AS (SELECT leaf, doc_id FROM v JOIN c USING (leaf) QUALIFY row_number() OVER (PARTITION BY leaf ORDER BY round(list_dot_product(vector, centroid), 6) DESC, doc_id) = 1)
SELECT leaf, doc_id, '· ' || CASE WHEN length(text) > 22 THEN left(text, 21) || '…' ELSE text END AS label FROM b JOIN documents USING (doc_id)""")
def name_topics(s: SparkSession, d: str) -> DataFrame:
    return C.name_topics(vecs(s, d), read_documents(s, d).select("doc_id", F.col("text").alias("title")), "leaf", "· ")


#: The planes of the path r: numbers of a linear congruential generator from the hash of the path, in rows of 64, at length 1.
PLANES = """s AS (SELECT 0 AS k, xor(2166136261::BIGINT, ascii('r')) * 16777619 & 4294967295 AS x UNION ALL SELECT k + 1, (x * 1664525 + 1013904223) % 4294967296 FROM s WHERE k < 192),
plane AS (SELECT (k - 1) // 64 AS p, list(x / 4294967296 - 0.5 ORDER BY k) AS w FROM s WHERE k > 0 GROUP BY p)"""


@query(f"WITH RECURSIVE {VSQL}, {PLANES} SELECT doc_id, CAST(sum(CASE WHEN round(list_dot_product(vector, w) / sqrt(list_dot_product(w, w)), 12) >= 0 THEN 1 << p ELSE 0 END) AS INT) AS cell FROM v CROSS JOIN plane GROUP BY doc_id")
def seeded_cells(s: SparkSession, d: str) -> DataFrame:
    return C.cells(vecs(s, d).select("doc_id", "vector", F.lit("r").alias("path"))).select("doc_id", "cell")


@query()
def bounded_hierarchy(s: SparkSession, d: str) -> DataFrame:
    return C.bounded_hierarchy(vecs(s, d))


@query("SELECT vec_id AS doc_id, CAST((row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) % 8 AS INT) AS cell FROM embeddings")
def round_robin(s: SparkSession, d: str) -> DataFrame:
    return C.round_robin(vecs(s, d).select("doc_id", "leaf"), "leaf", "doc_id").select("doc_id", "cell")


@query(f"""WITH {SUMS} SELECT doc_id, 'nebula:' || leaf AS root FROM (SELECT doc_id, c.leaf AS leaf, row_number() OVER (PARTITION BY doc_id ORDER BY round(list_dot_product(vector, centroid), 6) DESC, c.leaf) AS k FROM v CROSS JOIN c) WHERE k = 1""")
def theme_roots(s: SparkSession, d: str) -> DataFrame:
    return C.theme_roots(vecs(s, d), C.centroids(vecs(s, d), "leaf").withColumnRenamed("leaf", "theme"))


@query("""SELECT vec_id AS doc_id, list_reduce(list_transform(string_split('r/0|' || vec_id, ''), lambda c: ascii(c)::BIGINT), lambda h, c: (xor(h, c) * 16777619) & 4294967295, 2166136261::BIGINT) % 8 AS shard FROM embeddings""")
def identity_shards(s: SparkSession, d: str) -> DataFrame:
    return vecs(s, d).select("doc_id", C.identity_shard(F.lit("r/0"), F.col("doc_id")).alias("shard"))


@query()
def spherical_k_means(s: SparkSession, d: str) -> DataFrame:
    return C.spherical_k_means(vecs(s, d), 4)[0]


@query()
def average_linkage(s: SparkSession, d: str) -> DataFrame:
    return C.average_linkage(vecs(s, d), "leaf")


@query()
def protected_groups(s: SparkSession, d: str) -> DataFrame:
    return C.protected_groups(vecs(s, d), "leaf", 0.2, 2)


@query()
def group_linkage(s: SparkSession, d: str) -> DataFrame:
    return C.group_linkage(vecs(s, d), "root", "leaf")


@query()
def topic_tree(s: SparkSession, d: str) -> DataFrame:
    return P.topic_tree(vecs(s, d), "root", 0.35, 2)[1]


ROOTS = """rs AS (SELECT root, pos, sum(x) AS x FROM (SELECT root, i AS pos, vector[i] AS x FROM (SELECT *, unnest(generate_series(1, 64)) AS i FROM v)) GROUP BY ALL),
rc AS (SELECT root, list(x / n ORDER BY pos) AS rv FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY root)) AS n FROM rs) GROUP BY root)"""


@query(f"WITH {SUMS}, {ROOTS} SELECT root, leaf AS theme, round(list_dot_product(rv, centroid), 6) AS score FROM rc CROSS JOIN c")
def theme_scores(s: SparkSession, d: str) -> DataFrame:
    return C.theme_scores(C.centroids(vecs(s, d), "root"), C.centroids(vecs(s, d), "leaf").withColumnRenamed("leaf", "theme"))


@query(f"""WITH RECURSIVE {SUMS}, {ROOTS}, t AS (SELECT root, leaf AS theme, round(list_dot_product(rv, centroid), 6) AS score FROM rc CROSS JOIN c),
o AS (SELECT *, 'r:' || root AS a, 't:' || theme AS b, 1 AS cap, row_number() OVER (ORDER BY score DESC, root, theme) AS k FROM t), {GREEDY} SELECT root, theme, score FROM o JOIN g USING (k) WHERE ok""")
def name_roots(s: SparkSession, d: str) -> DataFrame:
    return C.name_roots(theme_scores(s, d))


# Layout


def anchors(s: SparkSession, d: str) -> DataFrame:
    return C.centroids(vecs(s, d), "leaf").select("leaf", "centroid", *[(F.col("centroid")[i] * 225).alias(x) for i, x in enumerate("xyz")])


SCORES = f"{TOPICS}, sc AS (SELECT doc_id, c.leaf AS leaf, round(list_dot_product(vector, centroid), 6) AS score FROM v CROSS JOIN c), rk AS (SELECT *, max(score) OVER (PARTITION BY doc_id) AS best, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, leaf) AS rank FROM sc)"


@query(f"WITH {SCORES} SELECT doc_id, leaf, score, best, rank FROM rk WHERE score > 0.1 AND rank <= 3")
def top_topics(s: SparkSession, d: str) -> DataFrame:
    return L.top_topics(vecs(s, d), anchors(s, d), 0.1)


PLACED = f"""{SCORES}, {ROOTS}, near AS (SELECT doc_id, max(list_dot_product(vector, rv)) AS scope FROM v CROSS JOIN rc GROUP BY doc_id),
w AS (SELECT *, ((score - 0.1) / 0.9) ** 2 * exp((score - best) / 0.07) AS w FROM rk WHERE score > 0.1 AND rank <= 3),
g AS (SELECT doc_id, max(w) FILTER (rank = 1) AS w1, max(w) FILTER (rank = 2) AS w2, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my, sum(w * z) / sum(w) AS mz FROM w JOIN t USING (leaf) GROUP BY doc_id),
top AS (SELECT rk.doc_id, rk.leaf, rk.score, t.x, t.y, t.z, [vector[i] - centroid[i] for i in [4, 5, 6]] AS r, ((rk.doc_id + 452) * 1664525 + 1013904223) % 4294967296 AS s1 FROM rk JOIN t USING (leaf) JOIN c USING (leaf) JOIN v ON v.doc_id = rk.doc_id WHERE rank = 1),
turn AS (SELECT *, (s2 * 1664525 + 1013904223) % 4294967296 AS s3 FROM (SELECT *, (s1 * 1664525 + 1013904223) % 4294967296 AS s2 FROM top)),
q AS (SELECT turn.*, scope, g.*, CASE WHEN w2 IS NULL THEN 1 ELSE 1 - w2 / w1 END AS dom, sqrt(list_dot_product(r, r)) AS len, [s1 / 4294967296 - 0.5, s2 / 4294967296 - 0.5, s3 / 4294967296 - 0.5] AS d, (SELECT max(sqrt(x * x + y * y + z * z) + 24) FROM t) + 225 * (1.2 + greatest(0, 0.1 - scope)) AS shell FROM turn JOIN near USING (doc_id) LEFT JOIN g USING (doc_id)),
p AS (SELECT *, w1 IS NULL OR scope < 0.1 AS outside, least(24, len * 225 * 0.7 * (1 - 0.65 * 0.8)) * dom / len AS step FROM q),
placed AS (SELECT doc_id, leaf AS nearest_leaf, score, round(CASE WHEN NOT outside THEN dom END, 4) AS dominance, CASE WHEN outside THEN 'outlier' WHEN dom < 0.35 THEN 'bridge' ELSE 'cluster' END AS placement, x AS tx, y AS ty, z AS tz, shell,
CASE WHEN outside THEN d[1] / sqrt(list_dot_product(d, d)) * shell ELSE mx + (x - mx) * 0.8 * dom + r[1] * step END AS x,
CASE WHEN outside THEN d[2] / sqrt(list_dot_product(d, d)) * shell ELSE my + (y - my) * 0.8 * dom + r[2] * step END AS y,
CASE WHEN outside THEN d[3] / sqrt(list_dot_product(d, d)) * shell ELSE mz + (z - mz) * 0.8 * dom + r[3] * step END AS z FROM p)"""


def placed(s: SparkSession, d: str) -> DataFrame:
    """Documents between the leaves, with the roots as scopes and three dimensions as residual axes."""
    scopes = np.array([r.centroid for r in C.centroids(vecs(s, d), "root").collect()])  # a handful of roots
    return L.place_documents(vecs(s, d), anchors(s, d), 0.1, 0.8, scopes, np.eye(64)[3:6])


@query(f"WITH {PLACED} SELECT doc_id, nearest_leaf, score, dominance, placement, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z, round(sqrt((x - tx) ** 2 + (y - ty) ** 2 + (z - tz) ** 2), 4) AS distance FROM placed")
def place_documents(s: SparkSession, d: str) -> DataFrame:
    return placed(s, d).select("doc_id", "nearest_leaf", "score", F.round("dominance", 4).alias("dominance"), "placement", *[F.round(c, 4).alias(c) for c in ("x", "y", "z", "distance")])


@query(f"WITH {PLACED} SELECT doc_id, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z, round(shell, 4) AS radius FROM placed WHERE placement = 'outlier'")
def outlier_positions(s: SparkSession, d: str) -> DataFrame:
    far = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    return placed(s, d).filter("placement = 'outlier'").select("doc_id", *[F.round(c, 4).alias(c) for c in "xyz"], F.round(far, 4).alias("radius"))


@query()
def fit_topics(s: SparkSession, d: str) -> DataFrame:
    roots = C.centroids(vecs(s, d), "root").select(F.lit("roots").alias("scope"), F.col("root").alias("topic"), F.lit("root").alias("kind"), "centroid")
    leaves = C.centroids(vecs(s, d), "leaf").select(F.lit("leaves").alias("scope"), F.col("leaf").alias("topic"), F.lit("leaf").alias("kind"), "centroid")
    return L.fit_topics(roots.unionByName(leaves), "scope", 0.8)


@query()
def residual_projection(s: SparkSession, d: str) -> DataFrame:
    axes = L.residual_axes(vecs(s, d)).tolist()
    return vecs(s, d).select("doc_id", *[F.round(V.dot(F.col("vector"), F.array(*map(F.lit, a))), 9).alias(c) for a, c in zip(axes, "xyz", strict=True)])


@query()
def hierarchy_positions(s: SparkSession, d: str) -> DataFrame:
    roots = s.createDataFrame([("r", 0.0, 0.0, 0.0)], "root string, x double, y double, z double")
    return L.hierarchy_places(vecs(s, d), C.bounded_hierarchy(vecs(s, d)), roots)[1]


@query("""SELECT 'placed documents' AS what, count(*) AS n FROM embeddings UNION ALL SELECT 'documents of the roots', count(*) FROM embeddings UNION ALL SELECT 'roots', count(DISTINCT root) FROM (WITH %s SELECT doc_id, c.leaf AS root FROM v CROSS JOIN c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(list_dot_product(vector, centroid), 6) DESC, c.leaf) = 1)
UNION ALL SELECT 'violations', 0""" % SUMS)
def build_forest(s: SparkSession, d: str) -> DataFrame:
    """The whole job over all vectors, with the labels' centroids as themes: what it holds, and that nothing is wrong with it."""
    forest = Forest.build_forest(vecs(s, d), themes=C.centroids(vecs(s, d), "leaf").withColumnRenamed("leaf", "theme"))
    count = lambda what, df: df.agg(F.lit(what).alias("what"), F.count("*").alias("n"))
    top = forest["nodes"].filter("kind = 'root'")
    held = top.agg(F.lit("documents of the roots").alias("what"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return count("placed documents", forest["places"]).unionByName(held).unionByName(count("roots", top)).unionByName(count("violations", Forest.forest_violations(forest)))


@query(f"""WITH {VSQL}, {POS}, b AS (SELECT doc_id, leaf, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y, z - avg(z) OVER w AS z FROM pos JOIN v USING (doc_id) WINDOW w AS (PARTITION BY leaf))
SELECT doc_id, leaf, round(x * 65 / max(greatest(abs(x), abs(y), abs(z))) OVER (PARTITION BY leaf), 5) AS x FROM b""")
def centred(s: SparkSession, d: str) -> DataFrame:
    return L.centred(positions(s, d).join(vecs(s, d).select("doc_id", "leaf"), "doc_id"), "leaf").select("doc_id", "leaf", F.round("x", 5).alias("x"))


# Tree


@query(f"WITH {NODES} SELECT * FROM nodes")
def node_table(s: SparkSession, d: str) -> DataFrame:
    return nodes(s, d)


@query(f"""WITH {NODES} SELECT node, step, array_to_string(string_split(node, '/')[1:step + 1], '/') AS ancestor FROM (SELECT node, unnest(generate_series(0, depth)) AS step FROM nodes)""")
def path_of(s: SparkSession, d: str) -> DataFrame:
    return T.path_of(nodes(s, d))


@query(f"WITH {NODES} SELECT node, n FROM nodes WHERE starts_with(node, 'r1/')")
def descendants(s: SparkSession, d: str) -> DataFrame:
    return T.descendants(nodes(s, d), "r1").select("node", "n")


@query(f"""WITH {MEMBERS} SELECT node, count(*) AS n FROM (SELECT unnest([split_part(path, '/', 1), split_part(path, '/', 1) || '/' || split_part(path, '/', 2), path]) AS node FROM m JOIN documents USING (doc_id) WHERE lang = 'fr') GROUP BY node""")
def matching_nodes(s: SparkSession, d: str) -> DataFrame:
    return T.matching_nodes(members(s, d).join(read_documents(s, d).select("doc_id", "lang"), "doc_id"), F.col("lang") == "fr")


@query(f"WITH {NODES} SELECT parent, node, n, row_number() OVER (PARTITION BY parent ORDER BY n DESC, node) AS rank FROM nodes WHERE parent IS NOT NULL QUALIFY rank <= 2")
def representatives(s: SparkSession, d: str) -> DataFrame:
    return T.representatives(nodes(s, d).filter("parent is not null"), "parent", F.col("n"), 2).select("parent", "node", "n", "rank")


@query("SELECT vec_id AS doc_id FROM embeddings WHERE label % 4 = 1 ORDER BY 1 LIMIT 80")
def topic_members(s: SparkSession, d: str) -> DataFrame:
    return T.topic_members(members(s, d), "r1").select("doc_id")


@query(f"WITH {KNN} SELECT DISTINCT src, dst, score FROM knn JOIN v ON v.doc_id IN (src, dst) WHERE root = '1' ORDER BY score DESC, src, dst LIMIT 8")
def related_edges(s: SparkSession, d: str) -> DataFrame:
    return T.related_edges(edges(s, d), members(s, d), "r1").select("src", "dst", "score")


FRONTIER = f"""{MEMBERS}, fr AS (SELECT m.* FROM m JOIN documents USING (doc_id) WHERE lang = 'fr'), e AS (SELECT DISTINCT unnest([split_part(path, '/', 1), split_part(path, '/', 1) || '/' || split_part(path, '/', 2), path]) AS node FROM fr
UNION ALL SELECT path || '/' || lpad(CAST(doc_id AS VARCHAR), 20, '0') FROM fr), k AS (SELECT node, len(string_split(node, '/')) - 1 AS depth, [array_to_string(string_split(node, '/')[1:i], '/') for i in range(1, len(string_split(node, '/')) + 1)] AS up FROM e),
o AS (SELECT *, list_contains(['r1', 'r1/1', 'r1/1/system'], up[-2]) AS below, [CASE WHEN p IN ('r1', 'r1/1', 'r1/1/system') THEN '0' ELSE '1' END || p for p in up] AS way FROM k)"""


@query(f"WITH {FRONTIER} SELECT row_number() OVER (ORDER BY depth > 0, CASE WHEN depth > 0 THEN way END, node) AS position, node, depth FROM o WHERE (depth <= 1 OR below) AND (depth < 3 OR below) ORDER BY position LIMIT 25")
def visible_frontier(s: SparkSession, d: str) -> DataFrame:
    """Topics with French documents, the way to one leaf first, and its documents, as the zoom is too small for others."""
    m = members(s, d).join(read_documents(s, d).select("doc_id", "lang"), "doc_id")
    return T.visible_frontier(nodes(s, d), 1, "r1/1/system", 25, m, F.col("lang") == "fr", 0.5).select("position", "node", "depth")


SCENE = f"""{VSQL}, {POS}, it AS (SELECT leaf AS scope, 'doc:' || doc_id AS node, x, y, z FROM pos JOIN v USING (doc_id) UNION ALL SELECT 'universe', 'galaxy:' || root, any_value(x), any_value(y), any_value(z) FROM (SELECT root, min(doc_id) AS doc_id FROM v GROUP BY root) JOIN pos USING (doc_id) GROUP BY root),
c AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY node) - 1 AS i, count(*) OVER w AS n, x - avg(x) OVER w AS dx, y - avg(y) OVER w AS dy, z - avg(z) OVER w AS dz FROM it WINDOW w AS (PARTITION BY scope)),
e AS (SELECT *, greatest(1, max(sqrt(dx * dx + dy * dy + dz * dz)) OVER (PARTITION BY scope)) AS ext, list_reduce(list_transform(string_split(node, ''), lambda c: ascii(c)::BIGINT), lambda h, c: (xor(h, c) * 16777619) & 4294967295, 2166136261::BIGINT) / 4294967296 * 2 * pi() AS a, (i + 0.5) / n * 2 - 1 AS h FROM c),
f AS (SELECT *, [dx / ext * 65, dy / ext * 65, dz / ext * 65] AS p, [cos(a) * sqrt(1 - h * h) * 58, h * 58, sin(a) * sqrt(1 - h * h) * 58] AS q, [cos(i * pi() * (3 - sqrt(5))) * sqrt(1 - h * h) * 68, -h * 68, sin(i * pi() * (3 - sqrt(5))) * sqrt(1 - h * h) * 68] AS s FROM e),
k AS (SELECT *, [floor(t / 15 + 0.5) for t in p] AS own, [floor(t / 15 + 0.5) for t in q] AS other FROM f),
r AS (SELECT scope, i, false AS moved, [own] AS taken FROM k WHERE i = 0 UNION ALL
SELECT k.scope, k.i, list_contains(taken, own), list_append(taken, CASE WHEN list_contains(taken, own) THEN other ELSE own END) FROM r JOIN k ON k.scope = r.scope AND k.i = r.i + 1)"""


@query(f"WITH RECURSIVE {SCENE} SELECT scope, node, round(CASE WHEN scope = 'universe' THEN s[1] WHEN moved THEN q[1] ELSE p[1] END, 4) AS x, round(CASE WHEN scope = 'universe' THEN s[2] WHEN moved THEN q[2] ELSE p[2] END, 4) AS y, round(CASE WHEN scope = 'universe' THEN s[3] WHEN moved THEN q[3] ELSE p[3] END, 4) AS z, moved AND scope <> 'universe' AS moved FROM k JOIN r USING (scope, i)")
def scene_layout(s: SparkSession, d: str) -> DataFrame:
    """Documents around the middle of their leaf, and the roots as galaxies; the SQL places them one after another."""
    rows = positions(s, d).join(vecs(s, d).select("doc_id", "leaf", "root"), "doc_id")
    docs = rows.select(F.col("leaf").alias("scope"), F.concat(F.lit("doc:"), "doc_id").alias("node"), F.lit("planet").alias("role"), "x", "y", "z")
    first = rows.groupBy("root").agg(F.min_by(F.struct("x", "y", "z"), "doc_id").alias("p"))
    galaxies = first.select(F.lit("universe").alias("scope"), F.concat(F.lit("galaxy:"), "root").alias("node"), F.lit("galaxy").alias("role"), "p.*")
    return T.scene_layout(docs.unionByName(galaxies)).select("scope", "node", *[F.round(c, 4).alias(c) for c in "xyz"], "moved")


@query(f"""WITH {NODES}, {KNN} SELECT 'nodes' AS what, kind AS name, count(*) AS n FROM nodes GROUP BY kind UNION ALL SELECT 'members', node, n FROM nodes WHERE parent IS NULL UNION ALL SELECT 'edges', 'knn', count(*) FROM knn""")
def graph_summary(s: SparkSession, d: str) -> DataFrame:
    return T.graph_summary(nodes(s, d), edges(s, d).withColumn("type", F.lit("knn")))


@query(f"""WITH {NODES}, {KNN} SELECT 'radius' AS rule, node AS id FROM nodes WHERE n % 3 = 0 UNION ALL SELECT 'kind', node FROM nodes WHERE n % 5 = 0 UNION ALL SELECT 'depth', node FROM nodes WHERE n % 7 = 0 AND depth = 2
UNION ALL SELECT 'member of no node', CAST(doc_id AS VARCHAR) FROM m WHERE doc_id % 100 = 7 UNION ALL SELECT 'score', CAST(src AS VARCHAR) FROM knn WHERE src % 50 = 3
UNION ALL SELECT 'no way up', node FROM nodes WHERE parent IS NULL AND n % 5 = 0""")
def graph_violations(s: SparkSession, d: str) -> DataFrame:
    n = F.col("n")
    bad = nodes(s, d).select(
        "node", F.when(n % 5 == 0, "odd").otherwise(F.col("kind")).alias("kind"), F.when((n % 7 == 0) & (F.col("depth") == 2), 9).otherwise(F.col("depth")).alias("depth"), "root", "parent", "n",
        *[F.lit(0.0).alias(c) for c in "xyz"], F.when(n % 3 == 0, -1.0).otherwise(1.0).alias("radius"),
    )
    some = members(s, d).withColumn("path", F.when(F.col("doc_id") % 100 == 7, "lost").otherwise(F.col("path")))
    e = edges(s, d).withColumns({"type": F.lit("knn"), "score": F.when(F.col("src") % 50 == 3, 2.0).otherwise(F.col("score"))})
    return T.graph_violations(bad, e, some)


@query(f"""WITH RECURSIVE {NODES}, {CROSS}, {LINKS}, {KNN.removeprefix(f"{VSQL}, ")}, placed AS (SELECT doc_id, leaf, CASE WHEN doc_id % 40 = 11 THEN 'other' ELSE root END AS root FROM v), edges AS (SELECT src, dst, score, CASE WHEN src % 10 = 9 THEN 'cross' ELSE 'knn' END AS type FROM knn UNION ALL SELECT i, j, score, 'cross' FROM o JOIN g USING (k) WHERE ok),
e AS (SELECT edges.*, a.root AS ra, b.root AS rb, a.leaf AS la, b.leaf AS lb FROM edges JOIN placed a ON a.doc_id = src JOIN placed b ON b.doc_id = dst)
SELECT 'score' AS rule, count(*) AS n FROM knn WHERE src % 50 = 3 UNION ALL SELECT 'lost documents', count(*) FROM m WHERE doc_id % 100 = 7
UNION ALL SELECT 'tree edges', -count(*) FROM nodes WHERE parent IS NULL AND depth = 0 UNION ALL SELECT 'knn root', count(*) FROM e WHERE type = 'knn' AND ra <> rb UNION ALL SELECT 'cross root', count(*) FROM e WHERE type = 'cross' AND ra = rb
UNION ALL SELECT 'cross score', count(*) FROM e WHERE type = 'cross' AND score < 0.3 UNION ALL SELECT 'cross degree', count(*) FROM (SELECT leaf FROM (SELECT unnest([la, lb]) AS leaf FROM e WHERE type = 'cross') GROUP BY leaf HAVING count(*) > 8)""")
def check_build(s: SparkSession, d: str) -> DataFrame:
    """All seven rules broken: scores moved, documents lost, a wrong kind of root, documents in other roots, and neighbours in one root passed off as bridges, beside the true bridges."""
    e = edges(s, d).withColumn("type", F.when(F.col("src") % 10 == 9, "cross").otherwise("knn"))
    e = e.withColumn("score", F.when(F.col("src") % 50 == 3, F.col("score") + 0.5).otherwise(F.col("score")))
    e = e.unionByName(cross_links(s, d).select(F.col("i").alias("src"), F.col("j").alias("dst"), "score", F.lit("cross").alias("type")))
    tree = nodes(s, d).withColumn("kind", F.when(F.col("kind") == "root", "lost root").otherwise(F.col("kind")))
    moved = vecs(s, d).withColumn("root", F.when(F.col("doc_id") % 40 == 11, "other").otherwise(F.col("root")))
    return T.check_build(tree, members(s, d).filter("doc_id % 100 <> 7"), e, moved, 0.3, 8)


def leaves(s: SparkSession, d: str) -> DataFrame:
    c = C.centroids(vecs(s, d).withColumn("node", F.concat_ws("/", "root", "leaf", F.col("doc_id") % 3)), "node")
    split = lambda i: F.split_part("node", F.lit("/"), F.lit(i))
    return c.select(F.col("node").alias("leaf"), F.concat(split(1), F.lit("/"), split(2)).alias("branch"), split(1).alias("root"), F.round(F.col("centroid")[0], 6).alias("distance"))


LEAVES = f"""{VSQL}, lv AS (SELECT root || '/' || leaf || '/' || (doc_id % 3) AS node, i AS pos, sum(vector[i]) AS x FROM (SELECT *, unnest(generate_series(1, 64)) AS i FROM v) GROUP BY ALL),
lf AS (SELECT node AS leaf, split_part(node, '/', 1) || '/' || split_part(node, '/', 2) AS branch, split_part(node, '/', 1) AS root, round(max(x) FILTER (pos = 1) / sqrt(sum(x * x)), 6) AS distance FROM lv GROUP BY node),
rk AS (SELECT *, count(*) OVER (PARTITION BY root) AS leaves, row_number() OVER (PARTITION BY root ORDER BY distance DESC, leaf) AS far FROM lf),
mk AS (SELECT *, leaves > 3 AND far = 1 AS free, count_if(NOT (leaves > 3 AND far = 1)) OVER (PARTITION BY root, branch) AS m FROM rk),
pl AS (SELECT *, leaves > 3 AND NOT free AND m >= 2 AS region FROM mk),
scopes AS (SELECT 'system:' || leaf AS scope_id, 'system' AS role, CASE WHEN region THEN 'region:' || branch ELSE 'galaxy:' || root END AS parent, leaf AS semantic_id FROM pl
UNION ALL SELECT DISTINCT 'region:' || branch, 'region', 'galaxy:' || root, branch FROM pl WHERE region UNION ALL SELECT DISTINCT 'galaxy:' || root, 'galaxy', 'universe', root FROM pl)"""


@query(f"WITH {LEAVES} SELECT * FROM scopes")
def build_scopes(s: SparkSession, d: str) -> DataFrame:
    return T.build_scopes(leaves(s, d))


ROUTES = f"""{LEAVES}, ro AS (SELECT a.scope_id, list_filter([c.parent, b.parent, a.parent, a.scope_id], lambda x: x IS NOT NULL) AS route FROM scopes a LEFT JOIN scopes b ON a.parent = b.scope_id LEFT JOIN scopes c ON b.parent = c.scope_id WHERE a.role = 'system')"""


@query(f"WITH {ROUTES} SELECT scope_id, array_to_string(route, ' > ') AS route FROM ro")
def routes(s: SparkSession, d: str) -> DataFrame:
    return T.routes(build_scopes(s, d)).select("scope_id", F.array_join("route", " > ").alias("route"))


@query(f"""WITH {ROUTES}, n AS (SELECT 'system:' || root || '/' || leaf || '/' || (doc_id % 3) AS scope_id, count(*) AS n FROM v GROUP BY ALL), u AS (SELECT route, n, unnest(generate_series(1, len(route))) AS i FROM ro JOIN n USING (scope_id))
SELECT route[i] AS scope_id, sum(n)::BIGINT AS n_docs, count(DISTINCT route[i + 1]) AS n_children FROM u GROUP BY ALL""")
def scope_counts(s: SparkSession, d: str) -> DataFrame:
    n = vecs(s, d).groupBy(F.concat(F.lit("system:"), F.concat_ws("/", "root", "leaf", F.col("doc_id") % 3)).alias("scope_id")).agg(F.count("*").alias("n"))
    return T.scope_counts(T.routes(build_scopes(s, d)), n)


@query("""WITH g AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS i, count(*) OVER () AS m FROM (SELECT DISTINCT CAST(label % 4 AS VARCHAR) AS root FROM embeddings))
SELECT root, round(68 * sqrt(1 - (1 - 2 * (i + 0.5) / m) ** 2) * cos(i * 2.399963229728653), 5) AS x, round(68 * (1 - 2 * (i + 0.5) / m), 5) AS y FROM g""")
def galaxy_places(s: SparkSession, d: str) -> DataFrame:
    return T.fibonacci_sphere(vecs(s, d).select("root").distinct(), "root").select("root", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


# Catalogue

CHUNKS = "k AS (SELECT doc_id, text, lang, source, (row_number() OVER (ORDER BY doc_id) - 1) // 32 AS chunk FROM documents)"


@query(f"WITH {CHUNKS} SELECT doc_id, chunk FROM k")
def chunk_numbers(s: SparkSession, d: str) -> DataFrame:
    return K.chunk_numbers(read_documents(s, d), "doc_id").select("doc_id", "chunk")


@query(f"WITH {CHUNKS}, {KNN} SELECT src, dst, score, coalesce(a.chunk, b.chunk) AS chunk FROM knn LEFT JOIN k a ON a.doc_id = src LEFT JOIN k b ON b.doc_id = dst")
def catalog_edges(s: SparkSession, d: str) -> DataFrame:
    return K.catalog_edges(edges(s, d), chunk_numbers(s, d))


@query(f"""WITH {CHUNKS}, {MEMBERS} SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position, 'text:' || doc_id AS node, path AS parent, chunk, CASE WHEN length(text) > 22 THEN left(text, 21) || '…' ELSE text END AS label, lang, source, source AS title, sha256(text) AS text, lang AS category FROM k LEFT JOIN m USING (doc_id)""")
def catalog_index(s: SparkSession, d: str) -> DataFrame:
    docs = read_documents(s, d).withColumns({"title": F.col("source"), "category": F.col("lang")})
    return K.catalog_index(K.chunk_numbers(docs, "doc_id"), members(s, d)).withColumn("text", S.sha256_hex(F.col("text")))


@query(f"WITH {NODES} SELECT parent AS src, node AS dst, 'tree' AS type FROM nodes WHERE parent IS NOT NULL")
def topic_edges(s: SparkSession, d: str) -> DataFrame:
    """The manifest's edges: those of the tree; neighbours are between texts and stay in the shards."""
    texts = edges(s, d).select(F.concat(F.lit("text:"), "src").alias("src"), F.concat(F.lit("text:"), "dst").alias("dst"), F.lit("knn").alias("type"))
    return K.topic_graph(nodes(s, d), texts)[1]


@query(f"WITH {KNN} SELECT CASE WHEN score > 0.3 THEN 'strong' ELSE 'weak' END AS type, count(*) AS n FROM knn GROUP BY 1")
def catalog_manifest(s: SparkSession, d: str) -> DataFrame:
    return K.catalog_manifest(edges(s, d).withColumn("type", F.when(F.col("score") > 0.3, "strong").otherwise("weak")))


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 30 OFFSET 60")
def page_slice(s: SparkSession, d: str) -> DataFrame:
    return K.page_slice(read_documents(s, d), "doc_id", 2, 30).select("doc_id")


@query(f"WITH {CHUNKS} SELECT doc_id, chunk, sha256(text) AS sha FROM k")
def catalog_round_trip(s: SparkSession, d: str) -> DataFrame:
    path = fresh_path(s, "catalog")
    K.write_catalog(read_documents(s, d).repartition("doc_id"), edges(s, d), members(s, d), path)
    return K.read_catalog(s, path).select("doc_id", F.col("chunk").cast("long").alias("chunk"), S.sha256_hex(F.col("text")).alias("sha"))


@query(f"WITH {KNN} SELECT src, dst, score FROM knn")
def graph_round_trip(s: SparkSession, d: str) -> DataFrame:
    path = fresh_path(s, "graph")
    K.write_graph({"edges": edges(s, d), "nodes": nodes(s, d)}, path)
    return K.read_graph(s, path, ["edges"])["edges"]


@query(f"WITH {NODES} SELECT * FROM nodes")
def snapshot_round_trip(s: SparkSession, d: str) -> DataFrame:
    path = fresh_path(s, "snapshots")
    K.save_snapshot({"nodes": nodes(s, d).filter("depth = 0")}, path)
    K.save_snapshot({"nodes": nodes(s, d)}, path)
    return K.load_snapshot(s, path, ["nodes"])["nodes"]


@query(f"""WITH {LEAVES} SELECT scope_id, role || '-' || lower(printf('%X', list_reduce(list_transform(string_split(scope_id, ''), lambda c: ascii(c)::BIGINT), lambda h, c: (xor(h, c) * 16777619) & 4294967295, 2166136261::BIGINT))) AS chunk FROM scopes""")
def scope_chunks(s: SparkSession, d: str) -> DataFrame:
    path = fresh_path(s, "scopes")
    K.write_scopes(build_scopes(s, d), path)
    return s.read.parquet(path).select("scope_id", F.col("chunk").cast("string").alias("chunk"))


# Files: JSON texts made of the given documents


def json_files(s: SparkSession, d: str) -> DataFrame:
    """A JSON document of each shape for every eight documents, as read_json_files gives them."""
    n = F.col("doc_id") % 9
    t, i = F.col("source"), F.col("doc_id").cast("string")
    item = lambda *c: F.to_json(F.array(F.struct(*c)))
    one = item(i.alias("id"), t.alias("title"), F.col("lang").alias("summary"), F.concat(F.lit("https://x/"), i).alias("url"), F.lit("2026-01-02T03:04").alias("published"), F.lit("more").alias("full_content"))
    wrap = lambda key, value, meta="": F.concat(F.lit("{" + meta + f'"{key}":'), value, F.lit("}"))
    forms = [
        wrap("files", F.lit("[]")), wrap("nodes", F.lit("[]"), '"edges":[],'), wrap("overview_cards", item(i.alias("id"), t.alias("title"), F.col("lang").alias("summary"))), F.to_json(F.array(t, F.col("lang"))),
        wrap("items", one, '"meta":{"saved_at":"x"},'), wrap("items", one, '"meta":{"part":1},'), wrap("items", one), wrap("texts", one), F.lit("{broken"),
    ]
    text = F.element_at(F.array(*forms), (n + 1).cast("int"))
    rows = read_documents(s, d).select("doc_id", F.concat(i, F.lit(".json")).alias("path"), text.alias("text")).withColumn("doc", F.try_parse_json("text"))
    return rows.withColumn("format", Files.identify_format(F.col("doc")))


@query("SELECT vec_id AS doc_id, round(list_sum(embedding::DOUBLE[]), 6) AS total, len(embedding) AS width FROM embeddings")
def npy_round_trip(s: SparkSession, d: str) -> DataFrame:
    """The vectors, with their ids in front, written as NPY files and read back by ranges."""
    path = fresh_path(s, "npy")
    Ranges.write_npy(vecs(s, d).select(F.concat(F.array(F.col("doc_id").cast("double")), "vector").alias("vector")), path)
    rest = F.slice("vector", 2, 4096)
    return Ranges.read_npy(s, path).select(F.col("vector")[0].cast("long").alias("doc_id"), F.round(F.aggregate(rest, F.lit(0.0), lambda t, x: t + x), 6).alias("total"), F.size(rest).cast("long").alias("width"))


@query("SELECT doc_id, ['manifest', 'graph', 'briefing', 'array', 'timestamp-items', 'corpus-items', 'items', 'texts', NULL][doc_id % 9 + 1] AS format FROM documents")
def identify_format(s: SparkSession, d: str) -> DataFrame:
    return json_files(s, d).select("doc_id", "format")


@query("""WITH a AS (SELECT *, doc_id % 9 AS n FROM documents)
SELECT doc_id || '.json' AS path, 0 AS position, CASE WHEN n > 3 THEN CAST(doc_id AS VARCHAR) END AS id, source AS title, CASE WHEN n = 3 THEN source ELSE lang || chr(10) || chr(10) || 'more' END AS text, CASE WHEN n > 3 THEN lang END AS original_summary, CASE WHEN n > 3 THEN '2026-01-02' END AS date, CASE WHEN n > 3 THEN 1 ELSE 0 END AS links FROM a WHERE n BETWEEN 3 AND 7
UNION ALL SELECT doc_id || '.json', 1, NULL, lang, lang, NULL, NULL, 0 FROM a WHERE n = 3""")
def adapt_items(s: SparkSession, d: str) -> DataFrame:
    return Files.adapt_items(json_files(s, d)).select("path", "position", "id", "title", "text", "original_summary", "date", F.size("sources").alias("links"))


@query("SELECT doc_id || '.json' AS path, 'overview_cards' AS section, CAST(doc_id AS VARCHAR) AS id, source AS title, lang AS text FROM documents WHERE doc_id % 9 = 2")
def adapt_briefing(s: SparkSession, d: str) -> DataFrame:
    return Files.adapt_briefing(json_files(s, d)).select("path", "section", "id", "title", "text")


@query("SELECT 'data/' || page_id || '.json' AS path, page_id AS size, 'https://raw.example/o/r/abc/data/' || page_id || '.json' AS url FROM pages WHERE page_id % 3 = 0 AND page_id % 4 > 0")
def select_source_files(s: SparkSession, d: str) -> DataFrame:
    n = F.col("page_id")
    path = F.concat(F.when(n % 4 > 0, "data/").otherwise("other/"), n.cast("string"), F.when(n % 3 == 0, ".json").otherwise(".txt"))
    return Files.select_source_files(read_table(s, d, "pages").select(F.lit("blob").alias("type"), path.alias("path"), n.alias("size")), "tree", "data", "https://raw.example/o/r/abc")


# Streams


@query("SELECT doc_id, sha256('cfg' || chr(10) || text) AS row_key FROM documents")
def embed_stream(s: SparkSession, d: str) -> DataFrame:
    docs = s.read.parquet(f"{d}/documents.parquet")
    at = fresh_path(s, "stream")
    docs.write.parquet(f"{at}/in")
    s.createDataFrame([], "row_key string, vector array<double>").write.parquet(f"{at}/cache/batch=none")
    stream = s.readStream.schema(docs.schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/in")
    Inc.embed_stream(stream, f"{at}/cache", f"{at}/out", E.hashed_ngrams(), "cfg", f"{at}/state").awaitTermination()
    return s.read.parquet(f"{at}/out").select("doc_id", "row_key")


@query(f"""WITH {SUMS} SELECT doc_id, theme, score FROM (SELECT doc_id, c.leaf AS theme, round(list_dot_product(vector, centroid), 6) AS score FROM v CROSS JOIN c) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, theme) = 1""")
def assign_stream(s: SparkSession, d: str) -> DataFrame:
    v = vecs(s, d).select("doc_id", "vector", "leaf")
    at = fresh_path(s, "stream")
    v.repartition(3).write.parquet(f"{at}/in")
    themes = C.centroids(v, "leaf").withColumnRenamed("leaf", "theme")
    stream = s.readStream.schema(v.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")

    def batch(df: DataFrame, number: int) -> None:
        Inc.assign_stream(df, themes).write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{at}/out").select("doc_id", "theme", "score")
