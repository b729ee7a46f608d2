"""Quality by an interpolated modified Kneser-Ney model over bytes, one per language.

Words differ from text to text far more than their spelling does, so the n-grams are of
bytes: on the tables given, few words of a new document are known, but nearly all its
5-grams of bytes are. Counts of all byte n-grams of the trusted documents are summed
over the cluster; counts of lower orders, discounts, context sums and probabilities
follow by joins of count tables, sharded by model and n-gram. Documents are dealt to
two folds by hash, and each is scored with the counts of the other fold, so that
trusted documents' own counts do not flatter them. A document's perplexity is that of
its bytes. It is rejected above a quantile of the trusted documents of its language
and size class (powers of four bytes), widened by TOLERANCE; classes with fewer
than LEAST_TRUSTED trusted documents use the language's quantile, and languages
with fewer reject nothing.

Scoring is by sharded count joins at every size. The n-grams of all documents are
counted, and each distinct one is looked up once, order by order, by joins with the
model's tables (looked_up). The commonest HEAD of them, a fixed number, are sent to the
tasks, which sum them up for each document as they read its text; the others go as
rows (document, n-gram, count) to the shards and meet their probabilities in a join.

Defined results: null text counts as empty; a text without bytes has no perplexity
and stays; a null language is a language of its own; labels that are repeated for
a document count by the least quality and the largest toxicity; documents with a
null id are scored but never trusted; a text of any length is scored whole, GRAM_PART
at a time; rows that are repeated are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vecforest.llm.common import drop_table, quoted, row_key, split_by, table, union_of, whole_text
from vecforest.llm.textops import buffer_of, parts_by_bytes, spare

ORDER, QUANTILE, TOLERANCE, LEAST_TRUSTED = 5, 0.995, 1.1, 30
#: N-grams that every task holds (16 bytes each), whatever the size of the corpus or of the model.
HEAD = 1 << 19
#: Bytes of text whose n-grams are in memory at once: some 80 bytes of arrays for each.
GRAM_PART = 1 << 18
#: N-grams that a task counts before it sends their sums on.
COUNTED = 1 << 20
START = 2  # the byte that stands before each text


def grams_of(raw: np.ndarray, off: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte, as a number of `order` bytes, and each byte's document."""
    n_docs = len(off) - 1
    doc = np.repeat(np.arange(n_docs), np.diff(off))
    depth = np.arange(len(raw)) - off[:-1][doc]
    gram = np.zeros(len(raw), np.int64)
    for back in range(order - 1, -1, -1):
        byte = np.full(len(raw), START, np.int64)
        byte[back:] = raw[: len(raw) - back]
        byte[depth < back] = START
        gram = (gram << 8) | byte
    return gram, doc


def gram_parts(texts: pa.Array, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """grams_of() some texts; those of one long text come a part at a time."""
    raw, off = buffer_of(texts)
    if len(texts) > 1 or len(raw) <= 2 * GRAM_PART:
        yield grams_of(raw, off, order)
        return
    for begin in range(0, len(raw), GRAM_PART):
        before = min(begin, order - 1)
        part = raw[begin - before : begin + GRAM_PART]
        gram, doc = grams_of(part, np.array([0, len(part)]), order)
        yield gram[before:], doc[before:]


def counts(rows: DataFrame, order: int) -> DataFrame:
    """(model, gram, c) over rows (model, text), summed within each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spare()
        names: list[str] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []  # n-grams with the number of their model above them, and counts

        def summed() -> tuple[np.ndarray, np.ndarray]:
            both, c = (np.concatenate(x) for x in zip(*held, strict=True))
            found, inverse = np.unique(both, return_inverse=True)
            return found, np.bincount(inverse, weights=c).astype(np.int64)

        def sent() -> pa.RecordBatch:
            both, c = held[0]
            return pa.record_batch([pa.array(names, pa.string()).take(pa.array(both >> (8 * order))), pa.array(both & ((1 << 8 * order) - 1)), pa.array(c)], ["model", "gram", "c"])

        for batch in batches:
            done = 0
            for part in parts_by_bytes(batch["text"], GRAM_PART):
                coded = batch["model"].slice(done, len(part)).dictionary_encode()
                done += len(part)
                own = coded.dictionary.to_pylist()
                names += [x for x in own if x not in names]
                number = np.array([names.index(x) for x in own], np.int64)[coded.indices.to_numpy()]
                for gram, doc in gram_parts(part, order):
                    held.append(np.unique((number[doc] << (8 * order)) | gram, return_counts=True))
                    if sum(len(x) for x, _ in held) > COUNTED:
                        held[:] = [summed()]
                        if len(held[0][0]) > COUNTED // 2:
                            yield sent()
                            held.clear()
        if held:
            held[:] = [summed()]
            yield sent()
        held.clear()
        spare()

    return rows.select("model", "text").mapInArrow(run, "model string, gram long, c long").groupBy("model", "gram").agg(F.sum("c").alias("c"))


def probabilities(top: DataFrame, order: int) -> DataFrame:
    """(model, n, gram, p, back): the interpolated probability of each n-gram's last byte and, as a context, the logarithm of what it leaves to lower orders.

    Counts, discounts and context sums of all orders are made together; only the
    steps that need the order below them are a job for each order.
    """
    lower = lambda n: F.col("gram").bitwiseAND(F.lit((1 << 8 * n) - 1))
    tables = [top.select("model", F.lit(order).alias("n"), "gram", "c")]
    for n in range(order - 1, 0, -1):
        tables.append(table(tables[-1].groupBy("model", lower(n).alias("gram")).agg(F.count("*").alias("c")).select("model", F.lit(n).alias("n"), "gram", "c"), f"c{n}"))
    every = union_of(tables)
    of = [F.sum((F.col("c") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    discount = lambda k: F.greatest(F.lit(0.05), F.least(F.lit(k - 0.05), F.coalesce(k - (k + 1) * y * F.col(f"n{k + 1}") / F.nullif(F.col(f"n{k}"), F.lit(0)), F.lit(0.5 * k))))
    discounts = table(every.groupBy("model", "n").agg(*of).select("model", "n", *[discount(k).alias(f"d{k}") for k in (1, 2, 3)]), "discounts")  # one row per model and order
    d = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    with_d = every.join(discounts, ["model", "n"]).select("model", "n", "gram", "c", d.alias("d"), F.shiftright("gram", 8).alias("context"))
    sums = table(with_d.groupBy("model", "n", "context").agg(F.sum("c").alias("total"), F.sum("d").alias("left")), "sums")
    shares = with_d.join(sums, ["model", "n", "context"]).select("model", "n", "gram", ((F.col("c") - F.col("d")) / F.col("total")).alias("base"), (F.col("left") / F.col("total")).alias("rest"))
    shares = table(shares, "shares", by="n")
    for t in tables[1:]:
        drop_table(t)
    known: list[DataFrame] = []
    for n in range(1, order + 1):
        own = shares.filter(F.col("n") == n).drop("n")
        if not known:
            p = own.select("model", "gram", (F.col("base") + F.col("rest") / 256).alias("p"))
        else:
            below = known[-1].select("model", F.col("gram").alias("suffix"), F.col("p").alias("q"))
            p = own.withColumn("suffix", lower(n - 1)).join(below, ["model", "suffix"]).select("model", "gram", (F.col("base") + F.col("rest") * F.col("q")).alias("p"))
        known.append(table(p, f"p{n}"))
    out = union_of([p.select("model", F.lit(n).alias("n"), "gram", F.log("p").alias("p")) for n, p in enumerate(known, 1)])
    # A context of order n - 1 is stored under n - 1; the empty context under 0.
    contexts = sums.select("model", (F.col("n") - 1).alias("n"), F.col("context").alias("gram"), F.log(F.col("left") / F.col("total")).alias("back"))
    model = table(out.join(contexts, ["model", "n", "gram"], "full"), "model", by="n")
    for t in [shares, *known, sums]:
        drop_table(t)
    return model


def looked_up(asked: DataFrame, model: DataFrame, order: int) -> DataFrame:
    """(model, gram, c, log_p) for rows (model, gram, c): the logarithm of the last byte's probability, by joins with the sharded tables, order by order."""
    rows = asked.select("model", "gram", "c", F.col("gram").alias("rest"), F.lit(0.0).alias("sum"))
    found = []
    for k in range(order, 0, -1):
        p = model.filter((F.col("n") == k) & F.col("p").isNotNull()).select("model", F.col("gram").alias("rest"), "p")
        back = model.filter((F.col("n") == k - 1) & F.col("back").isNotNull()).select("model", F.col("gram").alias("context"), "back")
        met = table(rows.join(p, ["model", "rest"], "left"), f"looked{k}")
        found.append(met.filter("p is not null").select("model", "gram", "c", (F.col("sum") + F.col("p")).alias("log_p")))
        rest = met.filter("p is null").withColumn("context", F.shiftright("rest", 8)).join(back, ["model", "context"], "left")
        shorter = F.col("rest").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1)).alias("rest")
        rows = rest.select("model", "gram", "c", shorter, (F.col("sum") + F.coalesce("back", F.lit(0.0))).alias("sum"))
    out = rows.select("model", "gram", "c", (F.col("sum") - np.log(256)).alias("log_p"))
    for more in found:
        out = out.unionByName(more)
    return table(out, "grams")


def commonest(grams: DataFrame, most: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """The commonest n-grams and their log_p by model, at most `most` in all: those over a count that few enough reach."""
    bucket = F.floor(F.log2("c") * 8).cast("int")
    sizes = sorted(((r.bucket, r["count"]) for r in grams.groupBy(bucket.alias("bucket")).count().collect()), reverse=True)  # a few hundred rows
    n, least = 0, None
    for b, count in sizes:
        n += count
        if n > most:
            break
        least = b
    if least is None:
        return {}
    top = grams.filter(bucket >= least)
    names = {r.k: r.model for r in top.select("model", F.xxhash64("model").alias("k")).distinct().collect()}
    t = top.select(F.xxhash64("model").alias("k"), "gram", "log_p").toArrow()
    which, gram, log_p = (t[c].to_numpy() for c in ("k", "gram", "log_p"))
    out = {}
    for k, name in names.items():
        at = np.flatnonzero(which == k)
        at = at[np.argsort(gram[at])]
        out[name] = gram[at], log_p[at]
    return out


def scored(docs: DataFrame, grams: DataFrame, order: int, head: int) -> DataFrame:
    """log_p for each row of docs (doc_id, key, lang, model, text), which it keeps but for the text; n_bytes beside it."""
    shared = docs.sparkSession.sparkContext.broadcast(commonest(grams, head))
    spare()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spare()
        first = TaskContext.get().partitionId() << 40
        for batch in batches:
            done = 0
            for part in parts_by_bytes(batch["text"], GRAM_PART):
                own = [batch[c].slice(done, len(part)) for c in ("doc_id", "key", "lang", "model")]
                done += len(part)
                coded = own[-1].dictionary_encode()
                which, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
                total, size = np.zeros(len(part)), np.zeros(len(part), np.int64)
                left: list[np.ndarray] = []
                for gram, doc in gram_parts(part, order):
                    size += np.bincount(doc, minlength=len(part))
                    for i, name in enumerate(names):
                        at = np.flatnonzero(which[doc] == i)
                        distinct, inverse = np.unique(gram[at], return_inverse=True)
                        keys, log_p = shared.value.get(name, (np.zeros(0, np.int64), np.zeros(0)))
                        place = np.minimum(np.searchsorted(keys, distinct), max(len(keys) - 1, 0))
                        hit = keys[place] == distinct if len(keys) else np.zeros(len(distinct), bool)
                        value = np.zeros(len(distinct))
                        value[hit] = log_p[place[hit]]
                        total += np.bincount(doc[at], weights=value[inverse], minlength=len(part))
                        rare = at[~hit[inverse]]
                        left.append((doc[rare] << (8 * order)) | gram[rare])
                both, m = np.unique(np.concatenate(left), return_counts=True) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                doc, gram = both >> (8 * order), both & ((1 << 8 * order) - 1)
                row, rare = first + np.arange(len(part)), pa.array(doc)
                first += len(part)
                none = lambda kind, n: pa.nulls(n, kind)
                fields = ["row", "doc_id", "key", "lang", "model", "n_bytes", "log_p", "gram", "m"]
                yield pa.record_batch([pa.array(row), *own, pa.array(size), pa.array(total), none(pa.int64(), len(part)), none(pa.int64(), len(part))], fields)
                if len(doc):
                    yield pa.record_batch([pa.array(row).take(rare), none(pa.int64(), len(doc)), none(pa.binary(), len(doc)), none(pa.string(), len(doc)), own[3].take(rare), none(pa.int64(), len(doc)), none(pa.float64(), len(doc)), pa.array(gram), pa.array(m)], fields)
        spare()

    kept = table(docs.select("doc_id", "key", "lang", "model", "text").mapInArrow(run, "row long, doc_id long, key binary, lang string, model string, n_bytes long, log_p double, gram long, m long"), "scores")
    shared.destroy()
    rows = kept.filter("gram is null").drop("gram", "m")
    rare = kept.filter("gram is not null").select("row", "model", "gram", "m").join(grams.select("model", "gram", F.col("log_p").alias("p")), ["model", "gram"])
    sums = rare.groupBy("row").agg(F.sum(F.col("m") * F.col("p")).alias("more"))
    return rows.join(sums, "row", "left").withColumn("log_p", F.col("log_p") + F.coalesce("more", F.lit(0.0))).drop("more", "row")


def prepared(df: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("row"))
    rows = rows.withColumn("key", row_key("doc_id", "text"))
    # The fold by the text, so that copies of a trusted document are not scored with it.
    return rows.withColumn("fold", F.pmod(F.xxhash64("text", F.lit(7)), F.lit(2)).cast("int"))


def limits(seen: DataFrame, quantile: float, *by: str) -> DataFrame:
    """The quantile of the perplexities of each group, from counts of steps of a thousandth, so that it does not depend on the order of rows."""
    steps = seen.groupBy(*by, F.ceil(F.log("perplexity") * 1000).alias("step")).agg(F.count("*").alias("m"))
    upto = W.partitionBy(*by).orderBy("step")  # a group has one row for each step, some thousands
    total = F.sum("m").over(W.partitionBy(*by))
    reached = steps.withColumn("upto", F.sum("m").over(upto)).withColumn("total", total).filter(F.col("total") >= LEAST_TRUSTED).filter(F.col("upto") >= F.col("total") * quantile)
    return table(reached.groupBy(*by).agg(F.exp(F.min("step") / 1000).alias("limit")), "limits")


def quality(df: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE, tolerance: float = TOLERANCE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", head: int = HEAD) -> DataFrame:
    """One row per document: doc_id, key, lang, n_bytes, perplexity, threshold, kept. The result does not depend on head."""
    rows = prepared(df, id_col, text_col, lang_col)
    trusted = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    trusted = table(trusted.filter("doc_id is not null and quality = 1 and coalesce(toxic, 0) = 0").select("doc_id"), "trusted")
    some, _ = split_by(rows.select("doc_id", "text", "lang", "fold"), "doc_id", trusted)
    model_of = lambda fold: F.concat_ws("|", fold.cast("string"), "lang").alias("model")
    top = table(counts(some.join(trusted, "doc_id").select(model_of(F.col("fold")), "text"), order), "counts")
    model = probabilities(top, order)
    known = table(top.select("model").distinct(), "models")
    docs = rows.select("doc_id", "key", "lang", model_of(1 - F.col("fold")), "text")
    judged = docs.join(known, "model", "left_semi")
    grams = looked_up(table(counts(judged, order), "asked"), model, order)
    done = scored(judged, grams, order, head)
    rest = docs.join(known, "model", "left_anti").select("doc_id", "key", "lang", "model", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(None).cast("double").alias("log_p"))
    every = done.unionByName(rest).select("doc_id", "key", "lang", "n_bytes", F.when(F.col("n_bytes") > 0, F.exp(-F.col("log_p") / F.col("n_bytes"))).alias("perplexity"), F.floor(F.log2(F.greatest("n_bytes", F.lit(1))) / 2).cast("int").alias("size"))
    every = table(every, "perplexity")
    seen = table(every.filter("perplexity is not null").join(trusted, "doc_id", "left_semi").select("lang", "size", "perplexity"), "seen")
    fine, coarse = limits(seen, quantile, "lang", "size"), limits(seen, quantile, "lang").withColumnRenamed("limit", "coarse")
    # A row for each language and size: as tables of known size, Spark sends them out itself where they are small.
    out = every.join(fine, ["lang", "size"], "left").join(coarse, "lang", "left")
    threshold = F.coalesce("limit", "coarse") * tolerance
    return out.select("doc_id", "key", "lang", "n_bytes", "perplexity", threshold.alias("threshold"), F.coalesce(F.col("perplexity") <= threshold, F.lit(True)).alias("kept"))


def drop_low_quality(df: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows that stay, with all their columns."""
    rejected = table(quality(df, labels, **options).filter("not kept").select("key").distinct(), "rejected")
    columns = {k: options[k] for k in ("id_col", "text_col", "lang_col") if k in options}
    rows = prepared(df, columns.get("id_col", "doc_id"), columns.get("text_col", "text"), columns.get("lang_col", "lang")).select("key", "row")
    some, rest = split_by(rows, "key", rejected)
    return some.join(rejected, "key", "left_anti").select("row.*").unionByName(rest.select("row.*"))
