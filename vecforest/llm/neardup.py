"""Near duplicates by bottom-k sketches from one hash function.

1. Every document's set of five-word shingles is hashed once; its k smallest
   hashes are its sketch. Documents with equal sets form a class, and only one
   row for each class goes on.
2. Two sets with a similarity of at least the threshold share LEAST_SHARED of
   their sketch values, but for a chance of about one in a million at the very
   threshold (five standard deviations; small sets are compared whole). So they
   share one of the sketch's first k - LEAST_SHARED + 1 values in any common
   order; rare values come first. Inverted lists of these values give overlaps.
3. Two documents are compared in the first list that both are in, and nowhere
   else. The sketch of their union filters pairs inside the task, which sends on
   only the documents that have a pair left, not the pairs.
4. Full sets follow those documents to the same groups and confirm links by
   100 * intersection >= 75 * union in whole numbers. A group sends a star for
   each set of documents that its links connect: fewer rows than it has documents.
5. Lists over HUB documents first compare every member with a hub, the least
   changed copy. Where such a list still holds several components, the members
   outside its largest component are compared with all of its members.

Groups are cut into blocks by hash, by the number of documents and by the size of
their sets, so that no list or hub is read whole by a task. None is cut short.
Sketches are compared by the upper halves of their values; equal halves of
different values can add a candidate and never take one away.

Defined results: null text counts as empty; texts without words have an empty
set, are linked with nothing and stay; repeated texts are one class; a document
with a null id takes no part in links and stays; where an id is repeated, each of
its rows is judged by its own text; a text of any length is one set, made
PART_BYTES at a time; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecforest.llm.common import drop_table, quoted, row_key, split_by, table, text_rows
from vecforest.llm.components import components
from vecforest.llm.textops import buffer_of, mix, parts_by_bytes, shingles, spare, tidy

K, LEAST_SHARED = 64, 30
#: Lists of more documents go over hubs; a block holds about so many documents and shingles.
HUB, BLOCK, BLOCK_VALUES = 128, 512, 1 << 21
#: Similarity as a fraction of whole numbers.
PART, WHOLE = 75, 100
NONE = np.uint32(0xFFFFFFFF)
GROUP = ["v", "i", "j"]
MEMBERS = "v long, i int, j int, lhs boolean, rhs boolean, rep long, component long, n long"


def _binary(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([x.tobytes() for x in arrays], pa.binary())


def _parts(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[list[pa.Array], pa.Array]]:
    for batch in batches:
        done = 0
        for texts in parts_by_bytes(batch["text"]):
            yield [batch[c].slice(done, len(texts)) for c in columns], texts
            done += len(texts)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, key, n (set size), two fingerprints of the set, the sketch (ascending 64-bit hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spare()
        for own, texts in _parts(batches, "doc_id", "key"):
            val, at = shingles(*buffer_of(texts), width)
            n = np.diff(at)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(val)])
            twice = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(val ^ np.uint64(0x5851F42D4C957F2D)))])
            one, two = ((s[at[1:]] - s[at[:-1]]).view(np.int64) for s in (sums, twice))
            yield pa.record_batch([*own, pa.array(n), pa.array(one), pa.array(two), _binary([val[a : min(b, a + K)] for a, b in zip(at[:-1], at[1:], strict=True)])], ["doc_id", "key", "n", "one", "two", "sketch"])

    return docs.select("doc_id", "key", "text").mapInArrow(tidy(run), "doc_id long, key binary, n long, one long, two long, sketch binary")


def values_of(reps: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(x) // 8 for x in batch["sketch"].to_pylist()], np.int64)
            v = np.frombuffer(b"".join(batch["sketch"].to_pylist()), np.int64)
            yield pa.record_batch([pa.array(np.repeat(batch["rep"].to_numpy(), sizes)), pa.array(v)], ["rep", "v"])

    return reps.select("rep", "sketch").mapInArrow(run, "rep long, v long")


def index_rows(reps: DataFrame) -> DataFrame:
    """Rows (v, rep, n, weight, small, before) of the inverted lists.

    weight: how common the document's values are, most for the least changed copy;
    small: the upper halves of the sketch, padded; before: the document's earlier list
    values, by which a pair is compared in its first common list only.
    """
    values = values_of(reps)
    common = table(values.groupBy("v").count().filter("count > 1").withColumnRenamed("count", "df"), "common")  # a table, so that a join with it can be split at hot values
    shared = values.join(common, "v").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("shared"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(s, 500) for b in batches for s in range(0, len(b), 500)):
            v, rep, n, weight, small, before = [], [], [], [], [], []
            for r, size, sketch, w, shared in zip(batch["rep"].to_pylist(), batch["n"].to_pylist(), batch["sketch"].to_pylist(), batch["weight"].to_pylist(), batch["v"].to_pylist(), strict=True):
                have = len(sketch) // 8
                prefix = have - min(-(-PART * size // WHOLE), LEAST_SHARED) + 1
                take = shared[: max(0, prefix - (have - len(shared)))]
                padded = np.full(K, NONE)
                padded[:have] = np.frombuffer(sketch, np.uint64) >> np.uint64(32)
                earlier = np.array(take, np.int64).tobytes()
                v += take
                rep += [r] * len(take)
                n += [size] * len(take)
                weight += [w] * len(take)
                small += [padded.tobytes()] * len(take)
                before += [earlier[: 8 * i] for i in range(len(take))]
            yield pa.record_batch([pa.array(v, pa.int64()), pa.array(rep, pa.int64()), pa.array(n, pa.int64()), pa.array(weight, pa.int64()), pa.array(small, pa.binary()), pa.array(before, pa.binary())], ["v", "rep", "n", "weight", "small", "before"])

    wide = reps.join(shared, "rep").select("rep", "n", "sketch", F.aggregate("shared", F.lit(0).cast("long"), lambda s, x: s + x["df"]).alias("weight"), F.col("shared.v").alias("v"))
    return wide.mapInArrow(tidy(run), "v long, rep long, n long, weight long, small binary, before binary")


def shared_part(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows of padded sketches: how many of the union's k least values both have, and how many values that sketch of the union has."""
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    real = both != NONE
    twin = np.zeros(both.shape, bool)
    twin[:, 1:] = (both[:, 1:] == both[:, :-1]) & real[:, 1:]
    rank = np.cumsum(real & ~twin, axis=1, dtype=np.int16)
    union = rank[:, -1]
    return (twin & (rank <= k)).sum(axis=1), np.minimum(union, k)


def may_link(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the sketch of the union allows the threshold."""
    shared, union = shared_part(a, b, K)
    return np.where(union < K, WHOLE * shared >= PART * union, shared >= LEAST_SHARED)


def sizes_fit(m: np.ndarray, n: np.ndarray) -> np.ndarray:
    return WHOLE * np.minimum(m, n) >= PART * np.maximum(m, n)


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of a partition that is sorted by GROUP, and where the groups start and end."""

    def starts(t: pa.Table) -> np.ndarray:
        v, i, j = (t[c].to_numpy() for c in GROUP)
        return np.concatenate([[0], 1 + np.flatnonzero((v[1:] != v[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))])

    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        t = pa.Table.from_batches([*rest, batch]).combine_chunks()
        at = starts(t)
        if at[-1]:
            yield t.slice(0, at[-1]), at
        rest = t.slice(at[-1]).to_batches()
    if rest:
        t = pa.Table.from_batches(rest).combine_chunks()
        yield t, np.append(starts(t), len(t))


def overlaps(of: np.ndarray, value: np.ndarray, a: np.ndarray, b: np.ndarray, n: int, width: int = 8192) -> np.ndarray:
    """How many values each of the documents a has in common with each of b; rows (of, value) are the sets of n documents."""
    known, column, count = np.unique(value, return_inverse=True, return_counts=True)
    column = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[column]
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    found = np.zeros((len(a), len(b)), np.float32)
    for base in range(0, int((count > 1).sum()), width):
        low, high = np.searchsorted(column, [base, base + width])
        grid = np.zeros((n, width), np.float32)
        grid[of[low:high], column[low:high] - base] = 1
        found += grid[a] @ grid[b].T
    return found


def pairs_of(lhs: np.ndarray, rhs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a group's rows, one of the left and one of the right side, each pair once."""
    a, b = np.flatnonzero(lhs), np.flatnonzero(rhs)
    x, y = np.repeat(a, len(b)), np.tile(b, len(a))
    once = (x < y) | ~(rhs[x] & lhs[y])
    return x[once], y[once]


def promising(small: np.ndarray, x: np.ndarray, y: np.ndarray, step: int = 20_000) -> np.ndarray:
    found = [may_link(small[x[s : s + step]], small[y[s : s + step]]) for s in range(0, len(x), step)]
    return np.concatenate(found) if found else np.zeros(0, bool)


def _sketch_rows(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t["small"].to_pylist()), np.uint32).reshape(-1, K)


def _met(early: list[bytes], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether two rows have an earlier list in common."""
    length = np.array([len(e) // 8 for e in early])
    if not length.any():
        return np.zeros(len(x), bool)
    if len(early) > 16:
        every = np.arange(len(early))
        return overlaps(np.repeat(every, length), np.frombuffer(b"".join(early), np.int64), every, every, len(early))[x, y] > 0
    sets = [set(np.frombuffer(e, np.int64).tolist()) for e in early]
    return np.array([not sets[a].isdisjoint(sets[b]) for a, b in zip(x.tolist(), y.tolist(), strict=True)], bool)


def candidates(rows: DataFrame) -> DataFrame:
    """Of each group's rows those that have a partner by the sketches: GROUP, lhs, rhs, rep, component, n."""
    columns = [c.split()[0] for c in MEMBERS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches):
            n, rep, component = (t[c].to_numpy() for c in ("n", "rep", "component"))
            lhs, rhs = (t[c].to_numpy(zero_copy_only=False) for c in ("lhs", "rhs"))
            before = t["before"].to_pylist()
            small = _sketch_rows(t)
            left, right = [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                x, y = (np.array([0]), np.array([1])) if b - a == 2 else pairs_of(lhs[a:b], rhs[a:b])
                x, y = x + a, y + a
                fits = (component[x] != component[y]) & sizes_fit(n[x], n[y])
                x, y = x[fits], y[fits]
                if len(x):
                    fresh = ~_met(before[a:b], x - a, y - a)
                    left.append(x[fresh]), right.append(y[fresh])
            x, y = (np.concatenate(s) if s else np.zeros(0, np.int64) for s in (left, right))
            keep = promising(small, x, y)
            rows = pa.array(np.unique(np.concatenate([x[keep], y[keep]])))
            yield pa.record_batch([t[c].combine_chunks().take(rows) for c in columns], columns)

    dealt = rows.select(*columns, "small", "before").repartition(*GROUP).sortWithinPartitions(*GROUP)
    return dealt.mapInArrow(tidy(run), MEMBERS)


def verified(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Stars (a, b) of what the confirmed links of each group connect, by full sets."""

    def links(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        component, n = group["component"].to_numpy(), group["n"].to_numpy()
        lhs, rhs = (group[c].to_numpy(zero_copy_only=False) for c in ("lhs", "rhs"))
        x, y = pairs_of(lhs, rhs)
        fits = (component[x] != component[y]) & sizes_fit(n[x], n[y])
        x, y = x[fits], y[fits]
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in group["set"]]
        small = np.full((len(sets), K), NONE)
        for r, s in enumerate(sets):
            small[r, : min(K, len(s))] = s[:K] >> np.uint64(32)
        keep = promising(small, x, y)
        x, y = x[keep], y[keep]
        if len(x) > 64:
            a, b = np.unique(x), np.unique(y)
            shared = overlaps(np.repeat(np.arange(len(sets)), n), np.concatenate(sets), a, b, len(sets))[np.searchsorted(a, x), np.searchsorted(b, y)].astype(np.int64)
        else:
            shared = np.zeros(len(x), np.int64)
            for k, (a, b) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
                both = np.sort(np.concatenate([sets[a], sets[b]]), kind="stable")
                shared[k] = (both[1:] == both[:-1]).sum()
        linked = WHOLE * shared >= PART * (n[x] + n[y] - shared)
        return x[linked], y[linked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches):
            rep = t["rep"].to_numpy()
            a, b = [], []
            for start, end in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                x, y = links(t.slice(start, end - start))
                low = rep[start:end].copy()  # the least document that the links reach, passed on until nothing changes
                while len(x):
                    least = np.minimum(low[x], low[y])
                    if (low[x] == low[y]).all():
                        break
                    np.minimum.at(low, x, least), np.minimum.at(low, y, least)
                far = np.flatnonzero(low != rep[start:end])
                a.append(low[far]), b.append(rep[start:end][far])
            yield pa.record_batch([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    dealt = members.join(sets, "rep").repartition(*GROUP).sortWithinPartitions(*GROUP)
    return dealt.mapInArrow(tidy(run), "a long, b long").distinct()


def blocks_of(count: Column, values: Column) -> Column:
    return F.ceil(F.greatest(count / BLOCK, values / BLOCK_VALUES)).cast("int")


def dealt_lists(rows: DataFrame) -> DataFrame:
    """Groups of lists: rows with lhs (in the left side), rhs, and the numbers of blocks of both sides.

    Lists of one block are one group. Others are dealt by hash: a row stands in its
    own block of a side, and meets every block of the other.
    """
    own = lambda blocks: F.pmod(F.xxhash64("rep"), F.col(blocks).cast("long")).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    rest = ["rep", "component", "n", "small", "before"]
    alone = rows.filter("lefts = 1 and rights = 1").select("v", F.lit(0).alias("i"), F.lit(0).alias("j"), "lhs", "rhs", *rest)
    several = rows.filter("lefts > 1 or rights > 1")
    left = several.filter("lhs").select("v", own("lefts").alias("i"), every("rights").alias("j"), F.lit(True).alias("lhs"), F.lit(False).alias("rhs"), *rest)
    right = several.filter("rhs").select("v", every("lefts").alias("i"), own("rights").alias("j"), F.lit(False).alias("lhs"), F.lit(True).alias("rhs"), *rest)
    return alone.unionByName(left).unionByName(right)


def hub_groups(rows: DataFrame) -> DataFrame:
    """Each member of a long list with the list's least changed document, and with the smallest one that shares its first two sketch values."""
    best = table(rows.groupBy("v").agg(F.max(F.struct("weight", (-F.col("rep")).alias("rep"))).alias("hub")).select("v", (-F.col("hub.rep")).alias("hub")), "hubs")
    once = table(rows.groupBy("rep").agg(F.first("n").alias("n"), F.first("small").alias("small")), "members")
    start = F.substring("small", 1, 8).alias("s")
    least = table(once.groupBy(start).agg(F.min("rep").alias("hub")), "hubs")
    by_list = rows.select("v", "rep").join(best, "v").select("rep", "hub")
    by_sketch = once.select("rep", start).join(least, "s").select("rep", "hub")
    met = table(by_list.unionByName(by_sketch).filter("rep <> hub").distinct().join(once.select("rep", "n", "small"), "rep"), "met")
    sizes = table(met.groupBy("hub").agg(blocks_of(F.count("*"), F.sum("n")).alias("blocks")), "sizes")
    members = met.join(sizes, "hub").select(F.col("hub").alias("v"), F.pmod(F.xxhash64("rep"), F.col("blocks").cast("long")).cast("int").alias("i"), F.lit(False).alias("lhs"), "rep", "n", "small")
    hubs = sizes.join(once, F.col("hub") == F.col("rep")).select(F.col("hub").alias("v"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.lit(True).alias("lhs"), "rep", "n", "small")
    return members.unionByName(hubs).select("v", "i", F.lit(-1).alias("j"), "lhs", (~F.col("lhs")).alias("rhs"), "rep", F.col("rep").alias("component"), "n", "small", F.lit(b"").alias("before"))


def sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(rep, set) for wanted rows (rep, key). Sets are made again, for these documents only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, texts in _parts(batches, "rep"):
            val, at = shingles(*buffer_of(texts), width)
            yield pa.record_batch([*own, _binary([val[a:b] for a, b in zip(at[:-1], at[1:], strict=True)])], ["rep", "set"])

    some, _ = split_by(docs, "key", wanted)
    return some.join(wanted, "key").dropDuplicates(["rep"]).select("rep", "text").mapInArrow(tidy(run), "rep long, set binary")


def judged(docs: DataFrame, width: int) -> DataFrame:
    """One row per row of docs (doc_id, key, text): doc_id, key, n_shingles, component_id, kept."""
    made = table(sketches(docs, width), "sketches")
    classes = made.filter("n > 0 and doc_id is not null").groupBy("n", "one", "two").agg(F.min(F.struct("doc_id", "key")).alias("first"), F.first("sketch").alias("sketch"))
    reps = table(classes.select(F.monotonically_increasing_id().alias("rep"), "n", "one", "two", F.col("first.doc_id").alias("least"), F.col("first.key").alias("key"), "sketch"), "reps")
    sketched, made = made, table(made.select("doc_id", "key", "n", "one", "two"), "rows")
    drop_table(sketched)
    rows = table(index_rows(reps), "lists")
    sizes = table(rows.groupBy("v").agg(F.count("*").alias("m"), F.sum("n").alias("values")).filter("m > 1"), "sizes")
    blocks = blocks_of(F.col("m"), F.col("values"))
    short = rows.join(sizes.filter(F.col("m") <= HUB), "v").select("*", F.col("rep").alias("component"), F.lit(True).alias("lhs"), F.lit(True).alias("rhs"), blocks.alias("lefts"), blocks.alias("rights"))
    long = table(rows.join(sizes.filter(F.col("m") > HUB), "v"), "long")
    first = table(candidates(dealt_lists(short).unionByName(hub_groups(long))), "candidates")
    drop_table(rows)
    wanted = first.select("rep").unionByName(long.select("rep")).distinct().join(reps.select("rep", "key"), "rep")
    sets = table(sets_of(docs, table(wanted, "wanted"), width), "sets")
    links = table(verified(first, sets), "links")
    found = components(links)
    # Long lists that are not yet one component: what is outside the largest one meets all.
    labelled = table(long.join(found.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")), "labelled")
    parts = labelled.groupBy("v", "component").agg(F.count("*").alias("m"), F.sum("n").alias("values"))
    open_lists = table(
        parts.groupBy("v").agg(F.max(F.struct("m", "values", "component")).alias("most"), F.sum("m").alias("m"), F.sum("values").alias("values")).filter("m > most.m")
        .select("v", F.col("most.component").alias("largest"), blocks_of(F.col("m") - F.col("most.m"), F.col("values") - F.col("most.values")).alias("lefts"), blocks.alias("rights")),
        "open",
    )
    if not open_lists.isEmpty():
        rest = labelled.drop("m", "values").join(open_lists, "v").withColumn("lhs", F.col("component") != F.col("largest")).withColumn("rhs", F.lit(True))
        second = table(candidates(dealt_lists(rest)), "candidates")
        found = components(links.unionByName(table(verified(second, sets), "links")))
    grouped = reps.select("rep", "n", "one", "two", "least").join(found.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    grouped = table(grouped, "grouped")
    ids = table(grouped.groupBy("component").agg(F.min("least").alias("component_id")), "ids")
    by_set = table(grouped.join(ids, "component").select("n", "one", "two", "component_id"), "by_set")
    out = made.join(by_set, ["n", "one", "two"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "key", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"))


def near_duplicates(df: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable over links), kept."""
    docs = text_rows(df, id_col, text_col)
    return judged(docs.withColumn("key", row_key("doc_id", "text")), width).drop("key")


def drop_near_duplicates(df: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: of each group of linked documents the one with the smallest id."""
    docs = text_rows(df, id_col, text_col)
    dropped = table(judged(docs.withColumn("key", row_key("doc_id", "text")), width).filter("not kept").select("key").distinct(), "dropped")
    rows = df.select(F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("row"), row_key(F.col(id_col).cast("long"), text_col).alias("key"))
    some, rest = split_by(rows, "key", dropped)
    return some.join(dropped, "key", "left_anti").select("row.*").unionByName(rest.select("row.*"))
