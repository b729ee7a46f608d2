"""The training-data operators against plain versions, on awkward rows and on the small given tables."""

import collections
import hashlib
import random

import brute
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vecforest.llm import ann, binary, bpe, common, components, exact, lines, neardup, packing, quality, suffixes, textops, unigram

SF = "/root/testdata/sf0.001"
JSON, RANKS, PIECES = (P.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def by_id(df, *columns):
    return {r.doc_id: tuple(r[c] for c in columns) for r in df.collect()}


# Exact duplicates


def test_exact(docs, texts):
    groups = collections.defaultdict(list)
    for i, t in texts.items():
        groups[t or ""].append(i)
    got = by_id(exact.exact_duplicates(docs), "keep_id", "group_size", "kept", "text_sha256")
    assert got == {i: (max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}


def test_exact_keeps_rows(docs, texts):
    got = exact.drop_exact_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted(r.text or "" for r in got.collect()) == sorted({t or "" for t in texts.values()})


def test_exact_odd_ids(odd_ids):
    got = exact.exact_duplicates(odd_ids).collect()
    assert len(got) == 7 and sum(r.group_size == 4 for r in got) == 4
    assert exact.drop_exact_duplicates(odd_ids).count() == 3


def test_a_filter_of_many_shards_lets_unique_rows_pass(spark, monkeypatch, docs, texts):
    monkeypatch.setattr(common, "SHARD_BITS", common.BITMAP_BITS)
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 100 == 0, "same").otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    assert common.filter_size(20_000) == (16, 1)
    keys = rows.select(F.xxhash64("text").alias("__key"))
    may = common.flagged(keys, "__key", keys, (16, 1), common.repeated_filter, "maybe").filter("maybe").count()
    assert 200 <= may < 2000  # at 16 bits a row few others look repeated, at one shard nearly all would
    got = exact.exact_duplicates(rows).collect()
    assert len(got) == 20_000 and sum(r.kept for r in got) == 19_801
    assert exact.drop_exact_duplicates(rows).count() == 19_801
    some, rest = common.split_by(rows, "doc_id", spark.range(0, 20_000, 3).withColumnRenamed("id", "doc_id"))
    assert some.count() + rest.count() == 20_000 and rest.filter("doc_id % 3 = 0").isEmpty() and rest.count() > 10_000


# Tokens


@pytest.fixture(scope="module")
def tokens(texts):
    return dict(zip(texts, brute.token_lists(texts.values()), strict=True))


def test_token_files(spark, docs, texts, tokens, tmp_path, monkeypatch):
    monkeypatch.setattr(binary, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(binary, "PART_BYTES", 60_000)
    path = f"file://{tmp_path}/files"
    binary.write_token_files(docs, path, JSON, 2, 50257)
    start, want = 0, {}
    for i in sorted(texts):
        want[i] = (start, len(tokens[i]), brute.crc(tokens[i]), tokens[i])
        start += len(tokens[i])
    assert by_id(binary.read_token_files(spark, path), "start", "n_tokens", "ids_crc32", "ids") == want
    assert by_id(binary.read_token_files(spark, path, [5, 17]), "ids") == {i: (tokens[i],) for i in (5, 17)}
    assert spark.read.parquet(f"{path}/blocks").count() > 3


def test_ids_of_texts_with_added_tokens():
    from vecforest.llm.tokens import encode_batch

    texts = ["hello <|endoftext|> world<|endoftext|>", "<|endoftext", "|>, <|endoftext|>|>", "a<|endof|text|>", None, "x<|endoftext|><|endoftext|>y"]
    ids, off = encode_batch(pa.array(texts), JSON, 2)
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == brute.token_lists(texts)
    assert ids[:4].tolist() == [31373, 220, 50256, 995]


def odd_words(n, seed=3):
    import random

    rnd = random.Random(seed)
    some = lambda signs, k: "".join(rnd.choice(signs) for _ in range(rnd.randint(0, k)))
    gaps = [" ", " ", " ", "\n", "  ", "\t", " \n", "\u00a0", "\u3000", "\u0085"]
    return [some("abcdefgéèñß×÷äŁжш'1234", 9) + some("!,.|$%'é÷×\u00bd日🙂s", 2) + rnd.choice(gaps) for _ in range(n)]


def test_ids_of_pieces_in_one_string(monkeypatch):
    from vecforest.llm import tokens

    words = odd_words(12_000)
    texts = ["".join(words[i : i + 300]) for i in range(0, len(words), 300)] + [w.strip() + e for w in words[:200] for e in ("", "<|endoftext|>", " <|endof", "text|>")]
    want = brute.token_lists(texts)
    for pieces, joined in ((200_000, 64), (2_000, 7)):
        monkeypatch.setattr(tokens, "MEMO_PIECES", pieces)
        monkeypatch.setattr(tokens, "JOINED", joined)
        tokens.memo.cache_clear()
        for s in (0, 10, 20, 30, 0, 10):  # again, with pieces that are still known and others that were forgotten
            part = slice(s, s + 10 if s < 30 else None)
            ids, off = tokens.encode_batch(pa.array(texts[part]), JSON, 2)
            assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == want[part]
    # Ids whose bytes do not end with the pieces: one by one.
    tokens.memo.cache_clear()
    monkeypatch.setattr(tokens, "id_bytes", lambda path: np.full(60_000, 3))
    ids, off = tokens.encode_batch(pa.array(texts), JSON, 2)
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == want
    tokens.memo.cache_clear()


def test_few_strings_are_encoded(monkeypatch):
    from vecforest.llm import tokens

    strings, real = [], tokens.tokenizer(JSON)

    class Counted:
        def __getattr__(self, name):
            return getattr(real, name)

        def encode_batch_fast(self, texts, **how):
            strings.extend(texts)
            return real.encode_batch_fast(texts, **how)

    monkeypatch.setattr(tokens, "tokenizer", lambda path: Counted())
    tokens.memo.cache_clear()
    text = " ".join(f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzäéüö'[i // 100 % 10]}{'aeiouäéüöy'[i // 1000]}" for i in range(10_000))
    ids, _ = tokens.encode_batch(pa.array([text]), JSON, 2)
    tokens.memo.cache_clear()
    assert ids.tolist() == brute.token_lists([text])[0] and len(strings) <= 200


def test_packing_leaves_no_pieces_in_workers(spark, docs):
    assert packing.pack_documents(docs, JSON, 2).count() > 0

    def held(batches):
        from vecforest.llm import tokens

        for batch in batches:
            yield pa.record_batch([pa.array([tokens.memo.cache_info().currsize] * len(batch))], ["held"])

    assert spark.range(0, 64, 1, 16).mapInArrow(held, "held long").agg(F.max("held")).first()[0] == 0


def test_token_files_with_odd_ids(odd_ids):
    got = binary.token_file_digests(odd_ids, JSON, 2, 50257).collect()
    assert len(got) == 7 and [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [None, None, 1, 1, 1, 2, 3]


def test_packing(docs, texts, tokens):
    rows = packing.pack_documents(docs, JSON, 2, 128).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert pieces.keys() == texts.keys()
    for i, p in pieces.items():
        at = 0
        for k, r in enumerate(sorted(p, key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (k, at, brute.crc(tokens[i][at : at + r.length])) and (k == 0 or r.length == 128)
            at += r.length
        assert at == len(tokens[i])
    for p in sequences.values():
        at = 0
        for r in sorted(p, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 128
    total = sum(map(len, tokens.values()))
    assert len(sequences) <= 1.02 * -(-total // 128) + 1


def test_packing_of_equal_lengths(spark):
    items = spark.range(3000).select(F.col("id"), F.when(F.col("id") < 2000, 34).otherwise(33).cast("long").alias("length"))
    placed = packing.best_fit(items, 100).join(items, "id").groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert max(r.n for r in placed) <= 100 and len(placed) <= 1350


def test_byte_bpe(docs, texts):
    got = by_id(bpe.bpe_round_trip(docs, RANKS, P.PATTERN), "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == dict(zip(texts, brute.bpe(texts.values()), strict=True))


def test_byte_bpe_of_parts(texts):
    enc = bpe.encoding(RANKS, P.PATTERN)
    for t in texts.values():
        assert bpe.encode(t or "", RANKS, P.PATTERN, long=50, huge=100) == enc.encode_ordinary(t or "")


def test_unigram_counts(spark, docs, texts):
    from sentencepiece import SentencePieceProcessor
    from sentencepiece import sentencepiece_model_pb2 as M

    m = M.ModelProto()
    m.ParseFromString(open(PIECES, "rb").read())
    m.trainer_spec.model_type = 1
    least = min(p.score for p in m.pieces if p.type == 1 and p.score > -1e8)
    for p in m.pieces:
        p.score = least - 1 if p.score <= -1e8 else p.score
    sp = SentencePieceProcessor(model_proto=m.SerializeToString())
    short = {i: t for i, t in texts.items() if len(t or "") < 800}
    got = by_id(unigram.token_counts(docs, PIECES), "n_tokens")
    assert {i: got[i][0] for i in short} == {i: len(sp.encode(t or "")) for i, t in short.items()}
    whole = unigram.counter(PIECES)
    assert all(got[i][0] == whole.count(("▁" + t.replace(" ", "▁")) if t else "") for i, t in texts.items())


# Near duplicates


def test_near_duplicates(docs, texts):
    want = {i: (n, c, c == i) for i, (n, c) in brute.near(texts).items()}
    assert by_id(neardup.near_duplicates(docs), "n_shingles", "component_id", "kept") == want
    assert want[9][1] == want[10][1] == want[11][1] == 9
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, w in want.items() if w[2]}


@pytest.mark.parametrize(("hub", "block", "values"), [(128, 512, 1 << 21), (1, 7, 1 << 21), (128, 512, 300)])
def test_near_duplicates_in_long_lists(spark, monkeypatch, hub, block, values):
    """A chain of near copies, a cluster of them and many texts with one passage; long lists take the way over hubs, and blocks hold few documents or few shingles."""
    for name, value in (("HUB", hub), ("BLOCK", block), ("BLOCK_VALUES", values)):
        monkeypatch.setattr(neardup, name, value)
    rnd = random.Random(1)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(90)]
    rows, at = [], list(base)
    for _ in range(14):
        for _ in range(2):
            at[rnd.randrange(90)] = f"c{rnd.randrange(10**6)}"
        rows.append(" ".join(at))
    for _ in range(14):
        copy = list(base)
        copy[rnd.randrange(90)] = f"d{rnd.randrange(10**6)}"
        rows.append(" ".join(copy))
    for _ in range(14):
        rows.append(" ".join(base[:50] + [f"e{rnd.randrange(10**6)}" for _ in range(rnd.randrange(10, 60))]))
    texts = dict(enumerate(rows))
    got = by_id(neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")), "n_shingles", "component_id")
    assert got == brute.near(texts)


def test_near_duplicates_odd_ids(odd_ids):
    got = neardup.near_duplicates(odd_ids).collect()
    assert len(got) == 7 and all(r.kept for r in got if r.doc_id is None)
    assert {r.component_id for r in got if r.doc_id in (1, 3) and r.n_shingles == 3} == {1}


def test_rows_of_a_repeated_id_are_judged_by_their_own_texts(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text), (2, "clean text of its own here"), (2, text + " more")]
    kept = neardup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted(rows[:2])


def test_long_words_that_sums_do_not_tell_apart(spark):
    """Thue-Morse words of 2,048 bytes have the same polynomial hash modulo 2**64 at any odd multiplier."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    b = a.translate(str.maketrans("ab", "ba"))
    six = "one two three four five six "
    rows = [(1, a), (2, b), (3, six + a), (4, six + b), (5, six + a + " end")]
    got = {r.doc_id: (r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (c, i == c) for i, (_, c) in brute.near(dict(rows)).items()} and [got[i][1] for i in range(1, 5)] == [True] * 4


def test_near_duplicates_of_a_million_words(spark):
    rnd = random.Random(3)
    long = [f"w{rnd.randrange(300_000)}" for _ in range(1_000_000)]
    texts = {0: " ".join(long), 1: " ".join(long[:900_000]), 2: " ".join(long[400_000:]), 3: "short text of five words"}
    got = by_id(neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")), "n_shingles", "component_id")
    assert got == brute.near(texts)


def test_components(spark):
    links = [(1, 2), (2, 3), (4, 3), (10, 11), (7, 7)] + [(i, i + 1) for i in range(20, 60)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10} | {i: 20 for i in range(20, 61)}


# Repeats


@pytest.mark.parametrize("many", [20_000, 1])
def test_long_repeats(docs, texts, many):
    got = by_id(suffixes.without_repeats(docs, 60, gram=20, many=many), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.repeats(texts, 60)


def test_long_repeats_of_few_letters(spark):
    import random

    rnd = random.Random(2)
    texts = {i: "".join(rnd.choice("ab") for _ in range(rnd.randrange(200))) for i in range(40)}
    got = by_id(suffixes.without_repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 12, gram=4), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.repeats(texts, 12)


def test_long_repeats_of_odd_ids(odd_ids):
    got = suffixes.without_repeats(odd_ids, 10, gram=4).collect()
    assert sorted(r.n_removed for r in got) == [0, 0, 0, 13, 13, 13, 13]


def test_repeated_lines(spark):
    block = [f"line number {i}" for i in range(30)]
    texts = {0: "\n".join(block), 1: "\n".join(["head", *block, "tail"]), 2: "\n".join(f"own {i}" for i in range(30)), 3: None, 4: "a\n\n\n\nb\n"}
    rows = {r.doc_id: r for r in lines.without_repeated_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), keep=("text",)).collect()}
    assert rows[0].n_removed_chunks == 0 and rows[2].n_removed_bytes == 0 and rows[3].n_lines == 0
    assert 10 < rows[1].n_removed_lines <= 30 and rows[1].row.text == texts[1]
    kept = rows[1].kept_text.split("\n")
    assert set(kept) <= {"head", "tail", *block} and len(kept) == 32 - rows[1].n_removed_lines
    for r in rows.values():
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256


def plain_chunk_dedup(texts):
    """What goes of each text, line by line: chunks that repeat, and the chunks beside them, bring their pairs of filled lines; of equal pairs the first place stays."""
    chunks = {i: textops_chunks((t or "").encode()) for i, t in texts.items()}
    count = collections.Counter((texts[i] or "").encode()[b:e] for i, c in chunks.items() for b, e, _, filled in c if filled > 1)
    pairs, seen = collections.defaultdict(list), {}
    for i in sorted(texts):
        raw = (texts[i] or "").encode()
        hit = [filled > 1 and count[raw[b:e]] > 1 for b, e, _, filled in chunks[i]]
        near = [any(hit[max(0, k - 1) : k + 2]) for k in range(len(hit))]
        which = lambda at, i=i: max(k for k, c in enumerate(chunks[i]) if c[0] <= at)
        at, full = 0, []
        for n, row in enumerate(raw.split(b"\n")):
            if row:
                full.append((n, at, at + len(row)))
            at += len(row) + 1
        for (n, b, _), (m, c, e) in zip(full[:-1], full[1:], strict=True):
            if near[which(b)] and near[which(c)]:
                pairs[raw[b:e]].append((i, n, m))
    gone = collections.defaultdict(set)
    for places in pairs.values():
        i, n, m = places[0]
        for j, a, b in places[1:]:
            gone[j] |= set(range(b if j == i and a <= m else a, b + 1))
    return gone


def repeated_runs(texts):
    """What is left of each text: all runs of whole lines with two or more non-empty ones are looked up, longest and shortest, and go but for the first place."""
    first, gone = {}, collections.defaultdict(set)
    for i in sorted(texts):
        rows = (texts[i] or "").split("\n")
        for a in range(len(rows)):
            for b in range(a + 2, len(rows) + 1):
                run = tuple(rows[a:b])
                if run[0] and run[-1]:
                    j, c = first.setdefault(run, (i, a))
                    gone[i] |= set(range(a, b)) - (set(range(c, c + b - a)) if j == i else set())
    left = {}
    for i, text in texts.items():
        rows = (text or "").split("\n")
        left[i] = "".join(r + "\n" * (n < len(rows) - 1) for n, r in enumerate(rows) if n not in gone[i])
    return left, {i: len(gone[i]) for i in texts}


def line_texts():
    """Passages of 2 to 12 lines between different lines, runs of equal lines, periods, empty lines."""
    rnd = random.Random(11)
    texts, passages = {}, [[f"passage {n} line {k}" for k in range(n)] for n in range(2, 13)]
    for i in range(40):
        rows = [f"own {i} a"]
        for k in range(rnd.randint(0, 3)):
            rows += [*rnd.choice(passages), f"own {i} {k}"]
        texts[i] = "\n".join(rows) + "\n" * rnd.randint(0, 2)
    for i in range(40, 70):
        texts[i] = "\n".join(rnd.choice(["", "a", "b", "ä", f"own {i}"]) for _ in range(rnd.randint(0, 14)))
    return texts | {70: "\n".join(["same"] * 9), 71: "x\n" + "same\n" * 3 + "y", 72: "r\ns\nt\n" * 7, 73: "q\nq\nq", 74: None, 75: "last\n\nend", 76: "z\nlast\n\nend\n"}


def left_of(texts, gone):
    rows = {i: (t or "").split("\n") for i, t in texts.items()}
    return {i: "".join(r + "\n" * (n < len(rows[i]) - 1) for n, r in enumerate(rows[i]) if n not in gone[i]) for i in texts}


@pytest.mark.parametrize("options", [{}, {"hash_bits": 3}])
def test_repeated_lines_against_a_plain_version(spark, options):
    """With three bits of hash all bytes must be compared."""
    texts = line_texts()
    got = lines.without_repeated_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3), **options).collect()
    gone = plain_chunk_dedup(texts)
    assert {r.doc_id: r.kept_text for r in got} == left_of(texts, gone)
    assert {r.doc_id: r.n_removed_lines for r in got} == {i: len(gone[i]) for i in texts}


def test_repeated_lines_of_awkward_texts(docs, texts):
    got = {r.doc_id: r.kept_text for r in lines.without_repeated_lines(docs).collect()}
    assert got == left_of(texts, plain_chunk_dedup(texts))


def test_recall_of_chunks(spark):
    """Nothing but repeated runs goes, and most of them do; without chunks in the texts, that is with one chunk for each, hardly any."""
    texts = line_texts()
    _, every = repeated_runs(texts)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: r.n_removed_lines for r in lines.without_repeated_lines(df).collect()}
    whole = {r.doc_id: r.n_removed_lines for r in lines.without_repeated_lines(df, lines=1 << 40).collect()}
    assert all(found[i] <= every[i] for i in texts)
    assert sum(found.values()) >= 0.7 * sum(every.values()) and sum(whole.values()) < 0.5 * sum(found.values())


def test_chunks_of_lines_have_two_filled_lines():
    raw = "\n".join(["one", "", "two", *["same"] * 8, *["p", "q", "r"] * 5, "", "end"]).encode()
    found = textops_chunks(raw)
    assert min(f for *_, f in found) > 1 and sum(c for _, _, c, _ in found) == raw.count(b"\n") + 1
    assert [raw[b:e] for b, e, _, _ in found].count(b"p\nq\nr") >= 4


def textops_chunks(raw):
    found = lines.line_chunks(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), lines.WINDOW, lines.LINES_A_CHUNK)
    return list(zip(*(found[c].tolist() for c in (2, 3, 4, 5)), strict=True))


# Quality


@pytest.fixture(scope="module")
def judged(spark, given):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    return quality.quality(given, labels).join(labels, "doc_id", "left").collect()


def test_quality_keeps_trusted_documents(judged, given):
    assert len(judged) == given.count()
    good = [r.kept for r in judged if r.quality == 1 and r.toxic == 0]
    assert sum(good) >= 0.9 * len(good)
    bad = [r.perplexity / r.threshold for r in judged if r.quality == 0 and r.threshold]
    assert np.median(bad) > np.median([r.perplexity / r.threshold for r in judged if r.quality == 1 and r.threshold])


@pytest.mark.parametrize("head", [0, 500, quality.HEAD])
def test_perplexity_is_that_of_a_plain_model(spark, given, head):
    """Whatever number of n-grams the tasks hold; repeated rows are scored alike."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    some = given.filter("doc_id % 7 = 0")
    got = collections.defaultdict(set)
    for r in quality.quality(some.unionByName(some.limit(3)), labels, order=3, head=head).collect():
        got[r.doc_id].add(None if r.perplexity is None else round(r.perplexity, 9))
    prepared = quality.prepared(some, "doc_id", "text", "lang").select("doc_id", "text", "lang", "fold").collect()
    good = {r.doc_id for r in labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).filter("q = 1 and coalesce(t, 0) = 0").collect()}
    repeated = {r.doc_id for r in some.limit(3).collect()}
    models = {}
    for r in prepared:
        if r.doc_id in good:
            models.setdefault((r.fold, r.lang), []).extend([r.text] * (1 + (r.doc_id in repeated)))
    models = {k: brute.KneserNey(v, 3) for k, v in models.items()}
    for r in prepared:
        model = models.get((1 - r.fold, r.lang))
        want = model.perplexity(r.text) if model and r.text else None
        (have,) = got[r.doc_id]
        assert (have is None) == (want is None) and (want is None or have == pytest.approx(want, rel=1e-6))


def test_kneser_ney_sums_to_one(spark):
    text = spark.createDataFrame([("m", "abracadabra alakazam abra cadabra")], "model string, text string")
    model = quality.probabilities(quality.counts(text, 3), 3)
    asked = [("m", (context[0] << 16) | (context[1] << 8) | c, 1) for context in (b"ab", b"zz", b"a ") for c in range(256)]
    got = quality.looked_up(spark.createDataFrame(asked, "model string, gram long, c long"), model, 3).groupBy((F.col("gram") / 256).cast("long")).agg(F.sum(F.exp("log_p")).alias("p")).collect()
    assert len(got) == 3 and all(r.p == pytest.approx(1, abs=1e-6) for r in got)


def test_grams_of_a_long_text(monkeypatch):
    monkeypatch.setattr(quality, "GRAM_PART", 10)
    text = pa.array(["a long text, cut into small parts; ä, ß and more"])
    gram, _ = quality.grams_of(*textops.buffer_of(text), 5)
    parts = list(quality.gram_parts(text, 5))
    assert len(parts) > 3 and np.concatenate([g for g, _ in parts]).tolist() == gram.tolist()


def test_quality_of_awkward_rows(spark, docs):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(9, 40)] + [(9, 0, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.drop_low_quality(docs, labels)
    assert got.columns == docs.columns and {0, 1, 2} <= {r.doc_id for r in got.collect()}


# Vectors


def test_neighbours(spark):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    want = brute.neighbours(rows)
    got = collections.defaultdict(list)
    for r in sorted(ann.nearest_neighbours(spark.read.parquet(f"{SF}/embeddings.parquet")).collect(), key=lambda r: r["rank"]):
        got[r.query_id].append((r.vec_id, r.score))
    assert got.keys() == want.keys() and all(len(g) == 10 and g == sorted(g, key=lambda x: (x[1], x[0])) for g in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in w}) for q, w in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_neighbours_of_awkward_vectors(spark):
    v = {0: [1.0, 0.0], 1: [1.0, 0.0], 2: [1.0, 0.0], 3: None, 4: [0.0, 0.0], 5: [float("nan"), 1.0], 6: [None, 1.0], 7: [0.0, 2.0], 8: [1.0], 100: [float("inf"), 0.0], 200: [0.5, 0.5]}
    df = spark.createDataFrame([(i, x, 1) for i, x in v.items()] + [(None, [1.0, 1.0], 1)], "vec_id long, embedding array<float>, list int")
    got = collections.defaultdict(list)
    for r in sorted(ann.nearest_neighbours(df).collect(), key=lambda r: r["rank"]):
        got[r.query_id].append(r.vec_id)
    assert got == {0: [1, 2, 200, 7], 200: [0, 1, 2, 7]}


def test_neighbours_of_other_rows_are_all_found(spark):
    """Without clusters, in tight clusters far from zero, with one long component, and many copies: every neighbour is found."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 24)) * 5
    for x in (
        rng.normal(size=(1200, 24)), 1000 + centres[rng.integers(0, 12, 1200)] + rng.normal(size=(1200, 24)) * 0.01,
        rng.normal(size=(1200, 24)) * np.r_[1e4, np.ones(23)], np.repeat(rng.normal(size=(6, 24)), 200, 0) + np.r_[np.zeros(900), np.ones(300)][:, None] * rng.normal(size=(1200, 24)) * 1e-6,
    ):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        got = collections.defaultdict(list)
        for r in sorted(ann.nearest_neighbours(df).collect(), key=lambda r: r["rank"]):
            got[r.query_id].append((r.vec_id, r.score))
        for q in range(0, 1200, 100):
            far = np.sqrt(((x - x[q]) ** 2).sum(1))
            order = [i for i in np.lexsort((np.arange(1200), far)).tolist() if i != q][:10]
            assert got[q] == [(i, far[i]) for i in order]
        assert len(got) == 12


# Empty tables and shared helpers


def test_empty_tables(spark, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    results = [
        exact.exact_duplicates(nothing), exact.drop_exact_duplicates(nothing), binary.token_file_digests(nothing, JSON, 2, 50257), packing.pack_documents(nothing, JSON, 2), bpe.bpe_round_trip(nothing, RANKS, P.PATTERN),
        unigram.token_counts(nothing, PIECES), neardup.near_duplicates(nothing), suffixes.without_repeats(nothing), lines.without_repeated_lines(nothing), quality.quality(nothing, labels), ann.nearest_neighbours(nothing),
    ]
    assert [df.count() for df in results] == [0] * len(results)


def test_memory_of_comparing_samples():
    import tracemalloc

    rnd, n = np.random.default_rng(1), 4_000
    around = [bytes(rnd.integers(0, 2, 400, dtype=np.uint8)) for _ in range(n)]
    left = np.full(n, 150)
    tracemalloc.start()
    row, _ = suffixes.equal_strings(np.zeros(n, int), left, np.ones(n, int), [*around[:-1], around[0]], 400)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(row.tolist()) == [0, n - 1] and most < 4_000 * n


def test_pieces_are_whole_texts(texts):
    raw, off = textops.buffer_of(pa.array(list(texts.values())))
    which, distinct, first = textops.pieces(raw, off)
    got = ["".join(distinct[w] for w in which[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    assert got == [t or "" for t in texts.values()]


def test_shingle_sets(texts):
    val, at = textops.shingles(*textops.buffer_of(pa.array(list(texts.values()))))
    assert np.diff(at).tolist() == [len(brute.shingle_set(t)) for t in texts.values()]


# The pipeline


def test_pipeline_stages_with_awkward_columns(spark, odd_ids, nothing):
    import corpus_pipeline

    names = ["my col", "a.b", "_", "row", "x`y", "kept_text"]
    for rows in (odd_ids, nothing.select("doc_id", "text")):
        docs = rows.selectExpr("*", "'en' lang", "'s' source", "cast(length(text) as long) n_chars", *[f"{i} `{n.replace('`', '``')}`" for i, n in enumerate(names)])
        for name, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            assert all(tuple(r)[-len(names) :] == tuple(range(len(names))) for r in out.collect())
        assert corpus_pipeline.STAGES[4][1](spark, docs, SF).count() == docs.count()


def test_pipeline_stages(spark, given, tmp_path):
    import corpus_pipeline

    docs = given
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, SF)
        docs.write.parquet(f"file://{tmp_path}/{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == given.columns
            after = {r.doc_id: r.text for r in docs.collect()}
        if name == "exact dedup":
            last = {t: i for i, t in sorted(before.items())}
            assert after == {i: t for t, i in last.items()}
        if name == "near dedup":
            assert after == {i: before[i] for i, (_, c) in brute.near(before).items() if i == c}
        if name == "suffix-array dedup":
            want = brute.repeats(before, 400)
            assert after.keys() == before.keys() and all(after[i] == before[i] for i in before if not want[i][1])
            assert all(len(after[i].encode()) <= len(before[i].encode()) - w[1] for i, w in want.items())
    assert {r.doc_id for r in docs.collect()} == set(after)
