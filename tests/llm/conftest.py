import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

#: Names that the operators use inside, to clash with.
CLASH = ("key", "row", "n", "part", "id", "size", "bucket", "spans", "v", "rep", "model", "sha")


def awkward_rows():
    import random

    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzäé") for _ in range(rnd.randint(2, 9)))
    passage = " ".join(word() for _ in range(90))
    base = " ".join(word() for _ in range(200))
    near = base.split()
    near[100] = "changed"
    texts = [None, "", "", " \t\n ", "one", "one two three four", "a" * 900, " " * 700, "\n".join(["same line", "other line", "third", "fourth line"] * 60), base, base, " ".join(near), base.upper()]
    texts += [f"{word()} {word()} {passage} {word()}" for _ in range(4)] + [" ".join(word() for _ in range(20_000))]
    texts += ["日本語のテキスト。" * 60, "x y z\r\n\v\f", "<|endoftext|> it's we'll 123,456.78!!", "🙂" * 150, base + "\n" + passage]
    texts += [" ".join(word() for _ in range(rnd.randint(1, 300))) + "\n" * rnd.randint(0, 3) for _ in range(25)]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark):
    """Awkward texts, with extra columns of clashing names."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(awkward_rows(), "doc_id long, text string").withColumns({"lang": F.when(F.col("doc_id") % 3 > 0, "en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    return df.select("*", *[F.lit(7).alias(c) for c in CLASH]).repartition(3)


@pytest.fixture(scope="session")
def texts():
    return dict(awkward_rows())


@pytest.fixture(scope="session")
def odd_ids(spark):
    """Null and repeated ids, repeated rows, null texts."""
    return spark.createDataFrame([(None, "a b c d e f g"), (None, None), (1, "a b c d e f g"), (1, "a b c d e f g"), (1, "other"), (2, None), (3, "a b c d e f g")], "doc_id long, text string")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, n_chars long, embedding array<float>, vec_id long")
