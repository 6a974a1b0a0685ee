import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # extra columns under names that operators use inside or return
    T.StructField("kept", T.StringType()), T.StructField("_row", T.StringType()), T.StructField("bucket", T.LongType()),
    T.StructField("size", T.StringType()), T.StructField("_id", T.LongType()), T.StructField("shard", T.StringType()),
    T.StructField("tokens", T.StringType()), T.StructField("_copies", T.LongType()), T.StructField("_bytes", T.StringType()),
])


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from sluice.session import ship_package

    ship_package(spark)


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        """rows: (doc_id, text) or (doc_id, text, lang, source)."""
        full = []
        for r in rows:
            doc_id, text, lang, source = (*r, None, None)[:4]
            full.append((doc_id, text, lang, source, len(text) if text is not None else None, "x", "y", 1, "z", 2, "s", "t", 3, "b"))
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, blank, one-word, symbol-only and very long texts, ties and repeated rows."""
    draw = random.Random(1)
    words = ["".join(draw.choice("abcdeéßñ") for _ in range(draw.randint(1, 7))) for _ in range(300)]
    base = [draw.choice(words) for _ in range(120)]
    long = [draw.choice(words) for _ in range(60_000)]
    rows = [
        (0, None, "en", "s0"), (1, "", "en", None), (2, " \t\n\x0b ", None, "s1"), (3, "word", "de", "s1"), (4, "*** 12 %%% 3", "de", "s1"),
        (5, " ".join(base), "en", "s0"), (6, " ".join(base), "en", "s0"), (7, " ".join(base[:119] + ["other"]), "en", "s2"),
        (8, "\n".join(base[40:80]), "fr", "s2"), (9, " ".join(long), "fr", "s2"), (10, "the the the " * 30, None, None),
        (11, " ".join(w.upper() for w in base), "en", "s0"), (None, " ".join(base[:60]), "en", "s1"), (12, "a b c", "en", "s0"), (13, "A  b\nc", "en", "s0"),
        (14, " ".join(base), "en", "s0"), (14, " ".join(base), "en", "s0"),
    ]
    for i in range(20, 60):
        t = [draw.choice(words) for _ in range(draw.randint(1, 150))]
        rows.append((i, " ".join(t), draw.choice(["en", "de", None]), draw.choice(["s0", "s1", "s2", None])))
        if draw.random() < 0.4:
            t[draw.randrange(len(t))] = "changed"
            rows.append((i + 100, " ".join(t), "en", "s0"))
    return rows
