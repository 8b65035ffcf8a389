import random

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def edge(spark):
    """Null, empty and very long texts, ties, repeated rows, null ids, clashing and odd column names."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    prose = [" ".join(["the", "of", *(word() for _ in range(60))]) for _ in range(8)]
    long = " ".join(word() for _ in range(60_000))
    rows = [
        (1, prose[0], "en", "a"), (2, prose[0], "en", "a"), (2, prose[0], "en", "a"), (3, prose[1], "en", None),
        (None, prose[2], "en", "b"), (None, prose[2], "en", "b"), (4, None, "en", "b"), (4, None, None, "b"),
        (5, "", "en", "a"), (6, "", "en", "c"), (7, "   \n ", "en", "a"), (8, long, "en", "c"), (9, "!?! ...", "en", "a"),
        (10, prose[3], "en", "a"), (11, prose[3] + " end", "en", "b"), (12, prose[4], "de", "b"), (12, prose[5], "de", "b"), (13, "word", "en", "c"), (14, "Ünïcode 漢字 text", "fr", "c"),
    ]
    extra = "_hash string, k int, h int, t int, n_words int, fp int, `a.b` int"
    full = [(*r, len(r[1]) if r[1] is not None else None, "x", 1, 2, 3, 4, 5, 6) for r in rows]
    return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {extra}").repartition(3)


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
