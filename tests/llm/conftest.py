import pytest


@pytest.fixture(scope="session")
def texts(spark):
    """Documents with every awkward case; further columns have names that operators use inside."""
    passage = " ".join(f"p{i}" for i in range(40))
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog " * 12, "b"),
        (2, "The quick brown fox jumps over the lazy dog " * 12, "b"),  # a copy
        (3, None, "a"),
        (4, "", None),
        (5, " \t\n ", "a"),
        (6, long, "a"),
        (7, "one two", "c"),
        (8, "One TWO", "c"),
        (9, f"start a b c {passage} end of nine", "a"),
        (10, f"other words {passage} tail of ten\nélan vital", None),
        (11, " ".join(f"u{i}" for i in range(200)), "a"),
        (12, " ".join(f"u{i}" for i in range(200)) + " more", "c"),
        (13, "same same " * 60, "b"),
        (14, "x" * 5_000, "b"),
        (14, "x" * 5_000, "b"),  # a repeated row
        (None, "no id but some words here", "a"),
        (None, None, None),
    ]
    full = [(i, t, s, "clash", 5, 0, 1.5, "k") for i, t, s in rows]
    return spark.createDataFrame(
        full, "doc_id bigint, text string, source string, key string, n int, hash int, rank double, class string")


@pytest.fixture(scope="session")
def plain(texts):
    """The same rows on the driver: (doc_id, text, source)."""
    return [tuple(r) for r in texts.select("doc_id", "text", "source").collect()]
