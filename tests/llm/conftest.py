import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that the operators use inside, as columns of the input.
CLASHING = ("size", "hash", "id", "n", "p", "token", "below", "times", "score", "part", "rank", "component", "words", "h", "u", "v")

BASE = "the quick brown fox jumps over the lazy dog and runs into a dark green wood where nobody ever goes at night because of wolves".split()


def awkward_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows and ids."""
    text = " ".join(BASE)
    return [
        (1, text, "en", "a", len(text)),
        (2, text, "en", "a", len(text)),  # an exact copy
        (3, text.upper() + " ", "en", "a", len(text)),  # a copy after folding
        (4, " ".join([*BASE, "indeed"]), "en", "b", 1),
        (5, " ".join(BASE[5:]), "en", "b", 1),
        (6, "", "en", "a", 0),
        (7, None, "en", "a", None),
        (8, " \t\n\x0b\x0c\r", None, None, 6),
        (9, "word", "de", "c", 4),
        (10, "word", "de", "c", 4),
        (10, "word", "de", "c", 4),  # a repeated row
        (None, text, "en", "a", 1),
        (None, None, None, None, None),
        (11, " ".join(f"w{i % 3000} x{i * i % 977}" for i in range(30_000)), "en", "b", 1),
        (12, "ä" * 50_000, "en", "b", 1),
        (13, "tel +1 (555) 010-2345, a.b@c.example.com and 10.0.0.1; 4111 1111 1111 1111.", "en", "d", 1),
        (14, "same line\nsame line\n\nsame line\nother | # * 𝒳   x", "fr", "d", 1),
        (15, "a b c a b c d", None, "d", 1),
    ]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), DOCS).repartition(3)


@pytest.fixture(scope="session")
def clashing(spark, awkward):
    """The awkward documents with extra columns whose names the operators use."""
    from pyspark.sql import functions as F

    return awkward.withColumns({c: F.lit("x") for c in CLASHING})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=lambda r: tuple((x is not None, str(x)) for x in r))
