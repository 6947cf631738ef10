import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, prob double, n int, text_ string, group_id long, `__id` string"


@pytest.fixture(scope="session")
def table(spark):
    """Documents from (doc_id, text[, lang]), with columns whose names an operator might use itself."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1]) if r[1] is not None else None, 7, None, 3, "x", -1, "y") for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


WORDS = "the and of with river stone cloud paper green walk seven light door house music bread water north table glass".split()


@pytest.fixture(scope="session")
def prose():
    def make(seed, n=60):
        import random

        r = random.Random(seed)
        return " ".join(r.choice(WORDS) + r.choice(["", "", "s", "er", "ing"]) for _ in range(n))

    return make


#: (doc_id, text) that every operator has to take: nulls, empty and very long texts, repeated rows, odd characters.
EDGES = [(1, None), (2, ""), (3, "   \n\t "), (4, "a"), (5, "two words"), (6, "z " * 60_000), (7, "q" * 150_000), (8, "same text here now"), (8, "same text here now"), (None, "no id at all"), (9, "日本語 текст ελληνικά   😀"), (10, "\x00 zero \x01")]


@pytest.fixture(scope="session")
def edges():
    return EDGES
