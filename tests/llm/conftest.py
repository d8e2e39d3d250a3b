import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, rest string, row int, key string, starts string, spans string, label int, part int, length int"


@pytest.fixture
def docs(spark):
    """Documents with columns whose names the operators use inside."""

    def make(*rows, lang="en", source="s"):
        full = [(r[0], r[1], *(r[2:] or (lang, source)), len(r[1]) if r[1] else None, 0.5, "x", 7, "k", None, None, 1, 9, 3) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(40_000))

#: null, empty and blank texts, one very long, repeated rows, a missing doc_id, other scripts and control characters
ODD = [
    (1, None), (2, ""), (3, " \t\n "), (4, "One. Two! Three?\nFour"), (4, "One. Two! Three?\nFour"), (5, LONG), (6, "a b  c  d\n \n e"),
    (None, "One. Two! Three?\nFour"), (None, None), (7, "Ünïcödé 日本語 \x00\x01 <|endoftext|> it's"), (8, "x"), (9, LONG + " tail"),
]


@pytest.fixture
def odd(docs):
    return docs(*ODD, (10, "null columns", None, None))


@pytest.fixture
def empty(docs, spark):
    return spark.createDataFrame([], SCHEMA)
