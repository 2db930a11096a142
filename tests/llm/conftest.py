import pytest

#: Nulls, empty, ties, repeated rows, other scripts, odd white space, control strings.
ODD_TEXTS = [
    (1, "one two  three\tfour\nfive 't's 12 a@b.co"),
    (2, None),
    (3, ""),
    (3, ""),
    (4, "   \n\t "),
    (5, "½ ² x² été naïve 中国語 русский текст 👍🏽 \x1c\x1f end"),
    (None, "no id at all, but <|endoftext|> words and words"),
    (6, "word " * 3000),
    (7, "word " * 3000),
    (8, "x" * 20000),
    (8, "aaaaaaaaaaaaaaaaaaaa aaaa"),
    (9, "same line\nsame line\nother line\n\n"),
    (9, "same line\nsame line\nother line\n\n"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with clashing extra columns."""
    rows = [(i, t, "en", None, 0, "extra", 1.0) for i, t in ODD_TEXTS]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, score double"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def as_set(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)
