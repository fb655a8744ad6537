import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and blank and very long texts, ties, repeated rows, names that clash."""
    long_text = " ".join(f"word{i * 7919 % 5003}" for i in range(60_000))
    rows = [
        (1, "the cat sat on the mat and looked at the dog", "en", "a", 44),
        (1, "the cat sat on the mat and looked at the dog", "en", "a", 44),
        (2, "the cat sat on the mat and looked at the dog", "en", None, 44),
        (2, "another text under the same number", None, "b", None),
        (3, None, "en", "a", None),
        (4, "", "en", "b", 0),
        (5, " \t\n ", None, None, 4),
        (None, "text without a number", "en", "a", 21),
        (None, "text without a number", "en", "a", 21),
        (None, None, None, None, None),
        (6, long_text, "en", "a", len(long_text)),
        (7, "x" * 50_000, "xx", "b", 50_000),
        (8, "日本語 текст <|endoftext|> ὈΔΥΣΣΕΎΣ \x1c sep", "el", "é", 30),
        (9, "12345 !!! ###", "en", "a", 13),
        (10, "a b c", "de", "a", 5),
        (11, "A B C", "de", "a", 5),
    ]
    names = ["size", "score", "cls", "gram", "label", "row_key", "n", "block", "doc", "times", "place", "bucket", "copy"]
    base = spark.createDataFrame([(*r, *[f"{k}{i}" if i % 2 else None for k in names]) for i, r in enumerate(rows)],
                                 DOCS + "".join(f", {k} string" for k in names))
    return base.repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
