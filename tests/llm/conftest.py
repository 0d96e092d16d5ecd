import pytest


@pytest.fixture(scope="session", autouse=True)
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


@pytest.fixture(scope="session")
def odd_texts():
    """Texts that trip operators: null, empty, white space, marks, very long, no blanks, repeated."""
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "One short line."), (5, "word " * 30_000), (6, "x" * 20_000), (7, "a  b \n c\r\n\x1cd\x85e  "),
        (8, "<|endoftext|> in a text <s> </turn> ### User: \\ ▁ 漢字 é 😀"), (9, "The same text twice, with enough words to be a line of its own."),
        (9, "The same text twice, with enough words to be a line of its own."), (None, "A text without an id, with enough words to be a line of its own."),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """The texts with columns whose names operators use themselves."""
    rows = [(i, t, "en", None if i == 4 else "s", -1, "k", 0, 1.0, "r") for i, t in odd_texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, node int, _s double, _row string")
