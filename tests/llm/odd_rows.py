import pytest


@pytest.fixture(scope="session")
def texts():
    """Awkward texts: NULL, empty, white space of many kinds, other scripts, long."""
    return [None, "", " ", "\n\n", "a", "The  cat\t sat.\r\n on \n\n the mat ", "It's 12 o'clock, we'll go\x0b\x0c\x1c!",
            "naïve café ÉTÉ ñandú ß", "漢字かな交じり文 🙂🙂 ok", "é vs é   nbsp em",
            "<|endoftext|> and <|startoftext|>", "x" * 5000 + "abcabd" * 3000, "word " * 3000,
            "The  cat\t sat.\r\n on \n\n the mat "]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """doc_id, text and extra columns whose names clash with outputs."""
    rows = [(i if i != 4 else None, t, "x", 7, [1]) for i, t in enumerate(texts)] + [(3, "\n\n", "y", 8, None)] * 2
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string, n_tokens long, ids array<int>")
