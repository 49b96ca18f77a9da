import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empties, ties, repeated rows, a text of 2.3 MB, longer than what is hashed at once, and columns that operators use inside."""
    text = " ".join(f"word{k}" for k in range(60))
    rows = [
        (1, text, "en", "a"), (2, text, "en", "a"), (2, text, "en", "a"), (3, text + " more", "en", "b"), (4, None, None, None), (5, "", "en", "a"), (None, text, "en", "b"),
        (6, " \n\t ", "fr", "b"), (7, "short text", None, "b"), (8, " ".join(f"x{k % 9000}" for k in range(400_000)), "en", "a"), (9, "WORD0 " + text[6:], "en", None),
    ]
    return spark.createDataFrame([(*r, 1, "k", 2) for r in rows], "doc_id long, text string, lang string, source string, n long, key string, block long")


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")
