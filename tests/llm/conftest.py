import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, words string"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every awkward case, and extra columns whose names the operators use inside."""
    base = "the quick brown fox jumps over the lazy dog and runs to the hills with all of its friends in the morning "
    texts = [None, "", "   \n\t ", "one", "two words", base, base, base + "x", base * 400, "Ünïcödé ÀÉ 日本語 👩‍🚀 " * 3, "a@b.c " * 5, "\x00\x0b\x0c", "A B C D E", "a b c d e", "No spaces" + "x" * 9000]
    rows = [(i, t, "en" if i % 3 else None, None if i % 2 else "s", None, 7, "w") for i, t in enumerate(texts)]
    rows += [rows[5], (None, base + " null id", None, None, None, 7, "w")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
