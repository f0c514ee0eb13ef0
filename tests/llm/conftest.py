import pytest

SF = "/root/testdata/sf0.001"

#: Texts that every operator must take: null, empty, blank, one word, marks only, non-ASCII, repeats, a very long one.
ODD = [None, "", "   \t\n", "a", "...", "Größe café 日本 😀", "same text here again", "same  text\nhere again",
       "same text here again", "x" * 3000, "word " * 4000, "CC-BY general public license, all rights reserved"]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts with a null key, a repeated row and extra columns whose names the operators use themselves."""
    rows = [(i if i != 5 else None, t, "en" if i % 2 else None, "s", len(t or ""), i, f"r{i}") for i, t in enumerate(ODD)]
    rows.append(rows[6])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row long, label string")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(small):
    return {r["doc_id"]: r["text"] or "" for r in small.select("doc_id", "text").collect()}
