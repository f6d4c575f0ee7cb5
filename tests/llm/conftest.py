import pytest

SF = "/root/testdata/sf0.001"

#: Nulls in every column, empty and odd texts, a long text, ties and repeated rows, and columns with clashing names.
EDGE = [
    (1, "The quick brown fox jumps over the lazy dog by the river", "en", "a", 55, "x", 9),
    (2, "the QUICK brown fox jumps over the lazy dog by the river", "en", "a", 55, "x", 9),
    (2, "the QUICK brown fox jumps over the lazy dog by the river", "en", "a", 55, "x", 9),
    (3, None, None, None, None, None, None),
    (4, "", "en", "b", 0, "", 0),
    (5, "   \n\t ", "en", "b", 6, "", 0),
    (6, "one", "en", "b", 3, "", 0),
    (7, "Zwei W\u00f6rter \u00dcber \u00c4pfel \u2003 und 12 34", "de", "b", 20, "", 0),
    (8, "long " * 30_000 + "tail", "en", "c", 150_004, "", 0),
    (9, "!!! ### $$$ 123", None, "c", 15, "", 0),
    (None, "no id at all here", "en", None, 17, "", 0),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, fp string, fingerprint int"


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(EDGE, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture()
def scratch(spark):
    from leadloom.scratch import Scratch

    return Scratch(spark, "test")
