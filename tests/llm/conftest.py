import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component string, k1 long, n long"


def edge_rows():
    base = " ".join(f"word{i}" for i in range(80))
    near = base.replace("word7 ", "other ")
    long = " ".join(f"l{i % 977}" for i in range(60000))
    texts = [None, "", " \t\n", "one two", "one two", "One\tTwo ", base, base, near, base.upper(), long, "Σας ΣΑΣ İ <|endoftext|> it's é", None]
    rows = [(i, t, "en", None if i % 4 == 0 else f"s{i % 3}", None, "x", 1, 2) for i, t in enumerate(texts)]
    return rows + [rows[6], rows[3], (None, base, None, "s1", 1, "x", 1, 2)]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
