import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{FOLDER}/labels.parquet")


@pytest.fixture(scope="session")
def rows(docs):
    return {r.doc_id: r.text for r in docs.collect()}


SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, key string, hash string, body string, size string, u string, row string, "
          "id string, word string, copies string, cut string, part string, bucket string, path string, r string, s string, label string")


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls everywhere, blank, short and very long texts, repeated rows, equal texts, clashing column names."""
    long_text = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, long_text), (5, long_text), (6, "a b c d e f g h i j k l"), (6, "a b c d e f g h i j k l"),
             (7, "a b c d e f g h i j k l"), (None, "a b c d e f g h i j k l"), (None, None), (8, "Ünïcode ▁ words 日本 password: hunter22 \n\n end")]
    return spark.createDataFrame([(d, t, None, None if (d or 0) % 3 == 0 else f"s{d % 2}", None, *["x"] * 16) for i, (d, t) in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
