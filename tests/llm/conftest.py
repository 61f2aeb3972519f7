import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_id long, id long, size long, block long, key string, label string"


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    """A function from (doc_id, text, source) rows to a table on disk, with columns whose names the operators use inside."""

    def make(rows, parts=3):
        full = [(i, t, "en", s, None if t is None else len(t), 7, 7, 7, 7, "x", "y") for i, t, s in rows]
        path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
        spark.createDataFrame(full, SCHEMA).repartition(parts).write.parquet(path)
        return spark.read.parquet(path)

    return make


@pytest.fixture(scope="session")
def ugly(docs):
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 977} x{i % 13}" for i in range(60_000))
    rows = [(1, "a b c d e f g", "s1"), (1, "a b c d e f g", "s1"), (2, None, None), (3, "", "s2"), (None, "a b  c d e\tf g", "s1"), (None, None, None), (4, long, "s2"), (5, "é ü " * 9, ""), (6, " \n\t ", "s3"), (7, "idiot " * 3, "s3")]
    return docs(rows)


@pytest.fixture(scope="session")
def empty(docs):
    return docs([])
