import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents table of (doc_id, text) rows, with columns whose names operators use themselves."""

    def make(rows, **more):
        schema = ("doc_id long, text string, lang string, source string, n_chars long, size long, node string, root string, words string, "
                  "label string, _id string, _w string, _row string, kept boolean, n_words string, quality string, bucket string, _copies int")
        full = [(i, t, more.get("lang", "en"), more.get("source", "s"), len(t or ""), 7, "n", "r", "w", "l", "i", "w", "b", None, "x", "q", "b", 9)
                for i, t in rows]
        return spark.createDataFrame(full, schema)

    return make
