import pytest

from cratewise.session import working_folder


@pytest.fixture(scope="session")
def shared(spark):
    """The folder for cut lineage."""
    return working_folder(spark)


@pytest.fixture()
def documents(spark, shared):
    """A documents table of (doc_id, text) rows, with columns that clash with the operators' own names."""

    def make(rows, **columns):
        extra = {"n": 1, "key": "k", "cls": "c", "rid": 0, **columns}
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, n int, key string, cls string, rid int"
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or ""), extra["n"], extra["key"], extra["cls"], extra["rid"]) for r in rows]
        return spark.createDataFrame(full, schema)

    return make
