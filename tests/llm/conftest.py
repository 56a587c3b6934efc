import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """A small table of documents with nulls, empty and long texts, repeats, and columns that clash."""

    def make(rows, schema=DOC_SCHEMA):
        return spark.createDataFrame([(*r, *[None] * (5 - len(r))) if schema == DOC_SCHEMA else r for r in rows], schema)

    return make
