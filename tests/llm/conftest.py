import pytest


@pytest.fixture
def make_docs(spark):
    """Documents with an extra column whose name clashes with results."""
    def make(rows):
        return spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, lang string, source string, score int")
    return make
