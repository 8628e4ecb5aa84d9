import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    def make(texts, extra=()):
        rows = [(i, t, "en", f"src{i % 3}", len(t) if t is not None else None) for i, t in enumerate(texts)]
        return spark.createDataFrame([*rows, *extra], DOCS).repartition(3)

    return make


@pytest.fixture
def folder(spark):
    from occuflow.llm.common import shared_folder

    return shared_folder(spark)
