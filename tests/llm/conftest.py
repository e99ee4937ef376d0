import pytest

from matchlog.llm.queries import share_code


@pytest.fixture(scope="session", autouse=True)
def code(spark):
    share_code(spark)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (id, text) pairs, with columns whose names the operators use inside."""

    def make(rows):
        return spark.createDataFrame(
            [(i, t, "x", 1, 2, "y", None) for i, t in rows],
            "doc_id long, text string, class string, row int, key int, score string, text_key binary",
        )

    return make
