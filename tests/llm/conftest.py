import pytest

from .fixtures import edge_docs, empty_docs, null_rows


@pytest.fixture(scope="session")
def edge(spark):
    from lendgov.llm import common

    common.prepare(spark)
    return edge_docs(spark).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return empty_docs(spark)


@pytest.fixture(scope="session")
def nulls(spark):
    return null_rows(spark)
