import pytest

from tallyreel.llm import storage


@pytest.fixture(autouse=True)
def package_on_workers(spark):
    """Workers import the package from where the tests found it."""
    storage.with_package(lambda s: None)(spark)


@pytest.fixture
def table(spark):
    """A table of documents from (doc_id, text) rows, with columns whose names operators use too."""

    def make(rows, columns="doc_id long, text string"):
        return spark.createDataFrame(rows, columns).coalesce(2)

    return make
