import pytest

from wardlake.llm.ship import ship_package


@pytest.fixture(autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture
def documents(spark):
    """A table of documents from (doc_id, text, ...) rows."""

    def make(rows, extra: str = ""):
        return spark.createDataFrame(rows, f"doc_id long, text string{extra}")

    return make
