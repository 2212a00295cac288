import pytest

from corpusloom.settings import release_scratch

from .oracle import session


@pytest.fixture(scope="session")
def spark():
    built = session()
    built.sparkContext.setLogLevel("ERROR")
    yield built
    release_scratch(built)


@pytest.fixture
def one(spark):
    """Value of a column expression over a single literal row."""

    def run(expression, **values):
        return spark.createDataFrame([tuple(values.values()) or (0,)], list(values) or ["x"]).select(expression).first()[0]

    return run
