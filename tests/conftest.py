import pytest

from pageloom.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[4]", 2)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def one(spark):
    """Evaluate column expressions over literals."""

    def run(*columns):
        row = spark.range(1).select(*columns).first()
        return row[0] if len(columns) == 1 else tuple(row)

    return run
