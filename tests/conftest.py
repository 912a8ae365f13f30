import pytest

from kpivane.sources.tables import Tables
from tests.support import DATA, session


@pytest.fixture(scope="session")
def spark():
    spark = session(partitions=2)
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def tables(spark):
    return Tables(spark, f"{DATA}/sf0.001")
