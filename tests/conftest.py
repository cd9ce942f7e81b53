import tempfile

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def edges(spark):
    """A maker of edges(src, dst, w)."""
    return lambda rows: spark.createDataFrame([(a, b, float(w)) for a, b, w in rows], "src long, dst long, w double")


@pytest.fixture
def asked(spark):
    """A maker of queries(query_id, u)."""
    return lambda *us: spark.createDataFrame(list(enumerate(us)), "query_id long, u long")
