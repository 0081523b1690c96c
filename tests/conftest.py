import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

from pyspark.sql import SparkSession  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def documents(spark):
    """documents rows from (doc_id, text) pairs, with another column whose name clashes with the operators' own."""
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    kind = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("source", StringType()), StructField("key", StringType()), StructField("n", StringType()), StructField("score", StringType())])

    def make(pairs, source="s"):
        return spark.createDataFrame([(i, t, source, "k", "n", "x") for i, t in pairs], kind)

    return make
