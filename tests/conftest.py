"""One small session for all tests; its checkpoint folder is a temporary one, as no cluster names another."""

import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
DATA = os.environ.get("TESTDATA_DIR", "/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    place = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[8]").appName("turnmill-tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{place}/shared")
        .config("spark.sql.warehouse.dir", f"{place}/warehouse").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from turnmill.ship import ship

    ship(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf(spark):
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def sf01(spark):
    return f"{DATA}/sf0.01"
