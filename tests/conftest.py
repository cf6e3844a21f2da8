import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


FRAME = [
    (0, "West", "A", 100.0, 60.0, "1"),
    (1, "West", "A", 100.0, 60.0, "1"),
    (2, "East", "B", 180.0, 90.0, "2"),
    (3, "North", "B", 240.0, 130.0, "3"),
    (4, "East", "A", None, 80.0, "4"),
    (5, None, "B", 160.0, 70.0, "5"),
]


@pytest.fixture
def frame(spark):
    columns = "_row_id long, region string, group string, revenue double, cost double, code string"
    return spark.createDataFrame(FRAME, columns)


@pytest.fixture
def plain(frame):
    return frame.drop("_row_id")
