import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sweepframe.session import BROADCAST_ROWS, GROUP_ROWS  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .appName("sweepframe-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def tight_limits(spark):
    """Pretend every group and table is too big for one task or a broadcast."""
    spark.conf.set(GROUP_ROWS[0], "5")
    spark.conf.set(BROADCAST_ROWS[0], "0")
    yield
    spark.conf.unset(GROUP_ROWS[0])
    spark.conf.unset(BROADCAST_ROWS[0])
