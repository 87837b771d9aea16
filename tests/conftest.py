import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def tables(spark):
    class Tables:
        def __getattr__(self, name):
            return spark.read.parquet(f"{DATA}/{name}.parquet")

    return Tables()


@pytest.fixture
def tiny_groups(spark):
    """Every group above 40 rows counts as too large for one task."""
    from tablewright.plans.layout import HOT_ROWS_CONF

    spark.conf.set(HOT_ROWS_CONF, "40")
    yield
    spark.conf.unset(HOT_ROWS_CONF)
