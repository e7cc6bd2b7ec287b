import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[4]")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", "8g")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    if not s.conf.get("spark.checkpoint.dir", None):
        s.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="stratarisk-test-ckpt-"))
    yield s


@pytest.fixture(scope="session")
def micro(spark):
    """y 0,0,1,1; p .1,.4,.35,.8 (FIXTURES section 4)."""
    rows = [("c", 0, 100000), ("c", 0, 400000), ("c", 1, 350000), ("c", 1, 800000)]
    return spark.createDataFrame(rows, "cell string, y int, p6 int")
