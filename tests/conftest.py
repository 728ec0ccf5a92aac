import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).parent.parent))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("corpus-guard-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="checkpoints-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


UNIT = "unit_id string, path string, language string, text string"


@pytest.fixture(scope="session")
def unit(spark):
    def make(*texts, path="app.py", language="python"):
        rows = [(str(i), path, language, text) for i, text in enumerate(texts)]
        return spark.createDataFrame(rows, UNIT)

    return make
