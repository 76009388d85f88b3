import os
import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    builder = (
        SparkSession.builder.master("local[8]")
        .appName("areastats-tests")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    if session.conf.get("spark.checkpoint.dir", None) is None:
        folder = tempfile.mkdtemp(prefix="areastats-tests-")
        session.conf.set("spark.checkpoint.dir", folder)
        session.sparkContext.setCheckpointDir(folder)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def small_data():
    return "/root/testdata/sf0.001"


def rows(df, *order):
    """Rows as tuples, sorted by the given columns or by their text."""
    out = [tuple(r) for r in df.collect()]
    if order:
        at = [df.columns.index(c) for c in order]
        return sorted(out, key=lambda r: [(r[i] is None, r[i] if r[i] is not None else 0) for i in at])
    return sorted(out, key=str)
