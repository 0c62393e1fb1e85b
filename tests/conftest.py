import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from panelyard.plans.stage import release  # noqa: E402
from panelyard.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    release(s)
    s.stop()


@pytest.fixture
def tiny_tasks(spark):
    """Force every hot-group path: any group above 150 rows is 'hot', nothing is broadcast as small."""
    spark.conf.set("spark.panelyard.rowsPerTask", "150")
    spark.conf.set("spark.panelyard.broadcastBytes", "1")
    yield spark
    spark.conf.unset("spark.panelyard.rowsPerTask")
    spark.conf.unset("spark.panelyard.broadcastBytes")


@pytest.fixture(params=["plain", "hot"])
def both_paths(request, spark):
    if request.param == "hot":
        spark.conf.set("spark.panelyard.rowsPerTask", "150")
        spark.conf.set("spark.panelyard.broadcastBytes", "1")
    yield spark
    if request.param == "hot":
        spark.conf.unset("spark.panelyard.rowsPerTask")
        spark.conf.unset("spark.panelyard.broadcastBytes")
