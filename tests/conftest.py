import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from areaflow.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", "areaflow-tests", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
        "spark.sql.adaptive.coalescePartitions.enabled": "true"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def rect(x0, y0, x1, y1):
    return ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))
