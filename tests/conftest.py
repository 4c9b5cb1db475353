import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerfold.operators.cells import CELL_ROWS_CONF  # noqa: E402
from ledgerfold.session import build_session, release  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", 4, **{"spark.driver.memory": "8g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    release(session)
    session.stop()


@pytest.fixture(params=["plain", "cut"])
def cell_mode(request, spark):
    """Run a test with the plain window and again with keys cut into tiny cells."""
    if request.param == "cut":
        spark.conf.set(CELL_ROWS_CONF, "5")
    yield request.param
    spark.conf.unset(CELL_ROWS_CONF)
