import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))


def pytest_configure(config):
    """Column objects need a running session, also at import time of the test modules."""
    from evisift.session import local_session

    local_session(4, 4)


@pytest.fixture(scope="session")
def spark():
    from evisift.session import local_session

    s = local_session(4, 4)
    yield s
    s.stop()


@pytest.fixture
def one(spark):
    """Value of a Column over a one-row frame: ``one(expr, c="text", ...)``."""

    def run(expr, **cols):
        names = list(cols) or ["_"]
        df = spark.createDataFrame([tuple(cols.values()) or (1,)], ", ".join(f"{n} string" for n in names))
        return df.select(expr.alias("v")).first()["v"]

    return run
