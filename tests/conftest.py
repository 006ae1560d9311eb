import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark():
    from wiretally.session import build_session

    session = build_session(
        "wiretally-tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"},
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def value(spark):
    """Evaluate one Column over one row of named values."""

    def run(expr, **columns):
        from pyspark.sql import functions as F

        cols = [F.lit(v).alias(k) for k, v in columns.items()] or [F.lit(1).alias("one")]
        return spark.range(1).select(*cols).select(expr.alias("x")).first()["x"]

    return run
