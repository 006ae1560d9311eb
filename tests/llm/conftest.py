import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from odd_documents import odd_rows  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    return odd_rows(spark)


@pytest.fixture(scope="session")
def nothing(spark):
    return odd_rows(spark, [])
