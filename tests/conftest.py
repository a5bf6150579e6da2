import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tidewatch.session import get_spark

    return get_spark("tests", "4", spark__driver__memory="4g", spark__sql__shuffle__partitions="4")
