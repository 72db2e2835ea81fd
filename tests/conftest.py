import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from hydroflow.session import get_spark
    return get_spark(cores=4, shuffle_partitions=4, app="hydroflow-tests")
