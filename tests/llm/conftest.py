import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def sf(tmp_path_factory):
    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("benchmark tables not present")
    return path
