import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpusloom.session import local_session  # noqa: E402

DATA = os.environ.get("CORPUSLOOM_DATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    return local_session(8)


@pytest.fixture(scope="session")
def small():
    return f"{DATA}/sf0.001"
