import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from attestry import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session.build("local[4]", 4, "4g", "tests")
    yield s
    s.stop()
