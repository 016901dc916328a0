import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def words():
    """A thousand invented words."""
    return [a + b + c for a in ("ka", "lo", "mi", "ne", "ru", "sta", "to", "vi", "we", "zo") for b in ("", "ba", "di", "fu", "go", "he", "ji", "ly", "mo", "po")
            for c in ("", "n", "r", "s", "t", "l", "m", "k", "d", "x")]
