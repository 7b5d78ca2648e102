"""Small tables for the training-data operators."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def dictionaries():
    from komagrid.llm import lang

    return lang.dictionaries([])
