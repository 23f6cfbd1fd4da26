from __future__ import annotations

import os

import pytest


@pytest.fixture(scope="session")
def sf():
    path = os.environ.get("LACUNA_TEST_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(path):
        pytest.skip("no test tables")
    return path
