"""One local session for all tests."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from lontarix.session import build  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    s = build("local[8]", "tests", spark__sql__shuffle__partitions="4", spark__driver__memory="6g", spark__ui__enabled="false", spark__checkpoint__dir=f"file://{shared}")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
