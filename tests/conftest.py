from __future__ import annotations

import os

import pytest

from tidemark.session import build_session

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        app="tidemark-tests", master="local[8]", spark_sql_shuffle_partitions="8", spark_ui_enabled="false",
        spark_ui_showConsoleProgress="false", spark_driver_memory="6g",
        spark_checkpoint_dir=str(tmp_path_factory.mktemp("scratch")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return SF
