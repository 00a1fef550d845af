import os

import pytest

from annoframe.session import local_session

TABLES = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folders = {
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
    }
    session = local_session(8, "tests", **folders)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables():
    return TABLES
