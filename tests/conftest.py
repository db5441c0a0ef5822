import duckdb
import pytest

from tests.check import duck
from tests.session import local_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("shared")
    session = local_session(
        **{
            "spark.sql.shuffle.partitions": "2",
            "spark.checkpoint.dir": f"file://{folder}/checkpoints",
            "spark.sql.warehouse.dir": f"{folder}/warehouse",
        }
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return SMALL


@pytest.fixture(scope="session")
def con(sf_dir) -> duckdb.DuckDBPyConnection:
    return duck(sf_dir)
