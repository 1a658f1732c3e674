"""Shared session and DuckDB connection."""
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from check import TABLES  # noqa: E402
from subsetlab.session import checkpoint_dir, local_session  # noqa: E402

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    session = local_session(shuffle_partitions=4, app_name="tests")
    session.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(session)
    return session


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con
