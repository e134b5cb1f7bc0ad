import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from skein.session import build_session

    session = build_session(
        "local[8]", "tests", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="6g"
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return str(DATA / "sf0.001")


@pytest.fixture(scope="session")
def oracle():
    """DuckDB with the small tables as views."""
    import duckdb

    con = duckdb.connect()
    for p in sorted((DATA / "sf0.001").glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con
