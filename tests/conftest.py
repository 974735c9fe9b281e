import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("PYTHONPATH", str(Path(__file__).resolve().parent.parent))
DATA = Path(os.environ.get("LAWLOOM_TESTDATA", "/root/testdata"))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    """The smallest test tables."""
    folder = DATA / "sf0.001"
    if not folder.exists():
        pytest.skip("no test tables here")
    return str(folder)


@pytest.fixture(scope="session")
def oracle(small):
    """Rows of a SQL text over the smallest tables, as comparable text, with its columns in order."""
    import duckdb

    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for path in Path(small).iterdir():
        con.sql(f"create view {path.stem} as select * from '{path}'")

    def run(sql: str):
        columns = sorted(con.sql(sql).columns)
        return columns, sorted(map(comparable, con.sql(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({sql})").fetchall()))

    return run


def comparable(row) -> tuple:
    def text(v):
        if isinstance(v, float):
            return f"{v:.9g}"
        if isinstance(v, list | tuple):
            return "[" + ",".join(map(text, v)) + "]"
        return str(v)

    return tuple(text(v) for v in row)
