"""A Spark session for all tests, and the comparison of rows with DuckDB's."""

from __future__ import annotations

import datetime
import math
import os
import sys
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import DataFrame, SparkSession

TESTS = Path(__file__).resolve().parent
sys.path.insert(0, str(TESTS.parent))
#: Python workers find functions of the test modules too.
os.environ["PYTHONPATH"] = os.pathsep.join([str(TESTS.parent), str(TESTS), str(TESTS / "llm"), os.environ.get("PYTHONPATH", "")])

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    conf = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "6g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    session = SparkSession.builder.master("local[8]").appName("tests").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return SF_DIR


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def plain(value):
    """A value that compares alike whichever engine made it."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, Decimal):
        return float(f"{value:.9g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


#: Types that the two engines may pair.
KINDS = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "DATE": "date", "BLOB": "binary", "SMALLINT": "smallint", "FLOAT": "float"}


def assert_same(df: DataFrame, sql: str, sf_dir: str) -> int:
    """df has the rows, names and types of the SQL; returns how many rows."""
    result = duck(sf_dir).execute(sql)
    names, types = [d[0] for d in result.description], [str(d[1]) for d in result.description]
    assert sorted(df.columns) == sorted(names)
    want = bag(names, result.fetchall())
    got = bag(df.columns, df.collect())
    missing, extra = want - got, got - want
    assert not missing and not extra, f"{sum(missing.values())} missing, {sum(extra.values())} extra; e.g. {list(missing)[:2]} against {list(extra)[:2]}"
    kinds = dict(df.dtypes)
    unlike = {n: (kinds[n], t) for n, t in zip(names, types, strict=True) if KINDS.get(t, t) != kinds[n]}
    integers = {"int", "bigint", "smallint"}
    unlike = {n: x for n, x in unlike.items() if not (x[0] in integers and KINDS.get(x[1]) in integers)}
    assert not unlike, f"types differ: {unlike}"
    return sum(want.values())
