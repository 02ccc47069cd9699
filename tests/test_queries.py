"""Every feedback query with SQL gives the same rows in both engines; the entry stands without the optional parts."""

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from fernwell.plans import rule_queries, rule_sql  # noqa: F401 - they add to both
from fernwell.plans.feedback_queries import QUERIES
from fernwell.plans.feedback_sql import ORACLE_SQL

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from read_parquet('{p}/*.parquet')" if p.is_dir() else f"create view {p.stem} as select * from '{p}'")
    return c


def rows(frame):
    def show(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return f"{float(v):.9g}" if isinstance(v, (int, float, bool)) or hasattr(v, "item") else str(v)

    return sorted(tuple(show(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, con, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_queries_without_sql_run(spark):
    for name in set(QUERIES) - set(ORACLE_SQL):
        assert QUERIES[name](spark, SF).count() > 0


def test_entry_without_the_optional_parts(tmp_path):
    shutil.copytree(ROOT / "fernwell", tmp_path / "fernwell", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert said.stdout.split() == [str(len(QUERIES)), str(len(ORACLE_SQL)), "False"], said.stderr
