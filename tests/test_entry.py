"""Every registered catalogue query against its SQL, and the entry point with and without the other operators."""

import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from starledger.plans import queries

ROOT = Path(__file__).resolve().parents[1]
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def comparable(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return value if value is None or isinstance(value, (bool, int)) else str(value)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(name, spark, sf_dir, duck):
    df, other = queries.QUERIES[name](spark, sf_dir), duck.sql(queries.SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(other.columns)
    at = [other.columns.index(c) for c in columns]
    mine = sorted(([comparable(r[c]) for c in columns] for r in df.collect()), key=str)
    theirs = sorted(([comparable(r[i]) for i in at] for r in other.fetchall()), key=str)
    assert mine == theirs


def test_every_query_has_sql():
    assert set(queries.SQL) == set(queries.QUERIES)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_entry_stands_alone(tmp_path):
    """Without the folder of training-data operators and the pipeline, the rest imports."""
    subprocess.run(["cp", "-r", str(ROOT / "starledger"), str(ROOT / "__spark_entry__.py"), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "starledger" / "llm")], check=True)
    code = "import __spark_entry__ as e; print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.returncode == 0 and int(out.stdout) == len(queries.QUERIES), out.stderr


def test_rest_stands_without_the_folders_of_training_data_operators(tmp_path):
    """In a copy without both folders and the pipeline, all other tests are collected, and the SQL of every query is there."""
    names = ["starledger", "tests", "__spark_entry__.py", "bench.py"]
    subprocess.run(["cp", "-r", *(str(ROOT / n) for n in names), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "starledger/llm"), str(tmp_path / "tests/llm")], check=True)
    run = lambda *a: subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", *a], cwd=tmp_path, capture_output=True, text=True)
    listed = run("--collect-only", "tests")
    assert listed.returncode == 0 and "error" not in listed.stdout.lower(), listed.stdout
    done = run("tests/test_entry.py", "-k", "has_sql or flagship or s4_catalogue")
    assert done.returncode == 0 and "3 passed" in done.stdout, done.stdout
