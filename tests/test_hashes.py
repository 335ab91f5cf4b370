"""Joins on the bucketed table of hashes: the same results as the plain ones, and no exchange of the catalogue."""

import datetime as dt
import random
import re

import pytest

from starledger.operators import duplicates
from starledger.plans.hashes import HashTable
from starledger.plans.ingest import ingest
from starledger.schema import IMAGE_FILES, SCANNED

from .test_catalog import images


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = random.Random(4)
    rows = [{"id": i, "library_id": rng.choice([1, 1, 2]), "path": f"/P/{i}.fits", "header_hash": None if i % 50 == 0 else rng.choice("aA") + f"{rng.randrange(300):039}", "file_size": 10, "type": 1, "kind": 1} for i in range(600)]
    df = images(spark, rows)
    scanned = [(r["path"].lower() if i % 3 else r["path"] + ".new", 10 + i % 2, None, None, r["header_hash"], None, "bad" if i % 17 == 0 else None) for i, r in enumerate(rows[::2])]
    scanned.append(("/p/x.fits", 1, None, None, "b" * 40, None, None))
    table = HashTable(spark, "hashes_of_test", 4)
    spark.sql("DROP TABLE IF EXISTS hashes_of_test")
    table.write(df)
    yield df, spark.createDataFrame(scanned, SCANNED), table
    spark.sql("DROP TABLE IF EXISTS hashes_of_test")


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def rows(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


def exchanges_of_the_table(df):
    """Exchanges above a scan of the table: its part of the plan has none between the scan and the join."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    lines = [(len(re.match(r"[\s:+*\-]*", x)[0]), x) for x in final.split("\n")]
    found = 0
    for i, (depth, line) in enumerate(lines):
        if "FileScan" in line and "hashes_of_test" in line:
            above = depth
            for d, other in lines[i::-1]:
                if d < above:
                    above = d
                    if "Join" in other:
                        break
                    found += "Exchange" in other
    assert any("FileScan" in x and "hashes_of_test" in x for _, x in lines) and "Join" in final
    return found


def test_matches_and_new_files(made, no_broadcast):
    df, scanned, table = made
    plan = ingest(df, scanned, 1, dt.datetime(2024, 1, 1))
    met, new = table.matched(scanned, 1), table.new_files(scanned, 1)
    assert rows(met, "path", "status") == rows(plan.statuses.where("status in ('updated', 'skipped')"), "path", "status") and met.count() > 20
    assert rows(new, "path", "header_hash") == rows(plan.added, "path", "header_hash") and new.count() > 20
    changed = {r["id"]: r["file_size"] for r in plan.changed.collect()}
    assert {r["id"]: r["file_size"] for r in met.where("status = 'updated'").collect()} == changed
    assert exchanges_of_the_table(met) == exchanges_of_the_table(new) == 0


def test_duplicates(made, no_broadcast):
    df, _, table = made
    got = table.duplicates(1)
    assert rows(got, "id", "path") == rows(duplicates.duplicates(df, 1), "id", "path") and got.count() > 20
    assert exchanges_of_the_table(got) == 0
    assert IMAGE_FILES.names[0] == "id"
