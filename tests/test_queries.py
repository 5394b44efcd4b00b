"""A sample of registered queries against their check SQL on the smallest data."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from oracle_check import normal
from tickloom.plans.registry import ORACLES, QUERIES

SAMPLE = ["SRC1", "DQ1", "CAT1", "IND5", "IND6", "STR3", "LED2", "LED5", "AGG1", "AGG6", "AGG10", "AGG26", "JON6", "JON9", "SET1", "SIG1", "STM1", "WIN6"]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_same_rows_as_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    got = pd.DataFrame([list(r) for r in df.collect()], columns=df.columns, dtype=object)
    cur = duck.execute(ORACLES[name])
    want = pd.DataFrame(cur.fetchall(), columns=[d[0] for d in cur.description], dtype=object)
    a, b = normal(got), normal(want)
    assert list(a.columns) == list(b.columns) and len(a) == len(b)
    assert a.equals(b)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


def test_changed_files_give_new_answers(spark, sf_dir, tmp_path):
    """Derived tables are kept per state of the folder, not per name."""
    import shutil

    for f in glob.glob(f"{sf_dir}/*.parquet"):
        shutil.copy(f, tmp_path)
    before = QUERIES["CAT1"](spark, str(tmp_path)).collect()
    li = pd.read_parquet(tmp_path / "lineitem.parquet")
    li.iloc[: len(li) // 2].to_parquet(tmp_path / "lineitem.parquet", index=False)
    after = QUERIES["CAT1"](spark, str(tmp_path)).collect()
    assert sum(r.n_rows for r in after) < sum(r.n_rows for r in before)
    assert sorted(map(str, before)) == sorted(map(str, QUERIES["CAT1"](spark, sf_dir).collect()))
