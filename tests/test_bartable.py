"""The bar table that is updated in place."""

import datetime
import glob
import os

import pandas as pd

from conftest import walk
from tickloom.sources import bartable


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/bucket=*/month=*/*.parquet")}


def test_only_touched_months_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "bars")
    src = pd.concat([walk(120, k, f"S{k}") for k in range(3)])
    bars = spark.createDataFrame(src)
    bartable.update(bars, path)
    before = files(path)
    months = src.groupby(["symbol", src.date.map(lambda d: d.strftime("%Y-%m"))]).ngroups
    assert len(before) <= months  # one file per bucket and month
    late = src[(src.symbol == "S1") & (src.date >= datetime.date(2010, 5, 1))].assign(close=1.0)
    extra = pd.DataFrame([("S1", datetime.date(2010, 1, 2), 1.0, 2.0, 0.5, 1.5, 9.0)], columns=src.columns)
    for _ in range(2):  # a replayed update changes nothing
        bartable.update(spark.createDataFrame(pd.concat([late, extra])), path)
        want = src.merge(late[["symbol", "date"]].assign(late=True), how="left", on=["symbol", "date"])
        want["close"] = want.close.where(want.late.isna(), 1.0)
        want = pd.concat([want.drop(columns="late"), extra]).sort_values(["symbol", "date"]).values.tolist()
        got = bartable.read(spark, path, bars.schema).select(*src.columns).toPandas().sort_values(["symbol", "date"]).values.tolist()
        assert got == want
    after = files(path)
    touched = {f.split("month=")[1][:7] for f in set(after) - set(before)}
    assert touched == {"2010-01", "2010-05", "2010-06"}
    assert sum(f in after for f in before) >= len(before) - 3 and len(after) <= len(before) + 3


def test_reads_are_pruned(spark, tmp_path):
    path = str(tmp_path / "bars")
    src = pd.concat([walk(300, k, f"S{k}") for k in range(8)])
    bars = spark.createDataFrame(src)
    bartable.update(bars, path)
    some = bartable.read(spark, path, bars.schema, ["S3"], datetime.date(2010, 3, 10), datetime.date(2010, 4, 9))
    want = src[(src.symbol == "S3") & (src.date >= datetime.date(2010, 3, 10)) & (src.date <= datetime.date(2010, 4, 9))]
    assert some.count() == len(want) > 0
    assert len(some.inputFiles()) > 2
    plan = some._jdf.queryExecution().executedPlan().toString()
    held = plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "bucket" in held and "month" in held


def test_empty_update(spark, tmp_path):
    path = str(tmp_path / "bars")
    bars = spark.createDataFrame(walk(5, 1))
    bartable.update(bars, path)
    bartable.update(bars.where("false"), path)
    assert bartable.read(spark, path, bars.schema).count() == 5
