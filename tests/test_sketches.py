"""Monthly sketches against exact figures; merging in any order."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tickloom.operators import sketches as K


def test_percentiles_of_merged_months(spark):
    rng = np.random.default_rng(1)
    n = 60_000
    days = pd.to_datetime("2001-01-01") + pd.to_timedelta(rng.integers(0, 365, n), unit="D")
    df = pd.DataFrame({"symbol": rng.choice(["A", "B"], n, p=[0.9, 0.1]), "exit_date": days.date, "return_pct": rng.standard_t(3, n)})
    months = K.monthly_sketches(spark.createDataFrame(df), k=200).cache()
    assert months.count() == 24
    probs = (1, 5, 25, 50, 75, 95, 99)
    for parts in (1, 5):  # the order of merging changes neither counts nor bounds
        year = K.merged(months.repartition(parts, F.rand(parts)), ["symbol"])
        for r in K.percentiles_of(year, ["symbol"], "return_pct", probs).collect():
            own = np.sort(df.return_pct[df.symbol == r.symbol].to_numpy())
            assert r.n == len(own) and abs(r.n_days - 365) <= 0.05 * 365
            for p in probs:
                assert abs(np.searchsorted(own, r[f"p{p}"]) / len(own) - p / 100) < 0.025


def test_small_groups_are_exact(spark):
    df = pd.DataFrame({"symbol": "A", "exit_date": pd.to_datetime(["2001-01-03", "2001-01-03", "2001-02-05", "2001-03-01"]).date, "return_pct": [4.0, 1.0, 3.0, 2.0]})
    both = spark.createDataFrame(df).unionByName(spark.createDataFrame(df.assign(exit_date=None, return_pct=99.0), "symbol string, exit_date date, return_pct double"))
    got = K.percentiles_of(K.merged(K.monthly_sketches(both), ["symbol"]), ["symbol"], "return_pct", (25, 50, 100)).first()
    assert tuple(got) == ("A", 4, 3, 1.0, 2.0, 4.0)
    assert K.merged(K.monthly_sketches(both.where("false")), ["symbol"]).collect() == []
