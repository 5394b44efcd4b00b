import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import walk
from tickloom.operators.equity import fill, running
from tickloom.operators.spans import next_hit, spread
from tickloom.sources import bars as B, store


def test_index_and_previous_prices(spark):
    src = walk(300, 4)
    got = B.index_bars(spark.createDataFrame(src.sample(frac=1, random_state=1))).toPandas().sort_values("date").reset_index(drop=True)
    assert list(got.bar_ix) == list(range(300))
    pd.testing.assert_series_equal(got.prev_close, src.close.shift(1), check_names=False)
    pd.testing.assert_series_equal(got.prev_high, src.high.shift(1), check_names=False)
    months = pd.to_datetime(src.date).dt.to_period("M")
    assert list(got.dom) == list(src.groupby(months).cumcount() + 1)
    assert list(got.days_left) == list(src.groupby(months).cumcount(ascending=False) + 1)


def test_span_size_does_not_change_results(spark):
    df = spark.range(5000).select(F.lit("a").alias("k"), F.col("id").cast("int").alias("bar_ix"))
    hits = {"x": F.when(F.col("bar_ix").isin(3, 1023, 1024, 4000), F.struct("bar_ix"))}
    f = spread(df).filter("home")
    got = {r.bar_ix: r.x and r.x.bar_ix for r in next_hit(f, hits, ["k"]).collect()}
    want = lambda i: next((h for h in (3, 1023, 1024, 4000) if h >= i), None)
    assert all(got[i] == want(i) for i in range(5000))


def test_running_in_two_steps(spark):
    df = spark.range(3000).select(F.lit(1).alias("k"), "id", ((F.col("id") * 7919) % 101).cast("double").alias("v"))
    got = running(df, ["k"], ["id"], F.floor(F.col("id") / 64), {"s": ("sum", "v"), "m": ("max", "v"), "n": ("min", "v")}).orderBy("id").toPandas()
    v = pd.Series([(i * 7919) % 101 for i in range(3000)], dtype=float)
    assert (got.s == v.cumsum()).all() and (got.m == v.cummax()).all() and (got.n == v.cummin()).all()


def test_fill_both_ways(spark):
    v = [None, None, 1.0, None] + [None] * 3000 + [2.0, None]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(v)], "symbol string, bar_ix int, v double")
    got = fill(df, "v").orderBy("bar_ix").toPandas().v_filled
    assert list(got) == list(pd.Series(v).ffill().bfill())


def test_split_adjustment_only_where_needed(spark):
    raw = spark.createDataFrame(
        [("A", 4.0, 8.0, 4.0, 8.0, 2.0), ("A", 2.0, 2.0, 2.0, 2.0, 2.0), ("B", 3.0, 4.0, 2.0, 3.0, 3.0)],
        "symbol string, open double, high double, low double, close double, adj_close double")
    got = B.adjust_splits(raw).orderBy("symbol", "open", "high").collect()
    assert [(r.symbol, r.open, r.high, r.low, r.close) for r in got] == [("A", 1.0, 2.0, 1.0, 2.0), ("A", 2.0, 2.0, 2.0, 2.0), ("B", 3.0, 4.0, 2.0, 3.0)]


def test_bad_symbols_are_dropped(spark):
    rows = [("A", 1.0, 2.0, 1.0, 1.5, 1.5), ("A", 1.0, 2.0, 1.0, None, 1.5), ("B", 1.0, 0.5, 1.0, 1.0, 1.0), ("C", 0.0, 1.0, 0.0, 1.0, 1.0)]
    raw = spark.createDataFrame(rows, "symbol string, open double, high double, low double, close double, adj_close double")
    assert [r.symbol for r in B.clean_bars(raw).collect()] == ["A"]


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("A", 1, 1.0), ("B", 1, 2.0)], "symbol string, d int, v double")
    new = spark.createDataFrame([("B", 1, 3.0), ("C", 1, 4.0)], "symbol string, d int, v double")
    once = store.upsert(old, new, ["symbol", "d"])
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(once) == [("A", 1, 1.0), ("B", 1, 3.0), ("C", 1, 4.0)] == rows(store.upsert(once, new, ["symbol", "d"]))


def test_missing_columns_become_zero(spark):
    df = spark.createDataFrame([("A", "2020-01-01", 2.0)], "SYMBOL string, Date string, Close double")
    row = store.fit_bars(df).first()
    assert (row.symbol, row.close, row.open, row.volume) == ("A", 2.0, 0.0, 0.0)


def test_cluster_needs_a_shared_folder(spark, monkeypatch):
    from tickloom import session

    class Fake:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "yarn"

    with pytest.raises(ValueError):
        session.shared_dir(Fake())


def test_ranks_and_percentiles_of_a_large_group(spark):
    import numpy as np

    from tickloom.operators.ranks import percentiles, ranked

    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(0, 1, 4000), rng.standard_cauchy(500), np.zeros(300)]).round(4)
    df = spark.createDataFrame(pd.DataFrame({"k": ["a"] * len(x) + ["b"] * 3 + ["c"], "i": range(len(x) + 4), "v": [*x, 1.0, 1.0, 1.0, 5.0]}))
    got = percentiles(df, ["k"], "v", {"p1": 0.01, "p50": 0.5, "p99": 0.99}).toPandas().set_index("k")
    np.testing.assert_allclose(got.loc["a"].astype(float), np.percentile(x, [1, 50, 99]), atol=1e-12)
    assert list(got.loc["b"]) == [1.0] * 3 and list(got.loc["c"]) == [5.0] * 3
    r = ranked(df.filter("k = 'a'"), ["k"], "v", "i").orderBy("rank").toPandas()
    want = pd.DataFrame({"v": x, "i": range(len(x))}).sort_values(["v", "i"], ascending=[False, True])
    assert list(r.i) == list(want.i) and list(r["rank"]) == list(range(1, len(x) + 1))


def test_one_outlier_does_not_crowd_a_bucket(spark):
    from tickloom.operators.ranks import percentiles, value_buckets

    df = spark.range(50_000).selectExpr("'a' AS k", "id", "CASE WHEN id = 0 THEN 1e9 ELSE CAST((id * 7919) % 50000 AS DOUBLE) END AS v")
    sizes = [r["count"] for r in value_buckets(df, ["k"], "v").groupBy("_bk").count().collect()]
    assert sum(sizes) == 50_000 and max(sizes) <= 50_000 / 32
    ties = df.selectExpr("k", "CASE WHEN id % 3 = 0 THEN v ELSE 5.0 END AS v")
    got = percentiles(ties, ["k"], "v", {"p50": 0.5, "p100": 1.0}).first()
    assert (got.p50, got.p100) == (5.0, 1e9)
