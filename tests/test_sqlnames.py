"""Functions with SQL bodies against the columns they stand for."""

import random

import pytest
from pyspark.sql import functions as F

from tickloom.functions import scalars as S, sqlnames
from tickloom.operators import metrics as M


def test_p_values_equal_the_columns(spark):
    sqlnames.register(spark)
    rows = [(t, n) for t in (-1.0, 0.0, 0.01, 0.7, 1.65, 3.3, 7.9) for n in (2, 3, 4, 11, 12, 60, 400, 401, 402, 5_000, 3_000_000)]
    df = spark.createDataFrame(rows, "t double, n long")
    both = df.select("t", "n", F.expr("one_sided_p(t, n)").alias("p"), F.when(F.col("t") > 0, S.student_tail(F.col("t"), F.col("n") - 1)).otherwise(1.0).alias("want"))
    for r in both.collect():
        assert r.p == pytest.approx(r.want, rel=1e-9, abs=1e-15), (r.t, r.n)


def test_table_function(spark):
    r = random.Random(2)
    rows = [(s, r.gauss(1, 20), r.gauss(0.001, 0.02), i * 5, i * 5 + r.randrange(1, 5), r.random() < 0.9) for s in "ABC" for i in range(r.choice([1, 30, 500]))] + [("LUCKY", 2.0, 0.1, 0, 4, True)]
    trades = spark.createDataFrame(rows, "symbol string, pnl double, return_pct double, entry_ix int, exit_ix int, closed boolean").repartition(3)
    sqlnames.register_table(spark, trades)
    got = spark.sql("SELECT symbol, profit_factor, sharpe, t_stat, p_value FROM trade_metrics() WHERE n_trades > 0 ORDER BY symbol")
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and plan.count("Exchange hashpartitioning") <= plan.count("HashAggregate")
    shut = trades.where("closed")
    want = shut.groupBy("symbol").agg(M.profit_factor(F.col("pnl")).alias("profit_factor"), M.sharpe(F.col("return_pct"), F.col("entry_ix"), F.col("exit_ix")).alias("sharpe"))
    want = want.join(M.t_test(trades, ["symbol"]).select("symbol", "t_stat", "p_value"), "symbol").orderBy("symbol")
    for a, b in zip(got.collect(), want.collect(), strict=True):
        assert a.symbol == b.symbol and list(a)[1:] == pytest.approx(list(b)[1:], rel=1e-9)
