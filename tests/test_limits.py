"""Sizes and values beyond any former limit, against plain loops."""

import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from tickloom.operators import signals, validation
from tickloom.sources import bars, store


def guard_loop(items, limit, start):
    n, out = start, {}
    for ord_, symbol, signal, watch, close, stale in items:
        final = signal
        if signal == "BUY" and not watch and n >= limit:
            final = "SKIP"
        elif signal == "BUY" and stale:
            final = "SKIP"
        if final == "BUY" and not watch and close <= 1000:
            n += 1
        if signal in ("SELL", "SAFETY_EXIT"):
            n -= 1
        out[symbol] = final
    return out


def test_slot_guard_of_many_members(spark):
    rng = random.Random(5)
    today = date(2024, 3, 1)
    rows, want = [], {}
    cases = {"rsi2": (20_000, 40, 0), "ibs": (300, 3, 9), "tom": (300, 2, 2), "other": (50, None, 0)}
    for strategy, (n, limit, start) in cases.items():
        items = []
        for i in range(n):
            signal = rng.choice(["BUY"] * 4 + ["SELL", "SELL", "SAFETY_EXIT", "HOLD", "NO_SIGNAL"])
            stale = rng.random() < 0.1
            items.append((i, f"{strategy}-{i}", signal, rng.random() < 0.1, rng.choice([10.0, 5000.0]), stale))
        rows += [(strategy, o, s, g, w, c, today - timedelta(days=60 if old else 0)) for o, s, g, w, c, old in items]
        want |= guard_loop(items, limit if limit is not None else 10**9, start)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "strategy string, ord int, symbol string, raw_signal string, is_watch boolean, close double, date date")
    counts = spark.createDataFrame([("ibs", 9), ("tom", 2)], "strategy string, n_open long")
    got = signals.guard(df, counts, {"rsi2": 40, "ibs": 3, "tom": 2}, 1000.0, 1.0, F.lit(today)).collect()
    assert len(got) == len(rows)
    assert {r.symbol: r.signal for r in got} == want


def test_report_of_many_symbols(spark):
    cols = ["win_rate", "profit_factor", "sharpe", "net_return_pct", "robustness_pct", "ttest_p"]
    verdict = F.when(F.col("id") % 3 == 0, "VALIDATED").otherwise("REJECTED")
    rows = spark.range(12_000).select(F.lit("ibs").alias("strategy"), F.lit("all").alias("universe"), F.format_string("S%05d", "id").alias("symbol"),
                                      F.lit(3).cast("long").alias("n_trades"), *[F.lit(0.123456789).alias(c) for c in cols], F.lit(True).alias("stable"), verdict.alias("verdict"))
    assets = store.read_report(spark, store.write_report(rows, "report-test"))
    assert assets.count() == 12_000
    summary = store.report_summary(assets).collect()
    assert [(r.n_assets, len(r.validated), len(r.rejected)) for r in summary] == [(12_000, 4_000, 8_000)]


def test_prices_and_line_numbers_of_any_size(spark, tmp_path):
    lines = [(1, 9, 1, 1, 1.0, 0.0, date(2024, 1, 2)), (2, 1, 2, 1, 1.0, 0.0, date(2024, 1, 2)), (1, 8, 2, 1, 1.0, 0.5, date(2024, 1, 2))]
    tables = {
        "lineitem": (lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_discount double, l_shipdate date"),
        "part": ([(1, 20000.0), (2, 30000.0)], "p_partkey long, p_retailprice double"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    bar = bars.ohlcv(bars.lineitem_ticks(spark, str(tmp_path), "supplier"), ["symbol"], "date").first()
    assert (bar.open, bar.high, bar.low, bar.close) == (15000.0, 30000.0, 15000.0, 30000.0)


def test_halves_of_a_recent_symbol(spark):
    day = lambda i: date(2020, 1, 1) + timedelta(days=i)
    rows = [("old", day(i), i) for i in range(100)] + [("new", day(80 + i), i) for i in range(20)]
    frame = spark.createDataFrame(rows, "symbol string, date date, bar_ix int")
    frame = frame.withColumn("home", F.lit(True))
    got = validation.period_frame(frame, validation.Periods(str(day(10)), str(day(50))), warmup=4)
    first = {(r.symbol, r.period): (r.n, r.lo) for r in got.groupBy("symbol", "period").agg(F.count("*").alias("n"), F.min("bar_ix").alias("lo")).collect()}
    assert first == {("old", "oos"): (90, 10), ("old", "a"): (40, 10), ("old", "b"): (50, 50), ("new", "oos"): (20, 0), ("new", "a"): (12, 0), ("new", "b"): (8, 12)}
