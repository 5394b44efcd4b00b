"""Ranges of bars by blocks and trades that do not overlap, against plain loops."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import walk
from tickloom.operators import blocks as K
from tickloom.operators.equity import adverse_excursion
from tickloom.operators.ledger import EXIT, Account, ledger
from tickloom.operators.overlap import without_overlap
from tickloom.operators.rules import IBS
from tickloom.sources.bars import index_bars


@pytest.fixture(scope="module")
def long_bars(spark):
    """9,000 bars of one symbol (more than two wide blocks) and 300 of another."""
    rows = pd.concat([walk(9000, 1, "LONG", "1980-01-01"), walk(300, 2, "SHORT")])
    return index_bars(spark.createDataFrame(rows)).select("symbol", "bar_ix", "date", "open", "high", "low", "close", "volume").cache()


def as_dict(bars):
    return {s: g.sort_values("bar_ix").to_dict("records") for s, g in bars.toPandas().groupby("symbol")}


def test_first_reach(spark, long_bars):
    rows, r = as_dict(long_bars), random.Random(3)
    cands = []
    for k in range(400):
        s = r.choice(["LONG", "LONG", "SHORT"])
        n = len(rows[s])
        first = r.randrange(n)
        last = r.choice([first, min(n - 1, first + r.randrange(300)), n - 1])
        side = r.choice([1, -1])
        level = rows[s][first]["close"] * (1 - side * r.choice([0.001, 0.02, 0.1, 0.3, 0.6]))
        cands.append((s, k, side, level, first, last))
    df = spark.createDataFrame(cands, "symbol string, k int, direction int, level double, first int, last int")
    got = {x.k: x.hit.bar_ix for x in K.first_reach(df, K.bar_blocks(long_bars), ["symbol"], ["k"]).collect()}
    want = {}
    for s, k, side, level, first, last in cands:
        hit = next((i for i in range(first, last + 1) if (rows[s][i]["low"] <= level if side > 0 else rows[s][i]["high"] >= level)), None)
        if hit is not None:
            want[k] = hit
    assert got == want
    far = [want[k] - first for _, k, _, _, first, _ in cands if k in want]
    assert max(far) > K.SIZE * K.WIDE and min(far) == 0 and len(want) < len(cands)


def test_between(spark, long_bars):
    rows, r = as_dict(long_bars), random.Random(4)
    trades = []
    for k in range(300):
        s = r.choice(["LONG", "LONG", "SHORT"])
        a = r.randrange(len(rows[s]))
        b = r.choice([a, min(len(rows[s]) - 1, a + r.randrange(2 * K.SIZE)), r.randrange(a, len(rows[s]))])
        trades.append((k, s, a, b, 100.0))
    df = spark.createDataFrame(trades, "k int, symbol string, entry_ix int, exit_ix int, entry_price double")
    got = {x.k: (x.low, x.high, x.n_bars, x.volume) for x in K.between(df, K.bar_blocks(long_bars), sums=True).collect()}
    want = {}
    for k, s, a, b, _ in trades:
        held = rows[s][a : b + 1]
        want[k] = (min(x["low"] for x in held), max(x["high"] for x in held), b - a + 1, sum(x["volume"] for x in held))
    assert got == want
    mae = {x.k: x.mae_pct for x in adverse_excursion(df, long_bars).collect()}
    assert mae == {k: pytest.approx(want[k][0] / 100.0 - 1) for k in want}
    assert adverse_excursion(df.where("false"), long_bars).collect() == []


@pytest.mark.parametrize("size", [1, 7, 64, 5000])
def test_without_overlap(spark, size):
    r, rows = random.Random(size), []
    for g in range(12):
        for _ in range(r.choice([0, 1, 5, 60, 200])):
            e = r.randrange(600)
            rows.append((f"g{g}", e, r.choice([1, -1]), r.choice([e, e + 1, e + r.randrange(90), None]) if r.random() < 0.9 else e + 500))
    rows = list({(g, e, d): (g, e, d, x) for g, e, d, x in rows}.values())
    df = spark.createDataFrame(rows, "grp string, entry_ix int, direction int, x int")
    ex = F.when(F.col("x").isNotNull(), F.expr("named_struct('bar_ix', x, 'prio', 3, 'date', CAST(NULL AS DATE), 'price', 1.0D, 'reason', 'r', 'slip', false)")).cast(EXIT)
    got = sorted((t.grp, t.entry_ix, t.direction, t.x) for t in without_overlap(df.withColumn("exit", ex), ["grp"], F.lit(3), size).collect())
    want = []
    for g in sorted({x[0] for x in rows}):
        free = -1
        for _, e, d, x in sorted((q for q in rows if q[0] == g), key=lambda q: (q[1], -q[2])):
            if e >= free:
                want.append((g, e, d, x))
                free = 10**9 if x is None else x + 1 + 3
    assert got == sorted(want)


def test_no_walk_where_capital_does_not_feed_back(spark, long_bars, monkeypatch):
    """Stops, cooldown and both sides of a fractional account need no walk over rows; a stop per combination."""
    monkeypatch.setattr("tickloom.operators.ledger.ordered_walk", None)
    combos = [IBS.params(sma_trend_period=50, sl_percent=s, cooldown_candles=c) for s, c in ((0.0, 0), (0.5, 3), (2.0, 1))]
    got = ledger(long_bars, IBS, combos, Account(fees="forex_saxo"), sides=(1, -1))
    for k, p in enumerate(combos):
        alone = ledger(long_bars, IBS, [p], Account(fees="forex_saxo"), sides=(1, -1))
        cols = ["symbol", "entry_ix", "exit_ix", "exit_reason"]
        assert sorted(map(str, alone.select(cols).collect())) == sorted(map(str, got.where(f"combo_id = {k}").select(cols).collect()))
