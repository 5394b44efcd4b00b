"""Ledgers against a plain bar-by-bar loop on seeded series."""

import math

import pandas as pd
import pytest

from conftest import walk
from tickloom.operators.indicators import home_rows
from tickloom.operators.ledger import Account, frame_for, ledger
from tickloom.operators.rules import DONCHIAN, IBS, IBS_TOM, LONG, RSI2, SHORT, TOM
from tickloom.presets import FEES
from tickloom.sources.bars import index_bars

FREE = Account(capital=100_000.0, fees="forex_saxo")
STRICT = Account(capital=5_000.0, fees="us_stocks_usd_account", whole_shares=True)
ZERO_POOR = Account(capital=900.0, fees="us_stocks_usd_account", whole_shares=True)


@pytest.fixture(scope="module")
def bars(spark):
    rows = pd.concat([walk(1500, s, f"S{s}") for s in range(3)] + [walk(180, 9, "SHORT")])
    return index_bars(spark.createDataFrame(rows)).cache()


def none(v):
    return None if v is None or v != v else v


def rule_entry(key, p, side, rows, i):
    a = rows[i - 1]
    if key == "rsi2":
        r, t = none(a["rsi_2"]), none(a[f"sma_{p['sma_trend_period']}"])
        if r is None or t is None:
            return False
        if side == LONG:
            return r < p["rsi_entry_threshold"] and a["close"] > t * p["sma_trend_buffer"]
        return r > 100 - p["rsi_entry_threshold"] and a["close"] < t / p["sma_trend_buffer"]
    if key == "ibs":
        b, t = none(a["ibs"]), none(a[f"sma_{p['sma_trend_period']}"])
        if b is None or t is None:
            return False
        if side == LONG:
            return b < p["ibs_entry_threshold"] and a["close"] > t
        return b > 1 - p["ibs_entry_threshold"] and a["close"] < t
    if key == "tom":
        return side == LONG and a["days_left"] <= p["entry_days_before_eom"]
    if key == "ibs_tom":
        b, t = none(a["ibs"]), none(a[f"sma_{p['sma_trend_period']}"])
        return side == LONG and a["days_left"] <= p["entry_days_before_eom"] and b is not None and t is not None and b < p["ibs_entry_threshold"] and a["close"] > t
    adx = none(a["adx_14"])
    if p["adx_threshold"] > 0 and (adx is None or adx < p["adx_threshold"]):
        return False
    n = p["donchian_entry_period"]
    hi, lo = none(a[f"high_{n}"]), none(a[f"low_{n}"])
    if hi is None or lo is None:
        return False
    return a["close"] > hi if side == LONG else a["close"] < lo


def rule_exit(key, p, side, rows, i, pos):
    b, c = rows[i], rows[i]["close"]
    up = side == LONG
    if key == "rsi2":
        f, t = none(b[f"sma_{p['sma_exit_period']}"]), none(b[f"sma_{p['sma_trend_period']}"])
        if f is not None and (c > f if up else c < f):
            return c, "sma_exit", False
        if t is not None and (c < t if up else c > t):
            return c, "trend_break", False
    if key == "ibs":
        v, t = none(b["ibs"]), none(b[f"sma_{p['sma_trend_period']}"])
        if v is not None and (v > p["ibs_exit_threshold"] if up else v < 1 - p["ibs_exit_threshold"]):
            return c, "ibs_exit", False
        if c > rows[i - 1]["high"] if up else c < rows[i - 1]["low"]:
            return c, "prev_high_exit" if up else "prev_low_exit", False
        if t is not None and (c < t if up else c > t):
            return c, "trend_break", False
    if key in ("tom", "ibs_tom"):
        if i - pos["e"] >= p["max_holding_days"]:
            return c, "max_holding_exit", False
        if b["month"] != rows[pos["e"]]["month"]:
            if b["dom"] >= p["exit_day_of_new_month"]:
                return c, "tom_exit", False
            if key == "ibs_tom" and none(b["ibs"]) is not None and b["ibs"] > p["ibs_exit_threshold"]:
                return c, "ibs_early_exit", False
    if key == "donchian":
        k = 1 if up else -1
        level = pos["level"]
        if level is not None and (level > 0 or not up) and k * b["open"] <= k * level:
            return b["open"], "gap_trailing", False
        atr = none(rows[i - 1]["atr_14"]) or 0.0
        best = b["high"] if up else b["low"]
        if atr > 0 and i > pos["e"] and k * best > k * pos["hwm"]:
            pos["hwm"] = best
            pos["level"] = level = best - k * atr * p["trailing_atr_mult"]
        worst = b["low"] if up else b["high"]
        if i > pos["e"] and level is not None and (level > 0 or not up) and k * worst <= k * level:
            return level, "trailing", True
        if p["exit_mode"] == "channel" and i > pos["e"]:
            ch = none(rows[i - 1][f"{'low' if up else 'high'}_{p['donchian_exit_period']}"])
            if ch is not None and (c < ch if up else c > ch):
                return c, "channel", False
    return None


def plain_loop(rule, p, account, rows, sides):
    com, cpct, spr, fx, tax, night = FEES[account.fees]
    rate = cpct + spr / 2 + fx
    cap = peak = account.capital
    trades, skipped, pos, cool = [], 0, None, 0
    slip, stop = account.slippage, p.get("sl_percent", 0.0) / 100

    def shut(i, price, why, slipped):
        nonlocal cap, peak, pos, cool
        d = pos["d"]
        price = price * (1 - d * slip) if slipped else price
        pnl = d * (price - pos["p"]) * pos["q"] - pos["fee"] - com - price * pos["q"] * rate - pos["p"] * pos["q"] * night * (i - pos["e"])
        cap += pos["n"] + pnl
        if cap > 0:
            trades.append((pos["e"], i, d, why, round(pnl, 6)))
        peak, pos, cool = max(peak, cap), None, p.get("cooldown_candles", 0)

    def stop_hit(i, day0):
        d, b = pos["d"], rows[i]
        if stop <= 0:
            return False
        if not day0 and d * b["open"] <= d * pos["sl"]:
            shut(i, b["open"], "gap_sl", False)
            return True
        worst = b["low"] if d == 1 else b["high"]
        if d * worst <= d * pos["sl"]:
            shut(i, pos["sl"], "intraday_sl", True)
            return True
        return False

    for i in range(rule.warmup(p), len(rows)):
        if cap + (pos["n"] if pos else 0) < peak * (1 - account.max_drawdown_pct / 100):
            break
        if pos is None:
            if cool > 0:
                cool -= 1
                continue
            d = next((s for s in sides if rule_entry(rule.key, p, s, rows, i)), None)
            if d is None:
                continue
            price = rows[i]["open"] * (1 + d * slip)
            q = cap * p["position_fraction"] / price
            if account.whole_shares:
                q = math.floor(q)
                if q < 1:
                    skipped += 1
                    continue
            n = q * price
            pos = {"e": i, "p": price, "q": q, "n": n, "d": d, "fee": com + n * (rate + tax), "sl": price * (1 - d * stop), "hwm": price, "level": None}
            atr = none(rows[i - 1].get("atr_14")) or 0.0
            if rule.key == "donchian" and atr > 0:
                pos["level"] = price - d * atr * p["trailing_atr_mult"]
            cap -= n
            if stop_hit(i, True):
                continue
        elif stop_hit(i, False):
            continue
        out = rule_exit(rule.key, p, pos["d"], rows, i, pos)
        if out:
            shut(i, *out)
    if pos:
        i, d = len(rows) - 1, pos["d"]
        price = rows[i]["close"]
        cap += pos["n"] + d * (price - pos["p"]) * pos["q"] - pos["fee"] - com - price * pos["q"] * rate - pos["p"] * pos["q"] * night * (i - pos["e"])
    return trades, skipped, cap


CASES = {
    "ibs closed form": (IBS, dict(sma_trend_period=50), FREE, (LONG,)),
    "ibs whole shares": (IBS, dict(sma_trend_period=50), STRICT, (LONG,)),
    "ibs too poor": (IBS, dict(sma_trend_period=50), ZERO_POOR, (LONG,)),
    "ibs short": (IBS, dict(sma_trend_period=50), FREE, (SHORT,)),
    "ibs both sides": (IBS, dict(sma_trend_period=50), STRICT, (LONG, SHORT)),
    "ibs cooldown and stop": (IBS, dict(sma_trend_period=50, sl_percent=0.5, cooldown_candles=3), FREE, (LONG,)),
    "ibs stop both sides": (IBS, dict(sma_trend_period=50, sl_percent=0.4), STRICT, (LONG, SHORT)),
    "rsi": (RSI2, dict(sma_trend_period=50, rsi_entry_threshold=20, sma_trend_buffer=1.0), FREE, (LONG,)),
    "rsi drawdown guard": (RSI2, dict(sma_trend_period=20, rsi_entry_threshold=40, sma_trend_buffer=1.0, position_fraction=1.0),
                           Account(capital=100_000.0, slippage=0.02, fees="forex_saxo", max_drawdown_pct=30.0), (LONG,)),
    "tom": (TOM, {}, STRICT, (LONG,)),
    "tom short hold": (TOM, dict(max_holding_days=3, cooldown_candles=2), FREE, (LONG,)),
    "ibs_tom": (IBS_TOM, dict(sma_trend_period=50, ibs_entry_threshold=0.5), FREE, (LONG,)),
    "trailing": (DONCHIAN, dict(donchian_entry_period=20, adx_threshold=10.0, trailing_atr_mult=2.0, sl_percent=4.0), FREE, (LONG,)),
    "trailing both": (DONCHIAN, dict(donchian_entry_period=20, adx_threshold=0, trailing_atr_mult=3.0, sl_percent=3.0), STRICT, (LONG, SHORT)),
    "channel short": (DONCHIAN, dict(donchian_entry_period=20, donchian_exit_period=10, adx_threshold=0, exit_mode="channel", trailing_atr_mult=5.0), FREE, (SHORT,)),
}


@pytest.mark.parametrize("name", list(CASES))
def test_matches_plain_loop(bars, name):
    rule, changes, account, sides = CASES[name]
    p = rule.params(**changes)
    rows = home_rows(frame_for(bars, rule, [p])).toPandas().sort_values(["symbol", "bar_ix"])
    got = ledger(bars, rule, [p], account, sides=sides).toPandas()
    total = 0
    for symbol, g in rows.groupby("symbol"):
        want, skipped, cap = plain_loop(rule, p, account, g.to_dict("records"), sides)
        mine = got[got.symbol == symbol].sort_values("entry_ix")
        shut = mine[mine.closed]
        have = [(int(a), int(b), int(d), r, round(x, 6)) for a, b, d, r, x in zip(shut.entry_ix, shut.exit_ix, shut.direction, shut.exit_reason, shut.pnl)]
        assert [h[:4] for h in have] == [w[:4] for w in want], (symbol, name)
        for h, w in zip(have, want):
            assert h[4] == pytest.approx(w[4], rel=1e-7, abs=1e-6)
        assert int((mine.status == "skipped").sum()) == skipped
        assert account.capital + mine.pnl.fillna(0).sum() == pytest.approx(cap, rel=1e-9)
        total += len(want)
    assert total > 0 or name == "ibs too poor"


def test_rule_reads_only_the_past(spark, bars):
    """Changing the future leaves earlier trades as they were."""
    from pyspark.sql import functions as F

    cut = 900
    p = IBS.params(sma_trend_period=50)
    moved = bars.drop("prev_close", "prev_high", "prev_low")
    k = F.when(F.col("bar_ix") >= cut, 1.37).otherwise(1.0)
    moved = moved.withColumns({c: F.col(c) * k for c in ("open", "high", "low", "close")})
    key = lambda df: {tuple(r) for r in df.filter(f"exit_ix < {cut}").select("symbol", "entry_ix", "exit_ix", F.round("pnl", 6)).collect()}
    assert key(ledger(bars, IBS, [p], FREE)) == key(ledger(moved, IBS, [p], FREE))


def test_window_is_half_open(bars):
    from pyspark.sql import functions as F

    p = IBS.params(sma_trend_period=50)
    got = ledger(bars, IBS, [p], FREE, start=F.col("bar_ix") >= 300, end=F.col("bar_ix") < 600).toPandas()
    assert got.entry_ix.min() >= 300 and got.exit_ix.dropna().max() <= 599
    assert set(got[~got.closed].holding_days + got[~got.closed].entry_ix) <= {599, 179}


def test_trend_grid_equals_single_runs(spark, sf_dir):
    """Each combination of a grid with two EMA pairs and two ATR periods gives the trades it gives alone."""
    from tickloom.operators.ledger import ledger
    from tickloom.plans import registry  # noqa: F401
    from tickloom.plans.base import Tables
    from tickloom.plans.trading import ACCOUNT, TREND
    from tickloom.operators.rules import DONCHIAN

    bars = Tables(spark, sf_dir).bars()
    signal = {**TREND, "entry_mode": "ema_cross", "exit_mode": "signal"}
    grid = [{**signal, "ema_fast": 9, "ema_slow": 50}, {**signal, "ema_fast": 5, "ema_slow": 20}, {**TREND, "atr_period": 14}, {**TREND, "atr_period": 7}]
    cols = ["symbol", "entry_ix", "exit_ix", "exit_reason"]
    both = ledger(bars, DONCHIAN, grid, ACCOUNT).select("combo_id", *cols).collect()
    for k, p in enumerate(grid):
        alone = ledger(bars, DONCHIAN, [p], ACCOUNT).select(*cols).collect()
        assert alone and sorted(tuple(map(str, r)) for r in alone) == sorted(tuple(str(r[c]) for c in cols) for r in both if r.combo_id == k)
