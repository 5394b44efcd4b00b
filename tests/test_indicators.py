import numpy as np
import pandas as pd
import pytest

from conftest import walk
from tickloom.operators.indicators import Needs, home_rows, indicator_frame
from tickloom.sources.bars import index_bars


def slow_ema(x, p):
    out = [None] * len(x)
    out[p - 1] = sum(x[:p]) / p
    for i in range(p, len(x)):
        out[i] = out[i - 1] + (x[i] - out[i - 1]) * 2 / (p + 1)
    return out


def slow_wilder(x, p, first):
    out = [None] * len(x)
    out[first + p - 1] = sum(x[first : first + p]) / p
    for i in range(first + p, len(x)):
        out[i] = (out[i - 1] * (p - 1) + x[i]) / p
    return out


@pytest.fixture(scope="module")
def series():
    flat = walk(900, 3, "FLAT")
    flat.loc[100:700, ["open", "high", "low", "close"]] = 100.0
    return pd.concat([walk(2600, 1, "AAA"), walk(30, 2, "BBB"), flat])


@pytest.fixture(scope="module")
def frame(spark, series):
    needs = Needs(sma={5, 200}, ema={9, 200}, rsi={2, 14}, atr={14}, adx={14}, high={20}, low={20})
    needs.lag("rsi_2").lag("sma_200").lag("close", 2)
    bars = index_bars(spark.createDataFrame(series))
    out = home_rows(indicator_frame(bars, needs)).toPandas()
    return out.sort_values(["symbol", "bar_ix"]).reset_index(drop=True)


def same(got, want):
    got = np.array([np.nan if v is None else v for v in got], dtype=float)
    want = np.array([np.nan if v is None else v for v in want], dtype=float)
    np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("symbol", ["AAA", "BBB", "FLAT"])
def test_against_plain_recurrences(frame, series, symbol):
    got = frame[frame.symbol == symbol]
    src = series[series.symbol == symbol].reset_index(drop=True)
    n, c, h, l = len(src), src.close.to_numpy(), src.high.to_numpy(), src.low.to_numpy()
    assert list(got.bar_ix) == list(range(n))
    same(got.sma_5, src.close.rolling(5).mean())
    same(got.sma_200, src.close.rolling(200).mean())
    same(got.high_20, src.high.rolling(20).max().shift(1))
    same(got.low_20, src.low.rolling(20).min().shift(1))
    same(got.ema_9, slow_ema(c, 9))
    if n >= 200:
        same(got.ema_200, slow_ema(c, 200))
    d = np.diff(c, prepend=c[0])
    for p in (2, 14):
        g, b = slow_wilder(np.maximum(d, 0), p, 1), slow_wilder(np.maximum(-d, 0), p, 1)
        want = [None if x is None else (100.0 if y == 0 else 100 - 100 / (1 + x / y)) for x, y in zip(g, b)]
        if symbol != "FLAT" or p != 2:
            same(got[f"rsi_{p}"], want)
    tr = np.maximum(h - l, np.maximum(abs(h - np.roll(c, 1)), abs(l - np.roll(c, 1))))
    tr[0] = h[0] - l[0]
    same(got.atr_14, slow_wilder(tr, 14, 1))
    up, dn = np.diff(h, prepend=h[0]), -np.diff(l, prepend=l[0])
    ups, dns = np.where((up > dn) & (up > 0), up, 0), np.where((dn > up) & (dn > 0), dn, 0)
    st, su, sd = (slow_wilder(x, 14, 1) for x in (tr, ups, dns))
    dx = []
    for t, u, v in zip(st, su, sd):
        if t is None:
            dx.append(0.0)
            continue
        a, b = (100 * u / t, 100 * v / t) if t > 0 else (0.0, 0.0)
        dx.append(abs(a - b) / (a + b) * 100 if a + b > 0 else 0.0)
    same(got.adx_14, slow_wilder(dx, 14, 14))
    same(got.rsi_2_lag1, got.rsi_2.shift(1))
    same(got.sma_200_lag1, got.sma_200.shift(1))
    same(got.close_lag2, got.close.shift(2))


def test_long_flat_stretch_keeps_the_decayed_ratio(frame):
    """600 unchanged closes: both averages only decay, so their ratio must not move."""
    f = frame[frame.symbol == "FLAT"].reset_index(drop=True)
    assert f.rsi_2[110:690].nunique() >= 1
    assert abs(f.rsi_2[120] - f.rsi_2[600]) < 1e-6
    assert f.ibs[200:300].isna().all()
