"""The streamed scan against the batch indicators and signal rules on the same bars."""

import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import walk
from test_streaming import stream_of
from tickloom.operators import signals as G
from tickloom.operators.indicators import Needs, home_rows, indicator_frame
from tickloom.sources import bars as B
from tickloom.streaming import jobs as J, scan

DELAY = 60


@pytest.fixture(scope="module")
def source(spark):
    """Two years of bars of three symbols with holes, and what the batch rules say about each bar, flat and open."""
    src = pd.concat([walk(800, s, f"S{s}") for s in range(3)]).sample(frac=0.6, random_state=4)
    bars = B.index_bars(spark.createDataFrame(src))
    f = home_rows(indicator_frame(bars, Needs(sma={5, 200}, rsi={2}).lag("high"))).withColumn("prev_high", F.col("high_lag1")).filter("sma_200 IS NOT NULL")
    f = f.withColumn("ibs", F.coalesce("ibs", F.lit(0.5)))
    flat, held, no = F.lit("none"), F.lit("open"), F.lit(False)
    rules = {"rsi2": lambda s: G.rsi_signal(s, no), "ibs": lambda s: G.ibs_signal(s, no), "tom": lambda s: G.tom_signal(s, no, F.col("date"))}
    cols = [r(s).alias(f"{name}_{k}") for name, r in rules.items() for k, s in (("flat", flat), ("held", held))]
    batch = f.select("symbol", "date", "close", "dom", *cols).toPandas().sort_values(["symbol", "date"])
    stream = bars.select("symbol", "date", "high", "low", "close", "days_left").toPandas()
    return stream, batch


def loop(batch, top, every, max_age):
    """The scans in order, with the batch signal of the latest bar."""
    out = []
    for symbol, g in batch.groupby("symbol"):
        rows = list(g.itertuples())
        scans = [(r.date, r) for r in rows]
        if every:
            days = [rows[0].date + datetime.timedelta(days=k) for k in range((top - rows[0].date).days + 1)]
            scans = [(d, [r for r in rows if r.date <= d][-1]) for d in days if (d - datetime.date(1970, 1, 1)).days % every == 0]
        for s in scan.STRATEGIES:
            since = None
            for day, r in scans:
                if day > top:
                    break
                signal = getattr(r, f"{s}_{'flat' if since is None else 'held'}")
                if s == "tom" and since is not None:
                    signal = "SELL" if (since.year, since.month) != (r.date.year, r.date.month) and r.dom >= 3 else "HOLD"
                if signal == "BUY" and (day - r.date).days > max_age:
                    out.append((s, symbol, r.date, day, "SKIP", None))
                elif signal == "BUY":
                    since = r.date
                    out.append((s, symbol, r.date, day, "BUY", since))
                elif signal in ("SELL", "SAFETY_EXIT"):
                    out.append((s, symbol, r.date, day, signal, since))
                    since = None
    return sorted(out, key=repr)


@pytest.mark.parametrize("every, max_age, parts", [(None, 2, 1), (None, 2, 40), (3, 2, 1), (3, 0, 40)])
def test_stream_says_what_the_batch_says(spark, tmp_path, source, every, max_age, parts):
    stream, batch = source
    top = stream.date.max() - datetime.timedelta(days=DELAY)
    want = loop(batch, top, every, max_age)
    kinds = {(x[0], x[4]) for x in want}
    assert {("rsi2", "BUY"), ("ibs", "BUY"), ("tom", "SELL"), ("rsi2", "SELL")} <= kinds and (every is None or any(x[4] == "SKIP" for x in want))
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, J.STATE_PROVIDER)
    try:
        bars = stream_of(spark, stream, tmp_path / "files", parts, parts)
        got = J.run_to_table(scan.scan_signals(bars, every=every, max_age=max_age, delay=f"{DELAY} days"), "scan").collect()
    finally:
        spark.conf.unset(key)
    assert sorted(((r.strategy, r.symbol, r.date, r.scan_date, r.signal, r.entry_date) for r in got), key=repr) == want
