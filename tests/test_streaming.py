import datetime
import os
import random

import pandas as pd

from conftest import walk
from tickloom.streaming import jobs as J


def loop(rows, entry=0.2, exit_=0.8):
    since, out = None, []
    for r in rows.itertuples():
        if r.high <= r.low:
            continue
        w = (r.close - r.low) / (r.high - r.low)
        if since is None and w < entry:
            since = r.date
            out.append((r.symbol, r.date, "BUY", r.date))
        elif since is not None and w > exit_:
            out.append((r.symbol, r.date, "SELL", since))
            since = None
    return out


def stream_of(spark, src, folder, parts, seed):
    """Rows dealt over files at random within stretches of 40 days; one to three files per batch."""
    folder.mkdir()
    days = sorted(src.date.unique())
    stretches, per = -(-len(days) // 40), max(1, parts // -(-len(days) // 40))
    rng, k = random.Random(seed), 0
    for s in range(stretches if parts > 1 else 1):
        part = src[src.date.isin(days[s * 40 : (s + 1) * 40])] if parts > 1 else src
        home = [rng.randrange(per) for _ in range(len(part))]
        for f in range(per):
            rows = part[[h == f for h in home]].sample(frac=1, random_state=seed + f)
            rows.to_parquet(folder / f"part{k}.parquet")
            os.utime(folder / f"part{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
            k += 1
    return J.bar_stream(spark, str(folder), spark.createDataFrame(src).schema, 3 if parts > 10 else 1)


def test_signals_and_gaps_do_not_depend_on_files(spark, tmp_path):
    """The same rows in one, a few and 70 shuffled files: equal signals, equal to a plain loop up to the watermark."""
    src = pd.concat([walk(200, s, f"S{s}") for s in range(2)])[["symbol", "date", "high", "low", "close"]]
    src = src.sample(frac=0.9, random_state=3)
    top = src.date.max() - datetime.timedelta(days=60)
    ordered = src.sort_values(["symbol", "date"])
    want = sorted(x for _, g in ordered.groupby("symbol") for x in loop(g) if x[1] <= top)
    gaps = []
    for name, g in ordered.groupby("symbol"):
        days = list(g.date)
        for a, b in zip(days, days[1:] + [None]):
            if (b is None or b > a + datetime.timedelta(days=2)) and a + datetime.timedelta(days=2) <= top:
                gaps.append((name, a))
    assert len(want) > 10 and len(gaps) > 10
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", J.STATE_PROVIDER)
    try:
        for parts in (1, 3, 70):
            bars = lambda k: stream_of(spark, src, tmp_path / f"{parts}-{k}", parts, parts)
            got = J.run_to_table(J.position_signals(bars(0), delay="60 days"), "positions").toPandas()
            assert sorted((r.symbol, r.date, r.signal, r.entry_date) for r in got.itertuples()) == want
            got = J.run_to_table(J.stale_symbols(bars(1), delay="60 days"), "stale").toPandas()
            assert sorted((r.symbol, r.last_date) for r in got.itertuples()) == sorted(gaps)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_replayed_batches_do_not_double(spark, tmp_path):
    day = walk(20, 1)[["symbol", "date", "close"]]
    for i in range(2):
        day.assign(close=day.close + i).to_parquet(tmp_path / f"p{i}.parquet")
    schema = spark.createDataFrame(day).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    got = J.upsert_bars(stream, "replay")
    assert got.count() == 20 and got.select("date").distinct().count() == 20


def test_sessions_merge_and_late_rows_are_dropped(spark, tmp_path):
    """Rows of later files close gaps inside the delay; a row before the watermark is not counted."""
    at = lambda minute: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)
    files = [[(1, 0), (2, 50), (3, 200)], [(4, 25), (5, 210)], [(6, 600)], [(7, 20), (8, 610)], [(9, 2000)]]
    for k, rows in enumerate(files):
        pd.DataFrame([(e, "a", at(m), 1.0 * e) for e, m in rows], columns=["event_id", "event_type", "ts", "value"]).to_parquet(tmp_path / f"p{k}.parquet", coerce_timestamps="us", index=False)
        os.utime(tmp_path / f"p{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    schema = "event_id long, event_type string, ts timestamp, value double"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    got = J.run_to_table(J.activity_sessions(stream, "30 minutes", "3 hours"), "sessions").toPandas()
    want = [(at(0), at(80), 3, 1.0, 4.0), (at(200), at(240), 2, 3.0, 5.0), (at(600), at(640), 2, 6.0, 8.0)]
    assert sorted(map(tuple, got[["start", "end", "n_events", "low", "high"]].values.tolist())) == want
