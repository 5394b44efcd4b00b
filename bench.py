"""Headline timings; prints one JSON line.

The workload is the one the baseline log describes: every symbol x the 48-combination grid,
from bars to verdict, with a warm session and the bars table stored. Symbols are nations (25),
and suppliers (1,000 at sf0.1) for the throughput figure. Each query is run once to warm up
and then timed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tickloom.operators import metrics as M, walkforward as W  # noqa: E402
from tickloom.operators.ledger import Account, ledger  # noqa: E402
from tickloom.operators.rules import IBS, RSI2, TOM  # noqa: E402
from tickloom.operators.validation import Periods, validate  # noqa: E402
from tickloom.plans.base import Tables  # noqa: E402
from tickloom.plans.registry import QUERIES  # noqa: E402
from tickloom.session import build_session  # noqa: E402
from tickloom.sources import bars as B  # noqa: E402


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session("bench", f"local[{cpus}]", cores=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    t = Tables(spark, sf_dir)
    account, strict = Account(), Account(capital=10_000.0, fees="us_stocks_usd_account", whole_shares=True)
    rsi = RSI2.combos(sma_trend_buffer=1.0)
    per = Periods("1998-01-01", "2000-01-01")
    grid = {"ibs_entry_threshold": [0.1, 0.15, 0.2, 0.25], "ibs_exit_threshold": [0.7, 0.8, 0.9], "sma_trend_period": [50, 100]}
    bars, many = t.bars("nation"), t.bars("supplier")
    work = {
        "bars_from_ticks": lambda: B.ohlcv(B.lineitem_ticks(spark, sf_dir, "nation"), ["symbol"], "date"),
        "rsi_grid_48": lambda: M.trade_metrics(ledger(bars, RSI2, rsi, account), ["symbol", "combo_id"]),
        "rsi_grid_48_by_supplier": lambda: M.trade_metrics(ledger(many, RSI2, rsi, account), ["symbol", "combo_id"]),
        "ibs_grid_36": lambda: M.trade_metrics(ledger(bars, IBS, IBS.combos(), account), ["symbol", "combo_id"]),
        "rsi_validation": lambda: validate(bars, RSI2, account, per, RSI2.params(sma_trend_buffer=1.0)),
        "ibs_whole_shares": lambda: M.trade_metrics(ledger(bars, IBS, account=strict), ["symbol"]),
        "tom_grid_12": lambda: M.trade_metrics(ledger(bars, TOM, TOM.combos(), account), ["symbol", "combo_id"]),
        "walk_forward_24": lambda: W.search(W.segment_metrics(W.segments(bars), IBS, IBS.combos(grid), account), IBS.combos(grid), grid).best,
        "AGG14": lambda: QUERIES["AGG14"](spark, sf_dir),
        "IND6": lambda: QUERIES["IND6"](spark, sf_dir),
        "LED15": lambda: QUERIES["LED15"](spark, sf_dir),
        "SIG1": lambda: QUERIES["SIG1"](spark, sf_dir),
        "STA1": lambda: QUERIES["STA1"](spark, sf_dir),
        "DQ1": lambda: QUERIES["DQ1"](spark, sf_dir),
    }
    only = sys.argv[1:]
    times = {}
    for name, make in work.items():
        if only and name not in only:
            continue
        drain(make())
        start = time.perf_counter()
        drain(make())
        times[name] = round(time.perf_counter() - start, 3)
    n_symbols = many.select("symbol").distinct().count()
    grid_s = times.get("rsi_grid_48_by_supplier")
    print(json.dumps({
        "metric": "total seconds over headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")), "backtests_per_second": round(n_symbols * len(rsi) / grid_s, 1) if grid_s else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
