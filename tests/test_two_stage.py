"""The search that runs only what its stages look at, against the same search over all results."""

import pandas as pd
import pytest

from conftest import walk
from tickloom.operators import walkforward as W
from tickloom.operators.ledger import Account, candidates, frame_for
from tickloom.operators.rules import IBS
from tickloom.sources.bars import index_bars

GRID = {"ibs_entry_threshold": [0.1, 0.2, 0.3, 0.4], "ibs_exit_threshold": [0.6, 0.7, 0.8], "sma_trend_period": [20, 40]}
COARSE, TOP = 5, 2


@pytest.fixture(scope="module")
def seg(spark):
    rows = pd.concat([walk(900, s, f"S{s}") for s in range(2)] + [walk(60, 9, "SHORT")])
    return W.segments(index_bars(spark.createDataFrame(rows)), W.Plan(300, 1, 150, 150)).cache()


def rows_of(df):
    return sorted(str([round(x, 9) if isinstance(x, float) else x for x in r]) for r in df.select(sorted(df.columns)).collect())


def test_same_search(seg):
    combos, account = IBS.combos(GRID), Account(fees="forex_saxo")
    whole = W.segment_metrics(seg, IBS, combos, account)
    some = W.two_stage_metrics(seg, IBS, combos, GRID, account, COARSE, TOP)
    assert 0 < some.count() < whole.count()
    a, b = (W.search(m, combos, GRID, COARSE, TOP) for m in (whole, some))
    for x, y in ((a.ranked, b.ranked), (a.evaluated, b.evaluated), (a.best, b.best), (a.joined, b.joined)):
        assert rows_of(x) == rows_of(y)
    assert rows_of(W.combo_table(a)) == rows_of(W.combo_table(b))


def test_candidates_fall_with_the_share(spark, seg):
    combos, keys = IBS.combos(GRID), W.SEGMENT
    frame = frame_for(seg, IBS, combos, keys)
    every = candidates(frame, IBS, combos, keys)
    ids = W.coarse_ids(len(combos), COARSE)
    wanted = seg.where("symbol = 'S0'").select(*keys).distinct().crossJoin(spark.createDataFrame([(i,) for i in ids], "combo_id int"))
    got = candidates(frame, IBS, combos, keys, wanted=wanted)
    want = every.where("symbol = 'S0'").where(every.combo_id.isin(ids))
    cols = [*keys, "combo_id", "entry_ix", "exit.bar_ix"]
    assert rows_of(got.select(cols)) == rows_of(want.select(cols)) and got.count() < every.count() / 2
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("inline") < plan.index("Join")  # the join lies under the step that generates
