"""Robustness over a grid, stability over sub-periods, significance, and the verdict."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalars as S
from ..session import materialise
from . import metrics as M
from .indicators import home_rows
from .ledger import Account, frame_for, ledger
from .rules import RuleSpec


@dataclass(frozen=True)
class Periods:
    """Out-of-sample start, the split between its halves, and the end, as dates."""

    start: str
    mid: str
    end: str = "9999-12-31"

    def within(self, lo: str, hi: str) -> tuple[Column, Column]:
        d = F.col("date")
        return d >= F.lit(lo).cast("date"), d < F.lit(hi).cast("date")


def usable_symbols(bars: DataFrame, start: Column, warmup: int, min_bars: int = 50) -> DataFrame:
    """Symbols with enough bars after the start, which is raised to the warm-up."""
    first = F.min(F.when(start, F.col("bar_ix")))
    g = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bars"), first.alias("_f"))
    g = g.withColumn("start_ix", F.greatest(F.coalesce("_f", "n_bars"), F.lit(warmup)))
    return g.filter(F.col("n_bars") - F.col("start_ix") >= min_bars).select("symbol", "n_bars", "start_ix")


def grid_metrics(bars: DataFrame, rule: RuleSpec, combos: Sequence[dict], account: Account, start: Column, end: Column, symbols: DataFrame) -> DataFrame:
    """Metrics per (symbol, combination); combinations that start before their warm-up are left out."""
    warm = F.array(*[F.lit(rule.warmup(p)) for p in combos])
    m = M.trade_metrics(ledger(bars, rule, combos, account, start=start, end=end), ["symbol", "combo_id"], account.capital)
    return m.join(symbols, "symbol").filter(F.col("start_ix") >= warm[F.col("combo_id")]).drop("n_bars", "start_ix")


def halves(bars: DataFrame, rule: RuleSpec, params: dict, account: Account, periods: Periods) -> DataFrame:
    """Profit factor and Sharpe in both halves; each half starts from a fresh account."""
    frame = period_frame(frame_for(bars, rule, [params]), periods, rule.warmup(params)).filter("period <> 'oos'")
    trades = ledger(frame, rule, [params], account, keys=["symbol", "period"], frame=frame)
    return side_by_side(M.trade_metrics(trades, ["symbol", "period"], account.capital))


def side_by_side(m: DataFrame) -> DataFrame:
    """Half metrics in columns; stable when both halves earn."""
    pick = lambda h, c: F.coalesce(F.max(F.when(F.col("period") == h, F.col(c))), F.lit(0))
    wide = [pick(h, c).alias(f"{n}_{h}") for h in "ab" for c, n in (("n_trades", "n_trades"), ("profit_factor", "pf"), ("sharpe", "sharpe"))]
    return m.groupBy("symbol").agg(*wide).withColumn("stable", (F.col("pf_a") > 1) & (F.col("pf_b") > 1))


def period_frame(frame: DataFrame, periods: Periods, warmup: int = 0) -> DataFrame:
    """Indicator rows once per period they belong to: ``oos``, and its halves ``a`` and ``b``.

    Indicators keep their full history; a period only decides which bars a rule may see. The halves meet at
    ``periods.mid``; where that is not inside a symbol's own range, in the middle of its bars.
    """
    lo, hi = periods.within(periods.start, periods.end)
    rows = home_rows(frame).filter(lo & hi)
    later = F.min(F.when(F.col("date") >= F.lit(periods.mid).cast("date"), F.col("bar_ix")))
    edge = rows.groupBy("symbol").agg(F.greatest(F.min("bar_ix"), F.lit(warmup)).alias("_a"), (F.max("bar_ix") + 1).alias("_e"), later.alias("_m"))
    mid = F.when((F.col("_m") > F.col("_a")) & (F.col("_m") < F.col("_e")), F.col("_m")).otherwise(F.col("_a") + F.floor((F.col("_e") - F.col("_a")) / 2))
    half = F.when(F.col("bar_ix") < F.col("_mid"), F.lit("a")).otherwise(F.lit("b"))
    return rows.join(edge.select("symbol", mid.alias("_mid")), "symbol").withColumn("period", F.explode(F.array(F.lit("oos"), half))).drop("_mid")


def validate(bars: DataFrame, rule: RuleSpec, account: Account, periods: Periods, params: dict | None = None,
             grid: dict | None = None, alpha: float = 0.10, min_pct: float = 80.0, pooled: str | None = None) -> DataFrame:
    """All four tests per symbol and the verdict, from one pass over the bars.

    The default set and the grid run side by side (combination 0 and the rest) over the
    period and its halves; the ledger is stored once and every test is an aggregate of it. ``pooled`` names one
    more row with the t-test over the trades of all symbols.
    """
    params = rule.params() if params is None else params
    combos = rule.combos(grid, **{k: v for k, v in params.items() if k not in (grid or rule.grid)})
    every = [params, *combos]
    keys = ["symbol", "period"]
    frame = period_frame(frame_for(bars, rule, every), periods, rule.warmup(params))
    keep = (F.col("combo_id") == 0) | (F.col("period") == "oos")
    trades = materialise(ledger(frame, rule, every, account, keys=keys, frame=frame, only=keep), "validation-trades")
    start, _ = periods.within(periods.start, periods.end)
    symbols = usable_symbols(bars, start, rule.warmup(params))
    m = M.trade_metrics(trades, [*keys, "combo_id"], account.capital)
    base = m.filter("period = 'oos' AND combo_id = 0").drop("period", "combo_id")
    warm = F.array(*[F.lit(rule.warmup(p)) for p in combos])
    runs = m.filter("period = 'oos' AND combo_id > 0").withColumn("combo_id", F.col("combo_id") - 1)
    runs = runs.join(symbols, "symbol").filter(F.col("start_ix") >= warm[F.col("combo_id")])
    rob = M.robustness(runs, len(combos), symbols, min_pct=min_pct)
    sub = side_by_side(m.filter("period <> 'oos' AND combo_id = 0"))
    tt = M.t_test(trades.filter("period = 'oos' AND combo_id = 0"), ["symbol"], alpha).select("symbol", "t_stat", "p_value", "significant", "label")
    out = symbols.select("symbol").join(base, "symbol", "left").join(rob, "symbol").join(sub, "symbol", "left").join(tt, "symbol", "left")
    out = out.fillna(0, ["n_trades", "win_rate", "profit_factor", "sharpe", "net_return_pct", "pf_a", "pf_b"])
    out = out.fillna(False, ["stable", "significant"]).fillna(1.0, ["p_value"])
    out = out.withColumn("verdict", S.verdict(F.col("robust"), F.col("stable"), F.col("significant")))
    if pooled is None:
        return out
    every_one = trades.filter("period = 'oos' AND combo_id = 0").join(symbols.select("symbol"), "symbol", "left_semi").withColumn("symbol", F.lit(pooled))
    return out.unionByName(M.t_test(every_one, ["symbol"], alpha).select("symbol", "n_trades", "t_stat", "p_value", "significant", "label"), allowMissingColumns=True)
