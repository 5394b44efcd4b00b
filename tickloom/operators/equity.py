"""Trades against bars: excursions, re-pricing, equity curves and drawdowns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scalars as S
from .blocks import bar_blocks, between
from .indicators import home_rows
from .spans import SPAN, span_order, spread

def adverse_excursion(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """Lowest low between entry and exit, both included, relative to the entry price.

    A trade reads the blocks of its entry and exit and two rows of a sparse table, not the bars it spans.
    """
    found = between(trades, bar_blocks(bars))
    return found.withColumn("mae_pct", F.col("low") / F.col("entry_price") - 1).select(*trades.columns, "mae_pct")


def bar_lookup(bars: DataFrame, ix: str, **cols: str) -> DataFrame:
    """(symbol, ix) lookup table with renamed bar columns."""
    return bars.select("symbol", F.col("bar_ix").alias(ix), *[F.col(c).alias(n) for n, c in cols.items()])


def trade_dates(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """Dates of signal, entry and exit bar and the open after the exit.

    Neighbour values come from one window over the bars, so two lookups do for four.
    """
    w = span_order(["symbol"])
    f = home_rows(spread(bars, before=1, after=1).withColumns({"_prev": F.lag("date").over(w), "_next": F.lead("open").over(w)}))
    t = trades.drop("entry_date", "exit_date")
    t = t.join(bar_lookup(f, "entry_ix", signal_date="_prev", entry_date="date"), ["symbol", "entry_ix"])
    return t.join(bar_lookup(f, "exit_ix", exit_date="date", next_open="_next"), ["symbol", "exit_ix"], "left")


def reprice_at_next_open(trades: DataFrame, bars: DataFrame, fees: str) -> DataFrame:
    """P&L if every close exit were filled at the next open, one more day held."""
    w = span_order(["symbol"])
    nxt = home_rows(spread(bars, after=1).withColumn("_next", F.lead("open").over(w)))
    t = trades.join(bar_lookup(nxt, "exit_ix", next_open="_next"), ["symbol", "exit_ix"], "left")
    pnl = S.net_pnl(F.col("direction"), F.col("entry_price"), F.col("next_open"), F.col("quantity"), F.col("holding_days") + 1, S.fee_literals(fees))
    return t.withColumn("new_pnl", F.coalesce(pnl, F.col("pnl")))


_STEPS = {"sum": (F.sum, lambda a, b: a + F.coalesce(b, F.lit(0.0))), "max": (F.max, F.greatest), "min": (F.min, F.least)}


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], part: Column, values: dict[str, tuple[str, str]]) -> DataFrame:
    """Running sums, maxima and minima per key in two steps.

    First inside a part (a span of bars, a month of dates), then with the totals of the parts
    before it. Only one row per part is ever ordered over the whole key.
    """
    p = df.withColumn("_p", part)
    inside = Window.partitionBy(*keys, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    local = p.withColumns({f"_l_{o}": _STEPS[k][0](v).over(inside) for o, (k, v) in values.items()})
    totals = p.groupBy(*keys, "_p").agg(*[_STEPS[k][0](v).alias(f"_t_{o}") for o, (k, v) in values.items()])
    totals = totals.select(*keys, "_p", *[_STEPS[k][0](f"_t_{o}").over(before).alias(f"_c_{o}") for o, (k, v) in values.items()])
    out = local.join(totals, [*keys, "_p"]).withColumns(
        {o: _STEPS[k][1](F.col(f"_l_{o}"), F.col(f"_c_{o}")) for o, (k, v) in values.items()})
    return out.drop("_p", *[f"_{x}_{o}" for o in values for x in "lc"])


def daily_equity(trades: DataFrame, bars: DataFrame, capital: float) -> DataFrame:
    """Realised capital carried forward plus the open trade at market, on every bar.

    A trade adds its entry to the running quantity and cost and takes both out at the exit;
    equity is then a running total over bar changes instead of a join of days and trades.
    """
    cost = F.col("entry_price") * F.col("quantity")
    opened = trades.select("symbol", F.col("entry_ix").alias("bar_ix"), F.col("quantity").alias("_q"), cost.alias("_cost"), F.lit(0.0).alias("_pnl"))
    shut = trades.filter("closed").select("symbol", F.col("exit_ix").alias("bar_ix"), (-F.col("quantity")).alias("_q"), (-cost).alias("_cost"), F.col("pnl").alias("_pnl"))
    moves = opened.unionByName(shut).groupBy("symbol", "bar_ix").agg(*[F.sum(c).alias(c) for c in ("_q", "_cost", "_pnl")])
    b = bars.join(moves, ["symbol", "bar_ix"], "left").fillna(0.0, ["_q", "_cost", "_pnl"])
    part = F.floor(F.col("bar_ix") / F.lit(SPAN))
    run = running(b, ["symbol"], ["bar_ix"], part, {"_held": ("sum", "_q"), "_paid": ("sum", "_cost"), "_made": ("sum", "_pnl")})
    return run.withColumn("equity", F.lit(capital) + F.col("_made") + F.col("_held") * F.col("close") - F.col("_paid")).drop("_q", "_cost", "_pnl", "_held", "_paid", "_made")


def buy_and_hold(bars: DataFrame, capital: float) -> DataFrame:
    first = bars.groupBy("symbol").agg(F.min_by("close", "date").alias("_first"))
    return bars.join(first, "symbol").withColumn("equity", F.col("close") / F.col("_first") * capital).drop("_first")


def trade_curve(trades: DataFrame, capital: float, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Equity after each closed trade with its drawdown from the peak, in percent.

    Sum and peak are taken inside a span of bars; the capital and peak a span starts from
    come from one row per span.
    """
    keys = list(keys)
    t = trades.withColumn("_p", F.floor(F.col("exit_ix") / F.lit(SPAN)))
    upto = Window.partitionBy(*keys, "_p").orderBy("exit_ix").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    local = t.withColumn("_rel", F.sum("pnl").over(upto)).withColumn("_top", F.max("_rel").over(upto))
    parts = local.groupBy(*keys, "_p").agg(F.sum("pnl").alias("_all"), F.max("_rel").alias("_high"))
    parts = parts.withColumn("_start", F.lit(capital) + F.coalesce(F.sum("_all").over(before), F.lit(0.0)))
    parts = parts.withColumn("_peak", F.max(F.col("_start") + F.col("_high")).over(before)).select(*keys, "_p", "_start", "_peak")
    out = local.join(parts, [*keys, "_p"]).withColumn("equity", F.col("_start") + F.col("_rel"))
    peak = F.greatest(F.lit(capital), F.col("_peak"), F.col("_start") + F.col("_top"))
    return out.withColumn("drawdown_pct", (F.col("equity") - peak) / peak * 100).drop("_p", "_rel", "_top", "_start", "_peak")


def max_drawdown(equity: DataFrame, keys: Sequence[str], order: str, part: Column, value: str = "equity") -> DataFrame:
    """Largest fall from a running peak, in percent of the peak."""
    run = running(equity, list(keys), [order], part, {"_top": ("max", value)})
    fall = F.when(F.col("_top") > 0, (F.col("_top") - F.col(value)) / F.col("_top")).otherwise(F.lit(0.0))
    return run.groupBy(*keys).agg((F.max(fall) * 100).alias("max_drawdown_pct"))


def portfolio_equity(equity: DataFrame) -> DataFrame:
    """Sum of all symbols' equity on every date, gaps filled forward and leading gaps backward.

    With every symbol worth its first value until it starts, the total is the sum of first
    values (booked before all dates) plus a running sum of daily changes, so no
    date-by-symbol grid is built.
    """
    w = span_order(["symbol"])
    steps = home_rows(spread(equity, before=1).withColumn("_d", F.col("equity") - F.lag("equity").over(w)))
    origin = F.lit("0001-01-01").cast("date")
    opening = equity.groupBy("symbol").agg(F.min_by("equity", "bar_ix").alias("_d")).select(origin.alias("date"), "_d")
    moves = steps.select("date", F.coalesce("_d", F.lit(0.0)).alias("_d")).unionByName(opening)
    days = moves.groupBy("date").agg(F.sum("_d").alias("_d"))
    run = running(days, [], ["date"], F.trunc("date", "MM"), {"equity": ("sum", "_d")})
    return run.filter(F.col("date") > origin).select("date", "equity")


def fill(df: DataFrame, col: str, keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("bar_ix",), part: Column | None = None,
         backward: bool = True) -> DataFrame:
    """Last known value up to each row; optionally the first one ahead where nothing came before."""
    keys, order = list(keys), list(order)
    d = df.withColumn("_part", part if part is not None else F.floor(F.col(order[0]) / F.lit(SPAN)))
    up = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = d.withColumn("_l", F.last(col, ignorenulls=True).over(up))
    at = F.when(F.col(col).isNotNull(), F.struct(*order))
    ends = d.groupBy(*keys, "_part").agg(F.max_by(col, at).alias("_e"), F.min_by(col, at).alias("_s"))
    past = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(*keys, "_part", F.last("_e", ignorenulls=True).over(past).alias("_p"), F.first("_s", ignorenulls=True).over(whole).alias("_n"))
    out = local.join(ends, [*keys, "_part"])
    picks = ["_l", "_p", "_n"] if backward else ["_l", "_p"]
    return out.withColumn(f"{col}_filled", F.coalesce(*picks)).drop("_l", "_p", "_n", "_part")
