"""Aggregates over trades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalars as S


def gross_profit(pnl: Column) -> Column:
    return F.coalesce(F.sum(F.when(pnl > 0, pnl)), F.lit(0.0))


def gross_loss(pnl: Column) -> Column:
    return F.abs(F.coalesce(F.sum(F.when(pnl <= 0, pnl)), F.lit(0.0)))


def ratio_or_inf(profit: Column, loss: Column) -> Column:
    none = F.when(profit > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))
    return F.when(loss == 0, none).otherwise(F.try_divide(profit, loss))


def profit_factor(pnl: Column) -> Column:
    """Wins over losses; infinite without losses, 0 with neither."""
    return ratio_or_inf(gross_profit(pnl), gross_loss(pnl))


def win_rate(pnl: Column) -> Column:
    n = F.count(pnl)
    return F.when(n > 0, F.count_if(pnl > 0) / n).otherwise(F.lit(0.0))


def sharpe(ret: Column, entry_ix: Column, exit_ix: Column) -> Column:
    """Per-trade Sharpe times the root of trades per year (span of the trades in bars)."""
    n, sd = F.count(ret), F.stddev_pop(ret)
    span = F.greatest(F.max(exit_ix) - F.min(entry_ix), F.lit(1))
    value = F.try_divide(F.avg(ret), sd) * F.sqrt(n / (span / F.lit(252.0)))
    return F.when((n >= 2) & (sd > 0), value).otherwise(F.lit(0.0))


def plain_sharpe(ret: Column) -> Column:
    """Mean over population deviation, capped at 100, not annualised."""
    sd = F.stddev_pop(ret)
    return F.when((F.count(ret) >= 2) & (sd >= 1e-10), F.least(F.lit(100.0), F.try_divide(F.avg(ret), sd))).otherwise(F.lit(0.0))


def calendar_sharpe(ret: Column, total_days: Column) -> Column:
    """Older variant: trades per year from calendar length, at least 3 trades, cap 100."""
    n, sd = F.count(ret), F.stddev_pop(ret)
    value = F.try_divide(F.avg(ret), sd) * F.sqrt(n / F.greatest(total_days, F.lit(1.0)) * 365)
    return F.when((n >= 3) & (sd > 1e-10), F.least(F.lit(100.0), value)).otherwise(F.lit(0.0))


def only_closed(c: str) -> Column:
    return F.when(F.col("closed"), F.col(c))


def trade_metrics(trades: DataFrame, keys: Sequence[str], capital: float = 100_000.0) -> DataFrame:
    """Core figures of a ledger; open trades count in the return only."""
    pnl, ret = only_closed("pnl"), only_closed("return_pct")
    total = F.coalesce(F.sum("pnl"), F.lit(0.0))
    return trades.groupBy(*keys).agg(
        F.count(pnl).alias("n_trades"),
        win_rate(pnl).alias("win_rate"),
        profit_factor(pnl).alias("profit_factor"),
        sharpe(ret, only_closed("entry_ix"), only_closed("exit_ix")).alias("sharpe"),
        (total / F.lit(capital) * 100).alias("net_return_pct"),
        (total + F.lit(capital)).alias("final_capital"),
    )


def mean_stats(trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Average win, loss, holding time, P&L and size, and the skipped entries."""
    pnl, ret = only_closed("pnl"), only_closed("return_pct")
    return trades.groupBy(*keys).agg(
        F.count(pnl).alias("n_trades"),
        F.count_if(F.col("status") == "skipped").alias("n_skipped"),
        F.coalesce(F.avg(F.when(pnl > 0, ret)), F.lit(0.0)).alias("avg_win"),
        F.coalesce(F.avg(F.when(pnl <= 0, ret)), F.lit(0.0)).alias("avg_loss"),
        F.coalesce(F.avg(only_closed("holding_days")), F.lit(0.0)).alias("avg_holding"),
        F.coalesce(F.avg(pnl), F.lit(0.0)).alias("avg_pnl"),
        F.coalesce(F.avg(F.when(F.col("closed"), F.col("entry_price") * F.col("quantity"))), F.lit(0.0)).alias("avg_size"),
    )


def t_test(trades: DataFrame, keys: Sequence[str], alpha: float = 0.10) -> DataFrame:
    """One-sided one-sample test of mean return > 0; fewer than 2 trades give p = 1."""
    ret = only_closed("return_pct")
    g = trades.groupBy(*keys).agg(F.count(ret).alias("n_trades"), F.avg(ret).alias("_m"), F.stddev_samp(ret).alias("_s"))
    n = F.col("n_trades")
    usable = (n >= 2) & (F.col("_s") > 0)
    t = F.when(usable, F.try_divide(F.col("_m"), F.col("_s") / F.sqrt(n))).otherwise(F.lit(0.0))
    g = g.withColumn("t_stat", t)
    p = F.when(F.col("t_stat") > 0, S.student_tail(F.col("t_stat"), n - 1)).otherwise(F.lit(1.0))
    g = g.withColumn("p_value", p).withColumn("mean_return_pct", F.coalesce(F.col("_m"), F.lit(0.0)) * 100)
    return g.withColumn("significant", F.col("p_value") < alpha).withColumn("label", S.significance_label(F.col("p_value"))).drop("_m", "_s")


def robustness(combo_metrics: DataFrame, n_combos: int, symbols: DataFrame, min_trades: int = 3, min_pct: float = 80.0,
               key: str = "symbol") -> DataFrame:
    """Spread of the profit factor over the whole grid; missing or thin combinations count as 0."""
    pf = F.when(F.col("n_trades") >= min_trades, F.col("profit_factor")).otherwise(F.lit(0.0))
    grid = symbols.select(key).withColumn("combo_id", F.explode(F.sequence(F.lit(0), F.lit(n_combos - 1))))
    full = grid.join(combo_metrics.select(key, "combo_id", pf.alias("_pf")), [key, "combo_id"], "left")
    v = F.coalesce(F.col("_pf"), F.lit(0.0))
    return full.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_combos"),
        F.count_if(v > 1).alias("n_profitable"),
        (F.count_if(v > 1) / F.count(F.lit(1)) * 100).alias("pct_profitable"),
        F.max(v).alias("best_pf"), F.min(v).alias("worst_pf"), F.percentile(v, F.lit(0.5)).alias("median_pf"),
    ).withColumn("robust", F.col("pct_profitable") >= min_pct)
