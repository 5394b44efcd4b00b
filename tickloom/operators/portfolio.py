"""Trades at a fixed allocation, and reports over a portfolio."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import scalars as S
from . import metrics as M
from .equity import max_drawdown


def isolated_baseline(trades: DataFrame, allocation: float, fees: str) -> DataFrame:
    """Each trade re-priced at a fixed allocation in an account of its own."""
    shares = F.floor(F.lit(allocation) / F.col("entry_price")).cast("double")
    t = trades.withColumn("shares", shares).filter("shares >= 1")
    pnl = S.net_pnl(F.col("direction"), F.col("entry_price"), F.col("exit_price"), F.col("shares"), F.col("holding_days"), S.fee_literals(fees))
    return t.withColumn("pnl", pnl)


def report(equity: DataFrame, trades: DataFrame, total_days: float) -> DataFrame:
    """Return, CAGR, drawdown and trade quality of a portfolio in one row."""
    days = equity.groupBy(F.lit(1).alias("_one")).agg(
        F.min_by("equity", "date").alias("_f"), F.max_by("equity", "date").alias("_l"), (F.date_diff(F.max("date"), F.min("date")) / 365.25).alias("_y"))
    dd = max_drawdown(equity.withColumn("_one", F.lit(1)), ["_one"], "date", F.trunc("date", "MM"))
    pnl, ret = F.col("pnl"), F.col("return_pct")
    q = trades.groupBy(F.lit(1).alias("_one")).agg(
        F.count(F.lit(1)).alias("n_trades"), M.win_rate(pnl).alias("win_rate"), M.profit_factor(pnl).alias("profit_factor"), M.calendar_sharpe(ret, F.lit(total_days)).alias("sharpe"))
    return days.join(dd, "_one").join(q, "_one").select(
        ((F.col("_l") / F.col("_f") - 1) * 100).alias("return_pct"), S.cagr(F.col("_f"), F.col("_l"), F.col("_y")).alias("cagr_pct"), "max_drawdown_pct",
        "n_trades", "win_rate", "profit_factor", "sharpe")


def beside_buy_and_hold(equity: DataFrame, held: DataFrame, trades: DataFrame, total_days: float) -> DataFrame:
    """The report of a portfolio with the symbols that earned, beside the equity of holding every symbol."""
    pnl = trades.groupBy("symbol").agg(F.sum("pnl").alias("_p")).agg(F.count(F.lit(1)).alias("n_symbols"), F.count_if(F.col("_p") > 0).alias("n_profitable_symbols"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    bh = report(held, trades, total_days).select(*[F.col(c).alias(f"hold_{c}") for c in ("return_pct", "cagr_pct", "max_drawdown_pct")])
    return one(report(equity, trades, total_days)).join(one(pnl), "_one").join(one(bh), "_one").drop("_one")


def leave_one_out(trades: DataFrame) -> DataFrame:
    """Trade quality without each symbol in turn, from per-symbol sums: total minus own."""
    pnl = F.col("pnl")
    g = trades.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count_if(pnl > 0).alias("w"), M.gross_profit(pnl).alias("gp"), M.gross_loss(pnl).alias("gl"))
    total = g.agg(*[F.sum(c).alias(f"t{c}") for c in ("n", "w", "gp", "gl")], F.lit(1).alias("_one"))
    j = g.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one")
    less = {c: F.col(f"t{c}") - F.col(c) for c in ("n", "w", "gp", "gl")}
    return j.select(F.col("symbol").alias("without"), less["n"].alias("n_trades"), (less["w"] / less["n"]).alias("win_rate"),
                    M.ratio_or_inf(less["gp"], less["gl"]).alias("profit_factor"), (less["gp"] - less["gl"]).alias("pnl"))
