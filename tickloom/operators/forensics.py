"""What a set of trades is made of: distribution, concentration, duration, time, trend, stops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scalars as S
from ..presets import STOP_LEVELS
from ..session import materialise
from . import metrics as M
from .ranks import percentiles

PERCENTS = (1, 5, 25, 50, 75, 95, 99)


def distribution(trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Moments and percentiles of trade returns in percent."""
    r = F.col("return_pct") * 100
    n, sd = F.count(r), F.stddev_pop(r)
    flat = (n < 3) | (sd == 0)
    g = trades.groupBy(*keys).agg(
        n.alias("n_trades"), F.avg(r).alias("mean"), sd.alias("std"), F.when(flat, 0.0).otherwise(F.skewness(r)).alias("skew"),
        F.when(flat, 0.0).otherwise(F.kurtosis(r)).alias("excess_kurtosis"), F.min(r).alias("min"), F.max(r).alias("max"),
        F.coalesce(F.avg(F.when(r > 0, r)), F.lit(0.0)).alias("avg_win"), F.coalesce(F.avg(F.when(r <= 0, r)), F.lit(0.0)).alias("avg_loss"),
    )
    q = percentiles(trades.withColumn("_r", r), keys, "_r", {f"p{p}": p / 100 for p in PERCENTS})
    ratio = F.when(F.col("avg_loss") != 0, F.abs(F.try_divide(F.col("avg_win"), F.col("avg_loss")))).otherwise(F.lit(float("inf")))
    return g.join(q, list(keys)).withColumn("wl_ratio", ratio)


def concentration(trades: DataFrame, keys: Sequence[str], tops: Sequence[int] = (5, 10, 20)) -> DataFrame:
    """Share of profit in the top N trades, and profit factor and win rate without them.

    Only the best ``max(tops)`` trades of a group are ranked (the limit is applied before the
    shuffle); what is left without them is the group's sums less theirs.
    """
    pnl = F.col("pnl")
    sums = {"n": F.count(pnl), "w": F.count_if(pnl > 0), "gp": M.gross_profit(pnl), "gl": M.gross_loss(pnl)}
    total = trades.groupBy(*keys).agg(F.sum(pnl).alias("total_pnl"), *[c.alias(f"_{k}") for k, c in sums.items()])
    w = Window.partitionBy(*keys).orderBy(pnl.desc(), F.col("entry_ix"))
    best = trades.select(*keys, "pnl", "entry_ix").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max(tops))
    aggs = []
    for t in tops:
        own = F.when(F.col("rank") <= t, pnl)
        aggs += [F.sum(own).alias(f"_s{t}"), F.count(own).alias(f"_n{t}"), F.count_if(own > 0).alias(f"_w{t}"), M.gross_profit(own).alias(f"_gp{t}"), M.gross_loss(own).alias(f"_gl{t}")]
    g = total.join(best.groupBy(*keys).agg(*aggs), list(keys))
    out = {}
    for t in tops:
        left = {k: F.col(f"_{k}") - F.col(f"_{k}{t}") for k in sums}
        more = F.col("_n") > t
        # nothing but rounding dust may remain of losses that are all gone
        gl = F.when(F.abs(left["gl"]) < 1e-9 * F.greatest(F.col("_gl"), F.lit(1.0)), 0.0).otherwise(left["gl"])
        out[f"top_{t}_pct"] = F.when(F.col("total_pnl") != 0, F.try_divide(F.col(f"_s{t}"), F.col("total_pnl")) * 100).otherwise(0.0)
        out[f"pf_without_{t}"] = F.when(more, M.ratio_or_inf(left["gp"], gl))
        out[f"wr_without_{t}"] = F.when(more, F.try_divide(left["w"], left["n"]))
    return g.select(*keys, "total_pnl", *[c.alias(k) for k, c in out.items()])


def duration_bucket(days: Column) -> Column:
    return (
        F.when(days == 1, "Short (1d)").when(days.between(2, 3), "Medium (2-3d)").when(days.between(4, 7), "Long (4-7d)")
        .when(days >= 8, "Very long (8+d)")
    )


def by_bucket(trades: DataFrame, keys: Sequence[str], bucket: Column) -> DataFrame:
    """Count, mean return, win rate and mean P&L per bucket."""
    b = trades.withColumn("bucket", bucket).filter("bucket IS NOT NULL")
    return b.groupBy(*keys, "bucket").agg(
        F.count(F.lit(1)).alias("n_trades"), (F.avg("return_pct") * 100).alias("mean_return"), M.win_rate(F.col("pnl")).alias("win_rate"),
        F.avg("pnl").alias("avg_pnl"), M.profit_factor(F.col("pnl")).alias("profit_factor"),
    )


def correlation(trades: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Pearson r with its two-sided p-value; NULL for fewer than three trades."""
    a, b = F.col(x).cast("double"), F.col(y)
    safe = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))  # NULL when one side is constant
    g = trades.groupBy(*keys).agg(safe.alias("r"), F.count(F.lit(1)).alias("n"))
    r, n = F.col("r"), F.col("n")
    t = F.abs(r) * F.sqrt(F.try_divide(n - 2, 1 - r * r))
    p = F.when((n > 2) & (F.abs(r) < 1), 2 * S.student_tail(t, F.greatest(n - 2, F.lit(1))))
    return g.withColumn("p_value", p).withColumn("r", F.when(n > 2, r))


def by_year(trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    pnl = F.col("pnl")
    return trades.groupBy(*keys, F.year("entry_date").alias("year")).agg(
        F.count(F.lit(1)).alias("n_trades"), M.win_rate(pnl).alias("win_rate"), M.profit_factor(pnl).alias("profit_factor"),
        (F.avg("return_pct") * 100).alias("avg_return"), F.sum(pnl).alias("total_pnl"),
    ).withColumn("years_below_1", F.count_if(F.col("profit_factor") < 1).over(Window.partitionBy(*keys)))


PROFILE = ("n_trades", "win_rate", "profit_factor", "mean_return", "median_return", "avg_win", "avg_loss", "wl_ratio", "skew", "excess_kurtosis", "top_10_pct", "avg_days")


def profile(trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The comparison figures of each group, one column per entry of ``PROFILE``."""
    pnl = F.col("pnl")
    d = distribution(trades, keys).withColumnsRenamed({"mean": "mean_return", "p50": "median_return"}).drop("n_trades")
    q = trades.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("n_trades"), M.win_rate(pnl).alias("win_rate"), M.profit_factor(pnl).alias("profit_factor"), F.avg("holding_days").alias("avg_days"))
    return q.join(d, list(keys)).join(concentration(trades, keys, (10,)), list(keys)).select(*keys, *PROFILE)


def best_against(trades: DataFrame, reference: str) -> DataFrame:
    """The symbol with the highest profit factor of the others beside the reference, one row per figure."""
    p = materialise(profile(trades, ["symbol"]), "profiles")
    order = F.struct(F.col("profit_factor"), F.transform(F.split("symbol", ""), lambda c: -F.ascii(c)))
    best = p.filter(F.col("symbol") != reference).agg(F.max_by("symbol", order).alias("best"))
    long = p.join(F.broadcast(best), (F.col("symbol") == F.col("best")) | (F.col("symbol") == reference)).unpivot(["symbol", "best"], list(PROFILE), "metric", "value")
    ours = F.col("symbol") == reference
    return long.groupBy("metric", "best").agg(F.max(F.when(ours, F.col("value"))).alias("reference"), F.max(F.when(~ours, F.col("value"))).alias("other"))


def synthesis(trades: DataFrame, reference: str) -> DataFrame:
    """What the symbols other than the reference have in common: shape, concentration, years, and what follows from them."""
    group = trades.filter(F.col("symbol") != reference)
    one = lambda df: df.withColumn("_one", F.lit(1))
    shape = profile(group, ["symbol"]).agg(F.avg("skew").alias("avg_skew"), F.avg("wl_ratio").alias("avg_wl_ratio"))
    top = concentration(one(group), ["_one"], (20,)).select("_one", "top_20_pct")
    mid = percentiles(one(group).withColumn("_r", F.col("return_pct") * 100), ["_one"], "_r", {"median_return": 0.5})
    below = F.count_if(F.col("profit_factor") < 1)
    years = by_year(group, ["symbol"]).agg(F.count(F.lit(1)).alias("n_years"), below.alias("years_below_1"), ((F.count(F.lit(1)) - below) / F.count(F.lit(1)) * 100).alias("pct_years_ok"))
    out = one(shape).join(top, "_one").join(mid, "_one").join(one(years), "_one").drop("_one")
    narrow, stable = F.col("top_20_pct") > 50, F.col("pct_years_ok") > 70
    advice = F.when(narrow & ~stable, "do not trade").when(narrow, "investigate, small size").when(stable, "trade with care").otherwise("investigate")
    pattern = F.when((F.col("avg_skew") > 0.5) & (F.col("avg_wl_ratio") > 2.0), "momentum").otherwise("mean reversion")
    return out.withColumns({"pattern": pattern, "recommendation": advice})


def slope_class(slope: Column) -> Column:
    return F.when(slope > 0.5, "rising").when(slope < -0.5, "falling").otherwise("flat")


def distance_bucket(d: Column) -> Column:
    return F.when(d < 2, "Close (< 2%)").when(d < 5, "Mid (2-5%)").otherwise("Far (> 5%)")


def stop_what_if(excursions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per stop level: trades it would have hit and how many of those were winners."""
    e = excursions.select(*keys, "mae_pct", "pnl", F.explode(F.array(*[F.lit(x) for x in STOP_LEVELS])).alias("level"))
    hit = F.col("mae_pct") <= F.col("level")
    g = e.groupBy(*keys, "level").agg(F.count(F.lit(1)).alias("n_trades"), F.count_if(hit).alias("n_stopped"), F.count_if(hit & (F.col("pnl") > 0)).alias("n_winners"))
    return g.withColumn("pct_stopped", F.col("n_stopped") / F.col("n_trades") * 100).withColumn(
        "false_positive_pct", F.coalesce(F.try_divide(F.col("n_winners"), F.col("n_stopped")) * 100, F.lit(0.0)))


def recommended_stop(levels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The tightest level with fewer than 3 % stopped and fewer than half of those winners."""
    ok = (F.col("pct_stopped") < 3) & (F.col("false_positive_pct") < 50)
    return levels.groupBy(*keys).agg(F.max(F.when(ok, F.col("level"))).alias("recommended"))


def compare_two(a: DataFrame, b: DataFrame, margin: float = 0.10, min_trades: int = 20) -> DataFrame:
    """Metrics of two rules side by side per symbol with deltas and a category."""
    cols = ["n_trades", "win_rate", "profit_factor", "sharpe"]
    left = a.select("symbol", *[F.col(c).alias(f"a_{c}") for c in cols])
    right = b.select("symbol", *[F.col(c).alias(f"b_{c}") for c in cols])
    d = F.col("b_profit_factor") - F.col("a_profit_factor")
    return left.join(right, "symbol").withColumns({
        "trade_reduction_pct": F.coalesce(F.try_divide(F.col("a_n_trades") - F.col("b_n_trades"), F.col("a_n_trades")) * 100, F.lit(0.0)),
        "pf_delta": d, "wr_delta": F.col("b_win_rate") - F.col("a_win_rate"), "sharpe_delta": F.col("b_sharpe") - F.col("a_sharpe"),
        "category": F.when(d > margin, "WINNER").when(d < -margin, "LOSER").otherwise("NEUTRAL"), "reliable": F.col("b_n_trades") >= min_trades,
    })


def compare_total(pairs: DataFrame) -> DataFrame:
    """Totals of a comparison: counts, trade-weighted means, and the element at n/2 of the deltas."""
    wmean = lambda v, w: F.coalesce(F.try_divide(F.sum(F.col(v) * F.col(w)), F.sum(w)), F.lit(0.0))
    n = F.count(F.lit(1))
    g = pairs.groupBy().agg(
        n.alias("n_assets"), *[F.count_if(F.col("category") == c).alias(f"n_{c.lower()}") for c in ("WINNER", "LOSER", "NEUTRAL")],
        F.count_if("reliable").alias("n_reliable"), F.sum("a_n_trades").alias("a_trades"), F.sum("b_n_trades").alias("b_trades"),
        wmean("a_win_rate", "a_n_trades").alias("a_wr"), wmean("a_profit_factor", "a_n_trades").alias("a_pf"),
        wmean("b_win_rate", "b_n_trades").alias("b_wr"), wmean("b_profit_factor", "b_n_trades").alias("b_pf"), F.avg("pf_delta").alias("avg_pf_delta"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY pf_delta DESC)").alias("median_pf_delta"),
    )
    return g.withColumn("trade_reduction_pct", F.coalesce(F.try_divide(F.col("a_trades") - F.col("b_trades"), F.col("a_trades")) * 100, F.lit(0.0)))
