"""Overfitting checks: block bootstrap, deflated Sharpe, parameter stability, convergence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalars as S
from . import metrics as M
from .equity import running
from .spans import SPAN

BLOCK_TRADES = 10


def uniform(*parts: Column, seed: int = 42) -> Column:
    """A uniform number in [0, 1) from the leading 52 bits of an md5 of the parts."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def trade_blocks(trades: DataFrame, keys: Sequence[str], size: int = BLOCK_TRADES) -> DataFrame:
    """Blocks of consecutive trades reduced to count, sum and sum of squares of returns."""
    numbered = running(trades.withColumn("_one", F.lit(1)), keys, ["entry_ix"], F.floor(F.col("entry_ix") / F.lit(SPAN)), {"_no": ("sum", "_one")})
    block = F.floor((F.col("_no") - 1) / F.lit(size)).cast("long")
    r = F.col("return_pct")
    return numbered.groupBy(*keys, block.alias("block")).agg(F.count(r).alias("n"), F.sum(r).alias("s"), F.sum(r * r).alias("q"))


def block_bootstrap(trades: DataFrame, keys: Sequence[str], sims: int = 1000, size: int = BLOCK_TRADES, seed: int = 42) -> DataFrame:
    """Share of resampled series whose Sharpe reaches the observed one, with a 90 % interval.

    Each slot of each simulation draws a block; blocks travel as three sums, and a
    simulation is a sum of sums, so trades are never multiplied.
    """
    keys = list(keys)
    blocks = trade_blocks(trades, keys, size)
    shape = blocks.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nb"), F.sum("n").alias("n_trades"))
    slots = blocks.select(*keys, F.col("block").alias("slot")).join(shape.filter("n_trades >= 30"), keys)
    runs = slots.withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(sims - 1))))
    runs = runs.select(*keys, "sim", F.floor(uniform(*[F.col(k) for k in keys], F.col("sim"), F.col("slot"), seed=seed) * F.col("_nb")).cast("long").alias("block"))
    sums = runs.join(blocks, [*keys, "block"]).groupBy(*keys, "sim").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")])
    mean = F.col("s") / F.col("n")
    sd = F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)))
    dist = sums.withColumn("sharpe", F.round(F.when(sd < 1e-10, 0.0).otherwise(F.least(F.lit(100.0), mean / F.when(sd >= 1e-10, sd))), 9))
    seen = trades.groupBy(*keys).agg(F.round(M.plain_sharpe(F.col("return_pct")), 9).alias("real_sharpe"), F.count(F.lit(1)).alias("n_trades"))
    p = dist.join(seen, keys).groupBy(*keys).agg(
        F.avg((F.col("sharpe") >= F.col("real_sharpe")).cast("double")).alias("_p"), F.percentile("sharpe", F.array(F.lit(0.05), F.lit(0.95))).alias("_ci"))
    out = seen.join(p, keys, "left")
    n = F.col("n_trades")
    return out.select(
        *keys, "n_trades", "real_sharpe", F.when(n < 5, 1.0).when(n < 30, 0.5).otherwise(F.col("_p")).alias("p_value"),
        F.col("_ci")[0].alias("ci_low"), F.col("_ci")[1].alias("ci_high"), (n < 30).alias("underpowered"))


def moments(trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Plain Sharpe, skewness and raw kurtosis with defaults for short series."""
    r = F.col("return_pct")
    n, sd = F.count(r), F.stddev_pop(r)
    return trades.groupBy(*keys).agg(
        n.alias("n_trades"), M.plain_sharpe(r).alias("sharpe"), F.when((n < 3) | (sd == 0), 0.0).otherwise(F.skewness(r)).alias("skewness"),
        F.when((n < 4) | (sd == 0), 3.0).otherwise(F.kurtosis(r) + 3).alias("kurtosis"))


def deflated_sharpe(m: DataFrame, trials: int, published: bool = False) -> DataFrame:
    """Probability that the Sharpe beats the best of ``trials`` tries by luck.

    The customary variant takes 3 and 1 off the kurtosis; ``published`` takes 1.
    """
    sr, top = F.col("sharpe"), S.expected_max_sharpe(F.lit(float(trials)))
    k = (F.col("kurtosis") - 1) if published else (F.col("kurtosis") - 4)
    d = 1 - F.col("skewness") * sr + k / 4 * sr * sr
    d = F.when(d <= 0, 1e-6).otherwise(d)
    z = (sr - top) * F.sqrt(F.col("n_trades") - 1) / F.sqrt(d)
    out = m.withColumn("max_expected_sharpe", top).withColumn("z", z)
    short = (F.col("n_trades") < 5) | F.lit(trials < 2)
    return out.withColumn("dsr", F.when(short, 0.0).otherwise(S.normal_cdf(F.col("z"))))


def perturbations(params: dict, names: Sequence[str], steps: Sequence[float] = (0.10, 0.20)) -> list[tuple[str, dict]]:
    """The base set first, then each numeric parameter moved up and down."""
    out = [("", dict(params))]
    for name in names:
        v = params[name]
        if not isinstance(v, (int, float)) or v == 0:
            continue
        for s in steps:
            for d in (-1, 1):
                moved = v * (1 + d * s)
                out.append((name, {**params, name: max(1, round(moved)) if isinstance(v, int) else max(0.01, moved)}))
    return out


def parameter_stability(metrics: DataFrame, tries: Sequence[tuple[str, dict]], names: Sequence[str], key: str = "symbol") -> DataFrame:
    """One minus the worst relative Sharpe drop under perturbation, clipped to 0..1, per parameter."""
    label = F.array(*[F.lit(n) for n, _ in tries])
    base = metrics.filter("combo_id = 0").select(key, F.col("sharpe").alias("_ref"))
    moved = metrics.filter("combo_id > 0").withColumn("param", label[F.col("combo_id")]).join(base, key)
    drop = F.greatest(F.lit(0.0), (F.col("_ref") - F.col("sharpe")) / F.greatest(F.abs("_ref"), F.lit(0.1)))
    g = moved.groupBy(key, "param").agg(F.max(drop).alias("_d"))
    return g.select(key, "param", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("_d"))).alias("stability")).withColumn("cliff", F.col("stability") < 0.5)


def convergence(params: DataFrame) -> DataFrame:
    """Agreement of a parameter across symbols: one minus the coefficient of variation."""
    v = F.col("value")
    n, m, sd = F.count(v), F.avg(v), F.stddev_pop(v)
    score = (
        F.when(n < 2, 1.0).when(m == 0, F.when(sd == 0, 1.0).otherwise(0.0))
        .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.try_divide(sd, F.abs(m)))))
    )
    return params.groupBy("param").agg(score.alias("score")).withColumn("divergent", F.col("score") < 0.5)
