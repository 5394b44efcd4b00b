"""Stored sketches of trades per key and month, merged at query time.

A month's trades leave a quantile sketch of their returns, one of their excursions, and a distinct sketch of their exit
days. Sketches merge in any order and a year's percentiles read its months' sketches, no trade. A quantile's rank is off by
about 1.7 % of the rows with ``k`` of 200 and 0.5 % with 800 (99 % confidence), and is exact below ``k`` rows; the
distinct count is off by about 1.6 % (one standard deviation at 12 bits).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

K = 800


def monthly_sketches(trades: DataFrame, keys: Sequence[str] = ("symbol",), values: Sequence[str] = ("return_pct",), k: int = K) -> DataFrame:
    """One row per key and month of exit: rows, a quantile sketch per value, a distinct sketch of the exit days."""
    month = F.trunc("exit_date", "MM").alias("month")
    quantiles = [F.kll_sketch_agg_double(F.col(v).cast("double"), F.lit(k)).alias(f"{v}_q") for v in values]
    return trades.where("exit_date IS NOT NULL").groupBy(*keys, month).agg(
        F.count(F.lit(1)).alias("n"), *quantiles, F.hll_sketch_agg(F.unix_date("exit_date").cast("long")).alias("days"))


def merged(sketches: DataFrame, by: Sequence, values: Sequence[str] = ("return_pct",)) -> DataFrame:
    """Sketches of larger groups, from those of smaller ones."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), *[F.kll_merge_agg_double(f"{v}_q").alias(f"{v}_q") for v in values], F.hll_union_agg("days").alias("days"))


def percentiles_of(sketches: DataFrame, keys: Sequence[str], value: str, probs: Sequence[int]) -> DataFrame:
    """(keys, n, n_days, p..) read from merged sketches: the smallest value whose rank reaches the share."""
    at = [F.kll_sketch_get_quantile_double(f"{value}_q", F.lit(p / 100)).alias(f"p{p}") for p in probs]
    return sketches.select(*keys, "n", F.hll_sketch_estimate("days").alias("n_days"), *at)
