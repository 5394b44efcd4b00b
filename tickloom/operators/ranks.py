"""Exact ranks and percentiles of large groups without sorting a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

QUANTILES, INNER = 64, 16


def value_buckets(df: DataFrame, keys: Sequence[str], value: str, quantiles: int = QUANTILES, inner: int = INNER) -> DataFrame:
    """Add ``_bk``, an order-preserving bucket of ``value`` inside its group, from 0 up.

    Mergeable sketches (a map-side aggregate) give each group edges at equal shares of its rows, so outliers do
    not crowd the rest into one bucket; between two edges the buckets are of equal width. A bucket is what one task
    has to sort: a 64th of the group at most, but for ties.
    """
    v = F.col(value).cast("double")
    cuts = F.percentile_approx(v, [k / quantiles for k in range(1, quantiles)], 10_000)
    edge = df.groupBy(*keys).agg(cuts.alias("_cuts"), F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    out = df.join(edge, list(keys)).withColumn("_at", F.greatest(F.lit(0), F.coalesce(F.size(F.filter("_cuts", lambda e: e <= v)), F.lit(0))))
    lo, hi = F.coalesce(F.get("_cuts", F.col("_at") - 1), F.col("_lo")), F.coalesce(F.get("_cuts", F.col("_at")), F.col("_hi"))
    at = F.least(F.lit(inner - 1), F.floor(F.coalesce(F.try_divide(v - lo, hi - lo), F.lit(0.0)) * inner))
    return out.withColumn("_bk", (F.col("_at") * inner + at).cast("int")).drop("_cuts", "_lo", "_hi", "_at")


def _offsets(bucketed: DataFrame, keys: Sequence[str], weight: Column) -> DataFrame:
    """Rows before and in each bucket, and in the whole group."""
    counts = bucketed.groupBy(*keys, "_bk").agg(F.sum(weight).alias("_c"))
    group = Window.partitionBy(*keys)
    before = group.orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(*keys, "_bk", "_c", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"), F.sum("_c").over(group).alias("_n"))


def ranked(df: DataFrame, keys: Sequence[str], value: str, tie: str) -> DataFrame:
    """``rank`` of each row by ``value`` downwards, ties by ``tie`` upwards."""
    b = value_buckets(df, keys, value)
    inside = Window.partitionBy(*keys, "_bk").orderBy(F.col(value).desc(), F.col(tie))
    above = F.col("_n") - F.col("_before") - F.col("_c")
    local = b.withColumn("_rn", F.row_number().over(inside))
    out = local.join(_offsets(b, keys, F.lit(1)), [*keys, "_bk"]).withColumn("rank", (above + F.col("_rn")).cast("int"))
    return out.drop("_bk", "_c", "_before", "_n", "_rn")


def percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact percentiles with linear interpolation, one column per entry of ``probs``.

    Equal values are counted before anything is sorted. Bucket counts tell which buckets hold the wanted ranks; only
    those are sorted.
    """
    keys = list(keys)
    own = df.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL").groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_w"))
    b = value_buckets(own, keys, "_v")
    off = _offsets(b, keys, F.col("_w"))
    spot: dict[str, Column] = {name: (F.col("_n") - 1) * F.lit(float(p)) for name, p in probs.items()}
    lo, hi = F.col("_before"), F.col("_before") + F.col("_c") - 1
    holds = F.lit(False)
    for x in spot.values():
        holds = holds | (F.floor(x).between(lo, hi)) | (F.ceil(x).between(lo, hi))
    near = b.join(off.filter(holds), [*keys, "_bk"])
    w = Window.partitionBy(*keys, "_bk").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    picked = near.select(*keys, "_v", "_n", "_w", (F.col("_before") + F.sum("_w").over(w) - 1).alias("_to"))
    at = lambda x, f: F.max(F.when(f(x).between(F.col("_to") - F.col("_w") + 1, F.col("_to")), F.col("_v")))
    cols = []
    for name, x in spot.items():
        frac = F.max(x - F.floor(x))
        cols.append((at(x, F.floor) + (at(x, F.ceil) - at(x, F.floor)) * frac).alias(name))
    return picked.groupBy(*keys).agg(*cols)
