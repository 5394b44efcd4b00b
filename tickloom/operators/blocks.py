"""Ranges of bars by blocks: the first bar that reaches a level, extremes and sums between two bars.

Bars are kept as one row per block of ``SIZE`` bars, with the bars as an array and the block's low, high, volume and
number. Over the blocks lies a sparse table (extremes of 1, 2, 4, ... blocks from each block on) and a layer of wide
blocks. What a trade or a candidate reads is a few rows by equi-join, whatever number of bars it spans.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialise
from .spans import spread

SIZE = 128
WIDE = 32


def bar_blocks(bars: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """(keys, block, bars, low, high, volume): one row per block, stored, as several steps read it."""
    bar = F.struct("bar_ix", F.col("date").cast("date").alias("date"), "open", "high", "low", "close", F.col("volume").cast("double").alias("volume"))
    g = bars.withColumn("block", block_of(F.col("bar_ix"))).groupBy(*keys, "block")
    return materialise(g.agg(F.array_sort(F.collect_list(bar)).alias("bars"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("volume").cast("double").alias("volume")), "bar-blocks")


def block_of(ix: Column, size: int = SIZE) -> Column:
    return F.floor(ix / F.lit(size)).cast("long")


def inside(bars: Column, first: Column, last: Column) -> Column:
    """The bars of an array between two bar numbers, both included."""
    return F.filter(bars, lambda b: (b["bar_ix"] >= first) & (b["bar_ix"] <= last))


# ---------------------------------------------------------------- first bar at a level


def first_reach(cands: DataFrame, blocks: DataFrame, keys: Sequence[str], ident: Sequence[str]) -> DataFrame:
    """The candidates (one row per ``ident``) that reach their level, with the bar that does, ``hit``.

    ``cands`` has keys, ident, ``direction``, ``level``, ``first`` and ``last`` bar. A long reaches its level when a low is at or below it, a short
    when a high is at or above it. The block of the first bar is looked into; who finds nothing there meets the lows of the
    blocks up to its last bar, wide blocks in the middle, keeps the first that reaches the level, and opens that one.
    """
    keys, ident = list(keys), list(ident)
    own = list(dict.fromkeys([*keys, *ident, "direction", "level", "first", "last"]))
    long = F.col("direction") > 0
    reached = lambda low, high: F.when(long, low <= F.col("level")).otherwise(high >= F.col("level"))
    in_block = F.try_element_at(F.filter(inside(F.col("bars"), F.col("first"), F.col("last")), lambda b: reached(b["low"], b["high"])), F.lit(1))
    rows = blocks.select(*keys, "block", "bars")

    start = cands.select(*own).withColumn("block", block_of(F.col("first"))).join(rows, [*keys, "block"], "left")
    start = materialise(start.select(*own, "block", in_block.alias("hit")), "reach-first")
    # the rest of the way: blocks up to a border between wide blocks, wide blocks, blocks again
    open_ = start.where("hit IS NULL").withColumn("end", block_of(F.col("last"))).where("end > block")
    low_wide, high_wide = F.ceil((F.col("block") + 1) / F.lit(WIDE)).cast("long"), block_of(F.col("end") + 1, WIDE)
    seq = lambda a, b, width: F.when(a <= b, F.transform(F.sequence(a, b), lambda k: F.struct(F.lit(width).alias("width"), k.alias("at")))).otherwise(F.array().cast("array<struct<width:int,at:bigint>>"))
    near, far = F.col("block") + 1, F.col("end")
    cover = F.when(low_wide < high_wide, F.concat(seq(near, low_wide * WIDE - 1, 1), seq(low_wide, high_wide - 1, WIDE), seq(high_wide * WIDE, far, 1))).otherwise(seq(near, far, 1))
    wide = blocks.groupBy(*keys, block_of(F.col("block"), WIDE).alias("at")).agg(F.min("low").alias("low"), F.max("high").alias("high")).withColumn("width", F.lit(WIDE))
    narrow = blocks.select(*keys, F.col("block").alias("at"), "low", "high", F.lit(1).alias("width"))
    met = open_.select(*own, F.explode(cover).alias("c")).select(*own, "c.*").join(narrow.unionByName(wide), [*keys, "width", "at"]).where(reached(F.col("low"), F.col("high")))
    met = met.groupBy(*own).agg(F.min(F.struct((F.col("at") * F.col("width")).alias("block"), "width")).alias("f")).select(*own, "f.*")
    met = materialise(met, "reach-block")
    # inside a wide block: its blocks
    deep = met.where(f"width = {WIDE}").select(*own, F.explode(F.sequence(F.col("block"), F.col("block") + WIDE - 1)).alias("at"))
    deep = deep.join(narrow.drop("width"), [*keys, "at"]).where(reached(F.col("low"), F.col("high"))).groupBy(*own).agg(F.min("at").alias("block"))
    found = met.where("width = 1").select(*own, "block").unionByName(deep.select(*own, "block"))
    found = found.join(rows, [*keys, "block"]).select(*own, in_block.alias("hit"))
    return start.select(*own, "hit").unionByName(found).where("hit IS NOT NULL").select(*list(dict.fromkeys([*keys, *ident])), "hit")


# ---------------------------------------------------------------- extremes and sums between two bars


def sparse_table(blocks: DataFrame, keys: Sequence[str], longest: int) -> DataFrame:
    """(keys, power, block, low, high) of the 2**power blocks from each block on, for ranges of up to ``longest`` blocks."""
    powers = max(1, longest).bit_length()
    f = spread(blocks.select(*keys, "block", "low", "high"), after=1 << (powers - 1), size=max(1024, 1 << powers), ix="block")
    w = Window.partitionBy(*keys, "span").orderBy("block")
    rows = F.array(*[F.struct(F.lit(k).alias("power"), F.min("low").over(w.rowsBetween(0, (1 << k) - 1)).alias("low"), F.max("high").over(w.rowsBetween(0, (1 << k) - 1)).alias("high")) for k in range(powers)])
    return f.withColumn("_r", rows).where("home").select(*keys, "block", F.inline("_r"))


def between(trades: DataFrame, blocks: DataFrame, keys: Sequence[str] = ("symbol",), sums: bool = False) -> DataFrame:
    """Trades with ``low`` and ``high`` of the bars from entry to exit, both included; with ``sums`` also ``n_bars`` and ``volume``.

    Four rows per trade: the blocks of entry and exit for their bars, and two entries of the sparse table for the blocks between. Sums
    come from running totals over the blocks, read in the rows of entry and exit.
    """
    keys = list(keys)
    rows = blocks
    if sums:  # only three numbers per block are ordered over a key
        w = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        totals = {"before_n": F.coalesce(F.sum("n").over(w), F.lit(0)), "before_volume": F.coalesce(F.sum("volume").over(w), F.lit(0.0))}
        rows = rows.join(blocks.select(*keys, "block", F.size("bars").alias("n"), "volume").withColumns(totals).drop("n", "volume"), [*keys, "block"])
    t = trades.withColumns({"_a": block_of(F.col("entry_ix")), "_b": block_of(F.col("exit_ix"))})
    name = lambda side: rows.select(*keys, F.col("block").alias(f"_{side}"), *[F.col(c).alias(f"_{c}_{side}") for c in rows.columns if c not in (*keys, "block", "low", "high", "volume")])
    t = t.join(name("a"), [*keys, "_a"], "left").join(name("b"), [*keys, "_b"], "left")
    same = F.col("_a") == F.col("_b")
    first, last = F.col("entry_ix"), F.col("exit_ix")
    edge = F.when(same, inside(F.col("_bars_a"), first, last)).otherwise(F.concat(inside(F.col("_bars_a"), first, last), inside(F.col("_bars_b"), first, last)))
    t = t.withColumn("_edge", edge)
    extra = {}
    if sums:
        ahead = lambda side, n: (F.aggregate(F.filter(f"_bars_{side}", lambda x: x["bar_ix"] < n), F.lit(0.0), lambda s, x: s + x["volume"]), F.size(F.filter(f"_bars_{side}", lambda x: x["bar_ix"] < n)))
        (va, na), (vb, nb) = ahead("a", first), ahead("b", last + 1)
        extra = {"n_bars": F.col("_before_n_b") + nb - F.col("_before_n_a") - na, "volume": F.col("_before_volume_b") + vb - F.col("_before_volume_a") - va}
    t = t.withColumns(extra | {"_low": F.array_min(F.transform("_edge", lambda x: x["low"])), "_high": F.array_max(F.transform("_edge", lambda x: x["high"]))})
    n = F.col("_b") - F.col("_a") - 1
    power = F.when(n > 0, F.floor(F.log2(n.cast("double"))).cast("int"))
    t = materialise(t.drop("_edge", *[c for c in t.columns if c.startswith(("_bars_", "_before_"))]).withColumns({"_p": power, "_n": n}), "trade-edges")
    longest = t.agg(F.max("_n")).first()[0]
    if longest and longest > 0:
        table = sparse_table(blocks, keys, longest)
        part = lambda side: table.select(*keys, F.col("power").alias("_p"), F.col("block").alias(f"_s{side}"), F.col("low").alias(f"_low{side}"), F.col("high").alias(f"_high{side}"))
        t = t.withColumns({"_s1": F.col("_a") + 1, "_s2": F.col("_b") - F.expr("shiftleft(1, coalesce(_p, 0))")})
        t = t.join(part(1), [*keys, "_p", "_s1"], "left").join(part(2), [*keys, "_p", "_s2"], "left")
        t = t.withColumns({"_low": F.least("_low", "_low1", "_low2"), "_high": F.greatest("_high", "_high1", "_high2")})
    return t.select(*trades.columns, F.col("_low").alias("low"), F.col("_high").alias("high"), *extra)
