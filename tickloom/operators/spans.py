"""Work on long ordered series without putting a whole series into one task.

A series (all bars of one key) is cut into *spans* of a fixed number of bars. Rows near
a span border are copied to the neighbour span, so a rolling window only needs
``(key, span)`` as its partition. What has to travel further than one span (a decaying
recurrence, the next exit, a running total) is summarised to one row per span; only that
summary, smaller by the span length, is ordered per key.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

SPAN = 1024
BLOCK = 256
_LN_TINY = 745.0  # exp(-745) is the smallest positive double


def spread(df: DataFrame, before: int = 0, after: int = 0, size: int = SPAN, ix: str = "bar_ix") -> DataFrame:
    """Assign ``span`` and copy border rows so each span sees ``before``/``after`` extra bars.

    ``home`` marks the one copy that belongs to the span; drop the others after the window.
    """
    i = F.col(ix).cast("long")
    lo = F.greatest(F.lit(0), F.floor((i - F.lit(after)) / F.lit(size)))
    hi = F.floor((i + F.lit(before)) / F.lit(size))
    out = df.withColumn("span", F.explode(F.sequence(lo.cast("long"), hi.cast("long"))))
    return out.withColumn("home", F.col("span") == F.floor(i / F.lit(size)))


def span_order(keys: Sequence[str], ix: str = "bar_ix") -> Window:
    """Window over one span in bar order."""
    return Window.partitionBy(*keys, "span").orderBy(ix)


@dataclass(frozen=True)
class Affine:
    """A recurrence ``y[t] = decay * y[t-1] + step[t]`` written to column ``out``."""

    out: str
    step: Column
    decay: float


def _folded(ends: Column, decay: float) -> Column:
    return F.aggregate(ends, F.lit(0.0), lambda acc, x: acc * F.lit(decay) + x)


def affine_scan(df: DataFrame, specs: Sequence[Affine], keys: Sequence[str], ix: str = "bar_ix") -> DataFrame:
    """Solve linear recurrences by blocks.

    Inside a block the closed form ``decay**t * sum(step * decay**-t)`` is one window sum.
    The value a block starts from is folded from the ends of the blocks before it, which are
    plain sums that combine on the map side; the number of blocks looked at reaches down to
    the smallest double, so nothing is cut off. ``step`` may only read columns of ``df``.
    """
    pos = F.col(ix) % F.lit(BLOCK)
    blk = F.floor(F.col(ix) / F.lit(BLOCK))
    w = Window.partitionBy(*keys, "_blk").orderBy(ix).rowsBetween(Window.unboundedPreceding, 0)
    scans = [s for s in specs if s.decay > 0.0]
    cols, ends, carries, done, reach = {}, [], {}, {}, 1
    for s in scans:
        if BLOCK * -math.log(s.decay) > 700:
            raise ValueError(f"decay {s.decay} is too fast for blocks of {BLOCK}")
        grow = F.pow(F.lit(1.0 / s.decay), pos)
        lifted = F.coalesce(s.step, F.lit(0.0)) * grow
        cols[f"_loc_{s.out}"] = F.sum(lifted).over(w) / grow
        ends.append((F.sum(lifted) * F.lit(s.decay ** (BLOCK - 1))).alias(f"_end_{s.out}"))
        reach = max(reach, math.ceil(_LN_TINY / (BLOCK * -math.log(s.decay))))
    for s in specs:
        done[s.out] = s.step
    if not scans:
        return df.withColumns(done)
    block_ends = df.withColumn("_blk", blk).groupBy(*keys, "_blk").agg(*ends)
    block_ends = spread(block_ends, before=reach, size=max(SPAN, reach), ix="_blk")
    back = span_order(keys, "_blk").rowsBetween(-reach, -1)
    for s in scans:
        carries[f"_in_{s.out}"] = _folded(F.collect_list(f"_end_{s.out}").over(back), s.decay**BLOCK)
        lead_in = F.pow(F.lit(s.decay), pos + 1) * F.coalesce(F.col(f"_in_{s.out}"), F.lit(0.0))
        done[s.out] = F.col(f"_loc_{s.out}") + lead_in
    carry = block_ends.withColumns(carries).filter("home").select(*keys, "_blk", *carries)
    local = df.withColumn("_blk", blk).withColumns(cols)
    return local.join(carry, [*keys, "_blk"], "left").withColumns(done).drop("_blk", *cols, *carries)


def next_hit(df: DataFrame, hits: dict[str, Column], keys: Sequence[str], ix: str = "bar_ix") -> DataFrame:
    """For every row the first non-null hit at or after it, across span borders.

    ``hits`` maps an output name to a struct column that starts with the bar index and is
    NULL where there is no hit. ``df`` carries ``span`` and only home rows. The first hit of
    each span is a map-side minimum; only those minima are ordered over a whole key.
    """
    back = Window.partitionBy(*keys, "span").orderBy(F.col(ix).desc()).rowsBetween(Window.unboundedPreceding, 0)
    marked = df.withColumns({f"_h_{k}": v for k, v in hits.items()})
    local = marked.withColumns({f"_l_{k}": F.last(f"_h_{k}", ignorenulls=True).over(back) for k in hits})
    heads = marked.groupBy(*keys, "span").agg(*[F.min(f"_h_{k}").alias(f"_l_{k}") for k in hits])
    later = Window.partitionBy(*keys).orderBy(F.col("span").desc()).rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(*keys, "span", *[F.last(f"_l_{k}", ignorenulls=True).over(later).alias(f"_n_{k}") for k in hits])
    joined = local.join(heads, [*keys, "span"], "left")
    out = joined.withColumns({k: F.coalesce(F.col(f"_l_{k}"), F.col(f"_n_{k}")) for k in hits})
    return out.drop(*[f"_{p}_{k}" for k in hits for p in "hln"])
