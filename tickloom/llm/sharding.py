"""Sharding by sampled splitters.

Records get the key (hash of text, hash of id, row number), so equal texts are neighbours and the order
is otherwise random. A size-weighted sample of keys gives splitters at equal shares of the bytes, the
splitters cut the records into many ranges, and ranges that came out too large are sampled again and cut
further. Ranges are the unit of parallel work: inside each, a running sum in key order places every record
exactly, and a shard is a stretch of 1/n of all bytes. So shard sizes differ by about one record.

Equal texts stay together unless their bytes exceed ``group_share`` of a shard; larger groups are cut like
any other stretch. Repeated rows are told apart by their row number only, so they never form an indivisible
group. A null text has size 1; an empty table gives no rows; other columns are ignored unless carried.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import store


def _splitters(sample: pd.DataFrame, n: int) -> list[str]:
    """Keys at n - 1 equal steps of the weight.

    A splitter is cut back to the hash of its text, so that it falls between groups of equal texts, unless
    several splitters fall into one group: that group is too large for a range and is split inside.
    """
    s = sample.sort_values("key")
    cum = s.weight.cumsum().to_numpy()
    if not len(cum):
        return []
    at = np.searchsorted(cum, cum[-1] * np.arange(1, n) / n)
    keys = sorted(set(s.key.to_numpy()[np.minimum(at, len(cum) - 1)]))
    groups = Counter(k[:16] for k in keys)
    return sorted({k if groups[k[:16]] > 1 else k[:16] for k in keys})


def _ranged(keyed: DataFrame, splitters: list[str]) -> DataFrame:
    edges = np.array(splitters, dtype="U48")

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, key.to_numpy(dtype="U48"), side="right"))

    return keyed.withColumn("_range", range_of("_key"))


DIGEST = ("size", "text_crc32", "shard", "slot")


def assign_shards(docs: DataFrame, shards: int = 8, ranges_per_shard: int = 64, samples_per_range: int = 32, group_share: float = 0.02, carry: list[str] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (and the carried columns) of every row.

    Carried columns keep their names; those named like a column of the digest get ``_given`` after it.

    The driver holds the key sample (about shards * ranges_per_shard * samples_per_range keys of 48
    characters) and one row per range; both are bounded by the parameters, not by the data.
    """
    carry = list(carry or [])
    h = lambda c: F.lpad(F.hex(c), 16, "0")
    keyed = docs.select(
        F.col("doc_id").alias("_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("_size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("_crc"),
        F.concat(h(F.xxhash64("text")), h(F.xxhash64("doc_id")), h(F.monotonically_increasing_id())).alias("_key"),
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_carried") if carry else F.lit(None).alias("_carried"),
    )
    full = store(keyed if carry else keyed.drop("_carried"), "shard-keys")
    keyed = full.select("_id", "_size", "_crc", "_key")
    total = keyed.agg(F.sum("_size")).first()[0] or 0
    ranges = shards * ranges_per_shard
    share = total / ranges

    def draw(df: DataFrame, seed: int, rate: float) -> pd.DataFrame:
        """Keys with a probability of their size times ``rate``; a large record counts by its size."""
        u = F.pmod(F.xxhash64("_key", F.lit(seed)), F.lit(1 << 31)) / F.lit(float(1 << 31))
        return df.where(u < F.col("_size") * F.lit(rate)).select(F.col("_key").alias("key"), F.greatest(F.col("_size").cast("double"), F.lit(1 / rate)).alias("weight")).toPandas()

    splitters = _splitters(draw(keyed, 0, samples_per_range / share), ranges) if total else []
    for seed in range(1, 5):
        per = _ranged(keyed, splitters).groupBy("_range").agg(F.sum("_size").alias("bytes"), F.count("*").alias("n"))
        over = [r for r in per.where((F.col("bytes") > 2 * share) & (F.col("n") > 1)).collect()]
        if not over:
            break
        ids = [r["_range"] for r in over]
        again = draw(_ranged(keyed, splitters).where(F.col("_range").isin(ids)), seed, 4 * samples_per_range / share)
        new = set(splitters)
        home = np.searchsorted(np.array(splitters, dtype="U48"), again.key.to_numpy(dtype="U48"), side="right") if len(again) else np.array([])
        for r in over:
            new |= set(_splitters(again[home == r["_range"]], 2 * int(np.ceil(r["bytes"] / share))))
        if len(new) == len(splitters):
            break
        splitters = sorted(new)

    rows = _ranged(keyed, splitters)
    per = rows.groupBy("_range").agg(F.sum("_size").alias("_b"), F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    per = per.select("_range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_b", "_n")])
    inside = Window.partitionBy("_range").orderBy("_key").rowsBetween(Window.unboundedPreceding, 0)
    same = Window.partitionBy("_range", F.substring("_key", 1, 16))
    rows = rows.join(F.broadcast(per), "_range")
    rows = rows.withColumn("_end", F.col("_b") + F.sum("_size").over(inside)).withColumn("_rank", F.col("_n") + F.count("*").over(inside) - 1)
    rows = rows.withColumn("_group", F.sum("_size").over(same)).withColumn("_first", F.min(F.col("_end") - F.col("_size")).over(same))
    together = F.col("_group") <= F.lit(group_share * total / shards)
    twice = F.when(together, 2 * F.col("_first") + F.col("_group")).otherwise(2 * F.col("_end") - F.col("_size"))
    shard = F.least(F.lit(shards - 1), F.floor(twice * shards / F.lit(max(1, 2 * total)))).cast("int")
    placed = store(rows.select("_id", "_size", "_crc", "_key", "_rank", shard.alias("_shard")), "shard-ranks")
    first = placed.groupBy("_shard").agg(F.min("_rank").alias("_zero"))  # one row per shard
    out = placed.join(F.broadcast(first), "_shard").withColumn("_slot", F.col("_rank") - F.col("_zero"))
    digest = [F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot")]
    if not carry:
        return out.select(*digest)
    named = {c: f"{c}_given" if c in DIGEST else c for c in carry if c != "doc_id"}
    extra = [F.col("_carried")[c].alias(n) for c, n in named.items()]
    return out.join(full.select("_key", "_carried"), "_key").select(*digest, *extra)
