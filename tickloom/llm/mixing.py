"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

A schedule of slots of equal token counts walks the golden-ratio sequence; each point, mapped through the
cumulative targets, names the source of its slot, so any stretch of the schedule is mixed in proportion.
Each source's documents, shuffled by a hash, form one stream cut into blocks as long as a slot. The k-th
slot of a source takes its block k, starting over at the end of the stream.

Targets: sources in code point order (null last) weigh 1, 2, 3, repeating, and share the sum of all sizes; no
target exceeds ``most`` times its source, the excess goes to the others by weight.

Ranks and stream positions are prefix sums in two levels (hash range or stretch of slots, then inside), so a
source that holds most rows or slots is spread over many tasks. Repeated rows are counted before the
shuffle and laid out again afterwards. Texts without words take part with size 0; an empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import packed, store, words

GOLDEN = 2654435769  # 2**32 over the golden ratio, odd
CIRCLE = 1 << 32


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"))


def targets(per_source: DataFrame, most: int = 3) -> DataFrame:
    """source, n, source_size, weight, target; one row per source, so ordering them all is small."""
    w = Window.orderBy(F.col("source").asc_nulls_last())
    t = per_source.withColumn("weight", (F.row_number().over(w) - 1) % 3 + 1).withColumn("cap", F.col("source_size") * most)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("total", F.sum("source_size").over(every)).withColumn("weights", F.sum("weight").over(every))
    left = F.col("total") - F.coalesce(F.sum("cap").over(rank), F.lit(0))
    level = left / (F.col("weights") - F.coalesce(F.sum("weight").over(rank), F.lit(0)))
    t = t.withColumn("level", level).withColumn("place", F.row_number().over(Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())))
    # sources are filled to their caps in order of cap per weight, up to the first that stays below its cap
    first = F.min(F.when(F.col("level") < F.col("cap") / F.col("weight"), F.struct("place", "level"))).over(every)
    t = t.withColumn("water", first["level"])
    target = F.coalesce(F.least(F.col("cap").cast("double"), F.col("water") * F.col("weight")), F.lit(0.0))
    return t.select("source", "n", "source_size", "weight", target.alias("target"))


def block_tokens(total: int, sources: int, slots_per_source: int = 1024, most: int = 4096) -> int:
    """Slot length: short enough for about 1,024 slots per source, at most 4,096 tokens."""
    return max(1, min(most, total // max(1, slots_per_source * sources)))


def schedule(spark, goals: DataFrame, slots: int, block: int, stretch: int = 4096) -> DataFrame:
    """(slot, source, rank): the source of each slot and the slot's number within its source."""
    high = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    arcs = goals.withColumn("hi", F.round(F.sum("target").over(high) / F.sum("target").over(every) * CIRCLE).cast("long"))
    arcs = arcs.withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy(F.col("source").asc_nulls_last())), F.lit(0))).where("hi > lo")
    arcs = arcs.select("source", "lo", "hi", F.explode(F.sequence(F.shiftright("lo", 20), F.shiftright(F.col("hi") - 1, 20))).alias("arc"))
    point = ((F.expr(f"(id div 65536) % 65536 * {GOLDEN}L % {CIRCLE}L * 65536L") + F.expr(f"id % 65536 * {GOLDEN}L")) % CIRCLE).alias("u")
    at = spark.range(slots).select(F.col("id").alias("slot"), point).withColumn("arc", F.shiftright("u", 20))
    named = at.join(arcs, "arc").where("u >= lo and u < hi").select("slot", "source", F.expr(f"slot div {stretch}").alias("part"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per = named.groupBy("source", "part").agg(F.count("*").alias("c")).select(F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))
    inside = named.withColumn("rn", F.row_number().over(Window.partitionBy("source", "part").orderBy("slot")))
    return inside.join(per, inside.source.eqNullSafe(per.s) & (inside.part == per.p)).select("slot", "source", (F.col("base") + F.col("rn") - 1).alias("rank"))


def streams(counted: DataFrame) -> DataFrame:
    """(doc_id, source, size, start): where each row begins in its source's shuffled stream."""
    item = counted.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies"))
    item = item.withColumn("key", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":mix")))).withColumn("part", F.substring("key", 1, 3)).withColumn("span", F.col("size") * F.col("copies"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per = item.groupBy("source", "part").agg(F.sum("span").alias("c")).select(F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "part").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, 0)
    item = item.withColumn("end", F.sum("span").over(inside))
    item = item.join(per, item.source.eqNullSafe(per.s) & (item.part == per.p)).withColumn("start", F.col("base") + F.col("end") - F.col("span"))
    return item.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "start").select("doc_id", "source", "size", (F.col("start") + F.col("copy") * F.col("size")).alias("start"), "copy")


def mix(docs: DataFrame, most: int = 3) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and copies of every row.

    ``taken`` counts the words of the row's text that the schedule takes, repeats included; ``copies`` is how
    often it takes the row's middle word, which is how often a mix of whole documents repeats the row.
    """
    spark = docs.sparkSession
    counted = store(sizes(docs), "mix-sizes")
    goals = store(targets(counted.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size")), most), "mix-targets")
    all_ = goals.agg(F.sum("source_size"), F.count("*")).first()
    total, n = all_[0] or 0, all_[1]
    block = block_tokens(total, n)
    slots = -(-total // block)
    blocks = goals.select(F.col("source").alias("gs"), F.greatest(F.lit(1), F.ceil(F.col("source_size") / block)).cast("long").alias("blocks"))
    plan = schedule(spark, goals, slots, block)
    taken = plan.join(blocks, plan.source.eqNullSafe(blocks.gs)).select(F.col("source").alias("ts"), (F.col("rank") % F.col("blocks")).alias("tb"))
    taken = taken.groupBy("ts", "tb").agg(F.least(F.count("*"), F.lit(most)).alias("times"))
    rows = streams(counted)
    cut = rows.where("size > 0").select("*", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")).alias("b"))
    middle = F.expr(f"(start + size div 2) div {block}")
    cut = cut.withColumn("part", F.least(F.col("start") + F.col("size"), (F.col("b") + 1) * block) - F.greatest(F.col("start"), F.col("b") * block)).withColumn("mid", middle == F.col("b"))
    cut = cut.join(taken, cut.source.eqNullSafe(taken.ts) & (cut.b == taken.tb), "left")
    times = F.coalesce("times", F.lit(0))
    got = cut.groupBy("doc_id", "source", "size", "start", "copy").agg(F.sum(F.col("part") * times).alias("taken"), F.sum(F.when(F.col("mid"), times).otherwise(0)).alias("copies"))
    got = got.select("doc_id", "source", "size", "copy", "taken", "copies").unionByName(rows.where("size = 0").select("doc_id", "source", "size", "copy", F.lit(0).cast("long").alias("taken"), F.lit(0).cast("long").alias("copies")))
    goals = goals.select(F.col("source").alias("gs"), "source_size", "target")
    return got.join(goals, got.source.eqNullSafe(goals.gs)).select("doc_id", "source", "size", "copy", "source_size", "target", "taken", "copies")


def mixed(docs: DataFrame, most: int = 3) -> DataFrame:
    """The mix as whole documents: every row as often as the schedule takes its middle word (0 to ``most`` times).

    Rows with equal id, source and size share their copies evenly, rounded.
    """
    per = mix(docs, most).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("c"), F.count("*").alias("m"))
    per = per.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), F.round(F.col("c") / F.col("m")).cast("int").alias("_copies")).where("_copies > 0")
    rows = packed(docs, "doc_id", "source", "text").select("doc_id", "source", "row", F.size(words(F.col("text"))).cast("long").alias("_words"))
    same = rows["doc_id"].eqNullSafe(per["_id"]) & rows["source"].eqNullSafe(per["_source"]) & (rows["_words"] == per["_size"])
    return rows.join(per, same).select("row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("row.*")
