"""Trades that do not overlap, without a walk over rows: an account takes the first candidate it is free for, again and again.

The candidates of an account are cut into spans of bars. What a span does to an account is a map from the bar it comes
in free at to the bar it leaves free at. That map is a staircase of few steps, as ways through a span soon meet. The
staircases of all spans of an account are one short row; followed from the beginning they say where each span is entered,
and each span then marks what it takes. Only columns and arrays of one span's candidates: no Python, no group in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialise

SPAN = 256
#: The bar an account with an open trade is free at.
NEVER = 2**31 - 1

STEPS = "array<struct<upto:int,leaves:int>>"


def without_overlap(cands: DataFrame, group: Sequence[str], cooldown: Column, size: int = SPAN) -> DataFrame:
    """The candidates that are taken, per group in order of ``entry_ix`` and, on one bar, of ``direction`` downwards.

    A candidate frees the account ``cooldown`` bars after the bar of its ``exit``; without an exit it stays open and is the last.
    """
    group = list(group)
    free = F.coalesce(F.col("exit.bar_ix") + 1 + cooldown, F.lit(NEVER)).cast("int")
    one = F.struct(F.col("entry_ix").cast("int").alias("at"), (-F.col("direction")).alias("side"), free.alias("free"), F.struct(*[c for c in cands.columns if c not in group]).alias("row"))
    rows = cands.withColumn("_span", F.floor(F.col("entry_ix") / F.lit(size)).cast("int"))
    rows = rows.groupBy(*group, "_span").agg(F.array_sort(F.collect_list(one)).alias("_c"))
    rows = materialise(rows, "candidate-spans")
    into = rows.select(*group, "_span", staircase(F.col("_c")).alias("steps")).groupBy(*group)
    into = into.agg(F.array_sort(F.collect_list(F.struct("_span", "steps"))).alias("s")).select(*group, F.inline(entered(F.col("s"))))
    taken = rows.join(into, [*group, "_span"]).select(*group, F.inline(walked(F.col("_c"), F.col("_free"))))
    return taken.select(*group, "row.*")


def leaving(steps: Column, free: Column) -> Column:
    """Where an account that is free at a bar leaves a span: the first step that reaches up to it, else it passes."""
    return F.coalesce(F.try_element_at(F.filter(steps, lambda s: s["upto"] >= free), F.lit(1))["leaves"], free)


def staircase(cands: Column) -> Column:
    """From the last candidate to the first: an account free at or before it takes it and goes on from where that one frees it."""

    def add(steps: Column, c: Column) -> Column:
        out = leaving(steps, c["free"])
        same = F.coalesce(F.try_element_at(steps, F.lit(1))["leaves"] == out, F.lit(False))
        return F.when(same, steps).otherwise(F.concat(F.array(F.struct(c["at"].alias("upto"), out.alias("leaves"))), steps))

    return F.aggregate(F.reverse(cands), F.array().cast(STEPS), add)


def entered(spans: Column) -> Column:
    """(_span, _free) of the spans in which something is taken."""

    def step(acc: Column, s: Column) -> Column:
        out = leaving(s["steps"], acc["free"])
        here = F.array(F.struct(s["_span"].alias("_span"), acc["free"].alias("_free")))
        return F.struct(out.alias("free"), F.when(out > acc["free"], F.concat(acc["into"], here)).otherwise(acc["into"]).alias("into"))

    start = F.struct(F.lit(-1).alias("free"), F.array().cast("array<struct<_span:int,_free:int>>").alias("into"))
    return F.aggregate(spans, start, step, lambda acc: acc["into"])


def walked(cands: Column, free: Column) -> Column:
    """The candidates taken by an account that comes in free at a bar."""

    def step(acc: Column, c: Column) -> Column:
        return F.when(c["at"] >= acc["free"], F.struct(c["free"].alias("free"), F.concat(acc["took"], F.array(F.struct(c["row"].alias("row")))).alias("took"))).otherwise(acc)

    start = F.struct(free.alias("free"), F.filter(F.transform(cands, lambda c: F.struct(c["row"].alias("row"))), lambda c: F.lit(False)).alias("took"))
    return F.aggregate(cands, start, step, lambda acc: acc["took"])
