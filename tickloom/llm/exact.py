"""Exact duplicates by 128-bit content hash, with bytes compared inside groups, in DataFrame operations.

A text's content is what remains without the blanks 0x20 and 0x09-0x0D. Rows are grouped by the content's hash and, inside
a hash, by the content itself, so texts that only share a hash are different groups. The aggregate runs before the
exchange too: however many copies a text has, each task sends one row for it. Of a group, the row with the most code points
in its original text stays, then the one with the smallest id. Both are one number per row, whose maximum is kept in place.

Rows then find their group by hash and SHA-256 without their texts; groups of a third of all rows are split by the skew
handling of the join. Repeated rows of one id and text are numbered, and only the first stays.

Null texts are empty; empty and blank texts are one group. A null id comes after all others. Columns beyond ``doc_id``
and ``text`` are not read, whatever their names. Texts of any length are compared whole. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import BLANKS

#: Code points and id in one decimal: the place of a 64-bit id is below the step.
STEP, TOP = Decimal(10**20), Decimal(2**63)


def content(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    for c in " " + BLANKS:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def md5(text: Column) -> Column:
    return known(F.md5(text.cast("binary")))


def sha(text: Column) -> Column:
    return known(F.sha2(text.cast("binary"), 256))


def known(digits: Column) -> Column:
    """Bytes that the optimizer knows to be there: otherwise a join on them would hash every text once more to filter nulls."""
    return F.coalesce(F.unhex(digits), F.lit(b""))


def mark(docs: DataFrame, content_hash: Callable[[Column], Column] = md5) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row; ``content_hash`` is any hash of the content."""
    read = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n"), content(F.col("text")).alias("body"))
    read = read.withColumn("h", content_hash(F.col("body")))
    # more code points first, then smaller ids; a null id is last
    place = F.coalesce(F.lit(TOP) - F.col("doc_id").cast("decimal(20,0)"), F.lit(Decimal(0)))
    order = (F.col("n").cast("decimal(10,0)") * F.lit(STEP) + place).cast("decimal(38,0)")
    groups = read.groupBy("h", "body").agg(F.max(order).alias("best"), F.count("*").alias("group_size"))
    groups = groups.withColumn("place", F.col("best") % F.lit(STEP)).select(
        "h", sha(F.col("body")).alias("sha"), "group_size", F.expr(f"best div {STEP}BD").alias("keep_n"),
        F.when(F.col("place") > 0, (F.lit(TOP) - F.col("place")).cast("long")).alias("keep_id"),
    )
    rows = read.select("doc_id", "n", "h", sha(F.col("body")).alias("sha"))
    again = F.row_number().over(Window.partitionBy("doc_id", "h", "sha").orderBy(F.desc("n")))
    got = rows.withColumn("again", again).join(groups, ["h", "sha"])
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("keep_n")) & (F.col("again") == 1)
    return got.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))

