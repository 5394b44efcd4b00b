"""Shared column helpers, stored tables and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tickloom.session import shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = "\t\n\x0b\x0c\r"
#: A word in Python's notation: what lies between the blanks 0x20 and 0x09-0x0D.
WORD = "[^\x20\x09-\x0d]+"


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_STORED: list[str] = []
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def setting(spark: SparkSession, key: str, value: str | None) -> Iterator[None]:
    """Jobs run inside have the session's setting ``key`` at ``value`` (null: as it is); it is put back after."""
    before = spark.conf.get(key, None)
    if value is not None:
        spark.conf.set(key, value)
    try:
        yield
    finally:
        if value is not None:
            spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def batched(spark: SparkSession, rows: int | None) -> AbstractContextManager[None]:
    """Python functions of jobs run inside get ``rows`` rows at a time (null: the session's setting, which is put back after)."""
    return setting(spark, BATCH, str(rows) if rows else None)


def write(df: DataFrame, path: str, batch_rows: int | None = None) -> None:
    """Write a table; what its job exchanged is deleted when it is written, not when the driver happens to collect its garbage."""
    with batched(df.sparkSession, batch_rows), setting(df.sparkSession, CLEANUP, "true"):
        df.write.parquet(path)


def store(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write an intermediate table to the folder in ``spark.checkpoint.dir`` and read it back.

    Lineage ends there: a lost executor costs no more than the tasks since, and exchanged files go at once (see ``write``). Tables stay until ``release``. ``batch_rows`` bounds
    the rows that Python functions get at a time while the table is written; the session's setting is put back.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    _STORED.append(path)
    write(df, path, batch_rows)
    return spark.read.schema(df.schema).parquet(path)


def stored() -> int:
    """A mark for ``release``: how many tables have been stored."""
    return len(_STORED)


def release(spark: SparkSession, since: int = 0, until: int | None = None) -> None:
    """Delete the tables stored after a mark (and before another); what still reads them must have been written before."""
    for path in _STORED[since:until]:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    del _STORED[since:until]


def packed(docs: DataFrame, *read: str) -> DataFrame:
    """The columns an operator reads, and all columns in one struct ``row``: helper columns cannot meet given ones of the same name."""
    return docs.select(*read, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def words(text: Column) -> Column:
    """The words of a text in order (a null text has none)."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), BLANKS, " " * len(BLANKS)), " "), "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def crc_text(doc_id: Column) -> Column:
    """crc32 of the id written as decimal text; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); root is the smallest node.

    Alternates large-star and small-star steps: every step is a minimum per node (combined before
    the shuffle) and a join, so no node's neighbours are gathered in one place. The edges left after a
    step are written to the shared folder; the loop ends when a round changes nothing, which takes
    about log(nodes) rounds: ``max_rounds`` of 60 are beyond any number of nodes that 64 bits can name.
    """
    cur = store(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        seen = cur.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen == mark or not seen.n:
            break
        mark = seen
        both = cur.unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        cur = store(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
