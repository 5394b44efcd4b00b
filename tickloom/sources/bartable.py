"""A bar table updated in place: one file per symbol bucket and month, rewritten only where something changed.

The layout is plain hive partitions, so a read for some symbols and dates opens the buckets and months it needs. An update
merges the touched partitions with the fresh rows in a table of its own and puts the result in their place (dynamic
partition overwrite); others stay as they are, and every partition is one file again. Applying an update twice changes nothing. An update is
not one transaction: a reader at the same moment may see some partitions new and others old, each of them whole.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import materialise
from .store import upsert

BUCKETS = 16
KEYS = ("symbol", "date")


def bucket_of(symbol: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(symbol), F.lit(buckets)).cast("int")


def placed(bars: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    return bars.withColumns({"bucket": bucket_of(F.col("symbol"), buckets), "month": F.date_format("date", "yyyy-MM")})


def _put(rows: DataFrame, path: str) -> None:
    """Replace the partitions that the rows fall into; one file each."""
    one = rows.repartition("bucket", "month").sortWithinPartitions("bucket", "month", *KEYS)
    one.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "month").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def table(spark: SparkSession, path: str, schema) -> DataFrame:
    """All columns, partition columns last; months stay text."""
    full = spark.createDataFrame([], schema).withColumns({"bucket": F.lit(0), "month": F.lit("")}).schema
    return spark.read.schema(full).parquet(path)


def update(bars: DataFrame, path: str, keys: Sequence[str] = KEYS) -> None:
    """Merge fresh bars into the table, the newer row where a key is in both; makes the table if there is none."""
    spark = bars.sparkSession
    fresh = materialise(placed(bars.dropDuplicates(list(keys))), "fresh-bars")
    if exists(spark, path):
        touched = fresh.select("bucket", "month").distinct()
        old = table(spark, path, bars.schema).join(touched, ["bucket", "month"], "left_semi").select(*fresh.columns)
        fresh = materialise(upsert(old, fresh, [*keys, "bucket", "month"]), "touched-months")
    if not fresh.isEmpty():
        _put(fresh, path)


def read(spark: SparkSession, path: str, schema, symbols: Sequence[str] | None = None, start: datetime.date | None = None, end: datetime.date | None = None) -> DataFrame:
    """Bars of some symbols from ``start`` to ``end``, both included; buckets and months are filtered as partitions."""
    out = table(spark, path, schema)
    if symbols is not None:
        inside = F.array(*[bucket_of(F.lit(s)) for s in symbols])
        out = out.where(F.array_contains(inside, F.col("bucket"))).where(F.col("symbol").isin(list(symbols)))
    if start is not None:
        out = out.where((F.col("month") >= start.strftime("%Y-%m")) & (F.col("date") >= F.lit(start)))
    if end is not None:
        out = out.where((F.col("month") <= end.strftime("%Y-%m")) & (F.to_date("date") <= F.lit(end)))
    return out.drop("bucket", "month")
