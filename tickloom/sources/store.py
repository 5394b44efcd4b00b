"""Table sinks: upsert, append without duplicates, delete, nested JSON reports."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import shared_dir

BAR_COLUMNS = ("symbol", "date", "open", "high", "low", "close", "volume")


def fit_bars(df: DataFrame) -> DataFrame:
    """Bar columns by case-insensitive name; a missing price or volume becomes 0."""
    have = {c.lower(): c for c in df.columns}
    cols = [F.col(f"`{have[c]}`").alias(c) if c in have else F.lit(0.0).alias(c) for c in BAR_COLUMNS]
    return df.select(*cols)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of both tables, the newer one where a key is in both."""
    rest = [c for c in old.columns if c not in keys]
    both = old.withColumn("_gen", F.lit(0)).unionByName(new.select(*old.columns).withColumn("_gen", F.lit(1)))
    kept = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_gen").alias("_row"))
    return kept.select(*keys, "_row.*").select(*old.columns)


def append_new(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows plus new rows whose key is not there yet."""
    return old.unionByName(new.dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti").select(*old.columns))


def without_symbol(bars: DataFrame, symbol: str | None = None) -> DataFrame:
    return bars.filter(F.lit(False)) if symbol is None else bars.filter(F.col("symbol") != symbol)


def written(df: DataFrame, name: str, fmt: str = "parquet", **options) -> str:
    """Write to a fresh path in the shared folder and return it."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.format(fmt).options(**options).mode("errorifexists").save(path)
    return path


REPORTED = {"win_rate": 4, "profit_factor": 4, "sharpe": 4, "net_return_pct": 2, "robustness_pct": 1, "ttest_p": 6}
REPORT_SCHEMA = (
    "strategy string, universe string, symbol string, n_trades bigint, win_rate double, profit_factor double, sharpe double, "
    "net_return_pct double, robustness_pct double, stable boolean, ttest_p double, verdict string"
)


def write_report(rows: DataFrame, name: str) -> str:
    """One JSON line per asset, figures rounded as published, in a folder per strategy and universe."""
    cols = ["strategy", "universe", "symbol", "n_trades", *REPORTED, "stable", "verdict"]
    out = rows.select(*[F.bround(c, REPORTED[c]).alias(c) if c in REPORTED else F.col(c) for c in cols])
    path = f"{shared_dir(rows.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    out.write.partitionBy("strategy", "universe").json(path)
    return path


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """The assets of all reports in a folder, with the file each came from."""
    return spark.read.schema(REPORT_SCHEMA).json(path).select("*", F.col("_metadata.file_name").alias("file_name"))


def report_summary(assets: DataFrame) -> DataFrame:
    """Number of assets and the symbols of each verdict per strategy and universe, in symbol order."""
    names = lambda v: F.sort_array(F.collect_list(F.when(F.col("verdict") == v, F.col("symbol")))).alias(v.lower())
    return assets.groupBy("strategy", "universe").agg(F.count(F.lit(1)).alias("n_assets"), *[names(v) for v in ("VALIDATED", "CONDITIONAL", "REJECTED")])
