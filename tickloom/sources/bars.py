"""Bars: built from trades or events, indexed, cleaned and checked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

PRICES = ("open", "high", "low", "close", "adj_close")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ohlcv(ticks: DataFrame, keys: Sequence[str], bucket: str) -> DataFrame:
    """Ticks (``seq``, ``price``, ``qty``) to one bar per key and bucket.

    ``seq`` orders the ticks, a number or a struct. Partial bars are made on the map side, so only bars
    are shuffled.
    """
    return ticks.groupBy(*keys, bucket).agg(
        F.min_by("price", "seq").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"),
        F.sum("qty").alias("volume"),
    )


def lineitem_ticks(spark: SparkSession, sf_dir: str, grain: str = "region") -> DataFrame:
    """One tick per order line; the symbol is the supplier, or its nation or region.

    Prices are whole cents. Ticks are ordered by order, line and cents, so equal keys mean
    equal prices and open/close do not depend on row order.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_shipdate"
    )
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    cents = F.floor(F.col("p_retailprice") * (1 - F.col("l_discount")) * 100 + 0.5).cast("long")
    tick = [
        F.to_date("l_shipdate").alias("date"),
        F.struct("l_orderkey", "l_linenumber", cents.alias("cents")).alias("seq"),
        (cents / F.lit(100.0)).alias("price"),
        F.col("l_quantity").alias("qty"),
    ]
    priced = li.join(part, F.col("l_partkey") == F.col("p_partkey"))
    if grain == "supplier":
        return priced.select(F.concat(F.lit("S"), F.col("l_suppkey")).alias("symbol"), *tick)
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    place = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").join(
        nation, F.col("s_nationkey") == F.col("n_nationkey")
    )
    if grain == "region":
        region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
        place = place.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        place = place.select("s_suppkey", F.col("r_name").alias("symbol"))
    else:
        place = place.select("s_suppkey", F.col("n_name").alias("symbol"))
    return priced.join(place, F.col("l_suppkey") == F.col("s_suppkey")).select("symbol", *tick)


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tick per event; the symbol is the event type, the order is the event id."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_type").alias("symbol"),
        F.date_trunc("hour", "ts").alias("date"),
        F.col("event_id").alias("seq"),
        F.col("value").alias("price"),
        F.lit(1.0).alias("qty"),
    )


PREVIOUS = ("close", "high", "low")


def index_bars(bars: DataFrame, keys: Sequence[str] = ("symbol",), bucket: Column | None = None) -> DataFrame:
    """Add ``month``, ``dom``, ``days_left``, the per-key position ``bar_ix`` and yesterday's prices.

    Ranks and lags are taken inside one month; the offset of a month and the prices before
    it come from one row per month. No task ever orders all bars of a key.
    """
    by_month = bars.withColumn("month", bucket if bucket is not None else F.trunc("date", "MM"))
    inside = Window.partitionBy(*keys, "month").orderBy("date")
    totals = by_month.groupBy(*keys, "month").agg(F.count(F.lit(1)).alias("_n"), *[F.max_by(c, "date").alias(f"_e_{c}") for c in PREVIOUS])
    months = Window.partitionBy(*keys).orderBy("month")
    earlier = months.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "month", "_n", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"),
        *[F.lag(f"_e_{c}").over(months).alias(f"_e_{c}") for c in PREVIOUS])
    ranked = by_month.withColumns({"dom": F.row_number().over(inside), **{f"_p_{c}": F.lag(c).over(inside) for c in PREVIOUS}})
    return (
        ranked.join(offsets, [*keys, "month"])
        .withColumns({
            "days_left": (F.col("_n") - F.col("dom") + 1).cast("int"), "bar_ix": (F.col("_off") + F.col("dom") - 1).cast("int"),
            **{f"prev_{c}": F.coalesce(f"_p_{c}", f"_e_{c}") for c in PREVIOUS}})
        .drop("_n", "_off", *[f"_{x}_{c}" for c in PREVIOUS for x in "pe"])
    )


def bars_of(bars: DataFrame, symbol: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of one symbol, both dates inclusive, in date order."""
    out = bars.filter(F.col("symbol") == symbol)
    if start:
        out = out.filter(F.col("date") >= F.lit(start).cast("date"))
    if end:
        out = out.filter(F.col("date") <= F.lit(end).cast("date"))
    return out.withColumn("adj_close", F.col("close")).orderBy("date")


def normalise_history(raw: DataFrame) -> DataFrame:
    """Provider columns to bar columns; the timestamp loses its time of day."""
    names = {"Open": "open", "High": "high", "Low": "low", "Close": "close", "Adj Close": "adj_close", "Volume": "volume"}
    return raw.select("symbol", F.to_date("Date").alias("date"), *[F.col(f"`{o}`").alias(n) for o, n in names.items()])


def adjust_splits(raw: DataFrame, rtol: float = 1e-6, atol: float = 1e-8) -> DataFrame:
    """Scale O/H/L by ``adj_close / close`` for symbols with any real adjustment; close := adjusted.

    The per-symbol "any" is an aggregate joined back, so a long history is never one task.
    """
    ratio = F.try_divide("adj_close", "close")
    touched = raw.groupBy("symbol").agg(
        F.coalesce(F.bool_or(F.abs(ratio - 1) > atol + rtol), F.lit(False)).alias("_adj")
    )
    f = F.when(F.col("_adj"), ratio).otherwise(F.lit(1.0))
    return (
        raw.join(touched, "symbol")
        .withColumn("_f", f)
        .withColumns({c: F.col(c) * F.col("_f") for c in ("open", "high", "low")})
        .withColumn("close", F.when(F.col("_adj"), F.col("adj_close")).otherwise(F.col("close")))
        .drop("_f", "_adj")
    )


def quality_report(raw: DataFrame) -> DataFrame:
    """Per symbol: rows with a null price, rows with a price <= 0, rows with high < low."""
    has_null = F.greatest(*[F.col(c).isNull().cast("int") for c in PRICES]) == 1
    ok = ~has_null
    return raw.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(has_null).alias("n_null"),
        F.count_if(ok & (F.least(*PRICES) <= 0)).alias("n_nonpositive"),
        F.count_if(ok & (F.col("high") < F.col("low"))).alias("n_inverted"),
    )


def clean_bars(raw: DataFrame) -> DataFrame:
    """Drop rows with null prices, then drop whole symbols that break a price rule."""
    bad = quality_report(raw).filter("n_nonpositive > 0 OR n_inverted > 0").select("symbol")
    return raw.dropna(subset=list(PRICES)).join(bad, "symbol", "left_anti")


def coverage(bars: DataFrame, start: str, end: str, tolerance_days: int = 7) -> DataFrame:
    """Is the stored history close enough to the requested range to be used as is?"""
    s, e = F.lit(start).cast("date"), F.lit(end).cast("date")
    return bars.groupBy("symbol").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date")).withColumn(
        "usable",
        (F.col("first_date") <= F.date_add(s, tolerance_days)) & (F.col("last_date") >= F.date_sub(e, tolerance_days)),
    )


def catalogue(bars: DataFrame) -> DataFrame:
    """First date, last date and number of bars per symbol."""
    return bars.groupBy("symbol").agg(
        F.min("date").alias("start"), F.max("date").alias("end"), F.count(F.lit(1)).alias("n_rows")
    )


def update_plan(members: DataFrame, bars: DataFrame, overlap_days: int = 5, origin: str = "2003-01-01") -> DataFrame:
    """Where an incremental load has to start for every member symbol."""
    last = catalogue(bars).select("symbol", F.col("end").alias("last_date"))
    return members.join(last, "symbol", "left").withColumn(
        "load_from", F.date_sub(F.coalesce("last_date", F.lit(origin).cast("date")), overlap_days)
    )
