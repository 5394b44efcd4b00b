"""Stored results, signal log, positions and journal as relational operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The newest row per key; a hash-combinable aggregate instead of a sorted window."""
    rest = [c for c in df.columns if c not in keys]
    pick = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return pick.select(*keys, "_r.*").select(*df.columns)


def filtered(df: DataFrame, **equal) -> DataFrame:
    """Equality filters; an absent (None) argument adds no predicate."""
    for c, v in equal.items():
        if v is not None:
            df = df.filter(F.col(c) == v)
    return df


def latest_run(log: DataFrame, strategy: str | None = None) -> DataFrame:
    """Rows of the newest timestamp in the whole log, then the strategy filter."""
    newest = log.agg(F.max("timestamp").alias("timestamp"))
    return filtered(log.join(F.broadcast(newest), "timestamp", "left_semi"), strategy=strategy)


def latest_prices(log: DataFrame) -> DataFrame:
    """Close of each symbol's newest log row."""
    return log.groupBy("symbol").agg(F.max_by("close_price", F.struct("timestamp", "strategy")).alias("current_price"))


def unrealised(positions: DataFrame, prices: DataFrame, fee: Column | None = None) -> DataFrame:
    """Open positions at the latest price; 0 without a price, or NULL when fees are given."""
    cost = F.lit(0.0) if fee is None else fee
    gain = (F.col("current_price") - F.col("entry_price")) * F.col("shares") - cost
    pct = (F.col("current_price") - F.col("entry_price")) / F.col("entry_price") * 100
    out = positions.join(prices, "symbol", "left").withColumns({"unrealized_pnl": F.bround(gain, 2), "unrealized_pct": F.bround(pct, 2)})
    return out.fillna(0.0, ["unrealized_pnl", "unrealized_pct"]) if fee is None else out


def open_positions(book: DataFrame, orders: DataFrame) -> DataFrame:
    """Orders that open a position: none open yet for (strategy, symbol), first order per entry date."""
    held = book.filter("status = 'open'").select("strategy", "symbol").distinct()
    fresh = orders.join(held, ["strategy", "symbol"], "left_anti")
    first = fresh.groupBy("strategy", "symbol").agg(F.min_by(F.struct("entry_date", "entry_price", "shares"), "entry_date").alias("_r"))
    new = first.select("strategy", "symbol", "_r.*")
    return new.join(book.select("strategy", "symbol", "entry_date"), ["strategy", "symbol", "entry_date"], "left_anti")


def close_positions(book: DataFrame, closes: DataFrame, live: bool = False) -> DataFrame:
    """Closed rows with P&L for every close order that meets an open position."""
    c = closes.select("strategy", "symbol", F.col("exit_date").alias("_xd"), F.col("exit_price").alias("_xp"), *([F.col("fees").alias("_fx")] if live else []))
    fees = F.col("fees_entry") + F.col("_fx") if live else F.lit(0.0)
    pnl = (F.col("_xp") - F.col("entry_price")) * F.col("shares") - fees
    pct = pnl / (F.col("entry_price") * F.col("shares")) * 100 if live else (F.col("_xp") / F.col("entry_price") - 1) * 100
    return book.filter("status = 'open'").join(c, ["strategy", "symbol"]).withColumns(
        {"exit_date": F.col("_xd"), "exit_price": F.col("_xp"), "pnl_dollars": pnl, "pnl_pct": pct, "status": F.lit("closed")}).drop("_xd", "_xp", "_fx")


def patched(book: DataFrame, patch: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Only fields given in the patch change."""
    p = patch.select("id", *[F.col(c).alias(f"_{c}") for c in cols])
    out = book.join(p, "id", "left").withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in cols})
    return out.drop(*[f"_{c}" for c in cols])


def journal(paper: DataFrame, live: DataFrame, source: str | None = None) -> DataFrame:
    """Paper and live entries in one schema."""
    p = paper.withColumns({"source": F.lit("paper"), "fees": F.lit(0.0)})
    l = live.withColumns({"source": F.lit("live"), "fees": F.coalesce("fees_entry", F.lit(0.0)) + F.coalesce("fees_exit", F.lit(0.0))})
    l = l.drop("fees_entry", "fees_exit")
    return filtered(p.unionByName(l, allowMissingColumns=True), source=source)


def with_last_signal(entries: DataFrame, log: DataFrame) -> DataFrame:
    """Each entry with the details of the newest log row of its strategy and symbol."""
    last = log.groupBy("strategy", "symbol").agg(F.max_by("details_json", "timestamp").alias("details_json"))
    return entries.join(last, ["strategy", "symbol"], "left")


def with_signal_as_of(entries: DataFrame, log: DataFrame) -> DataFrame:
    """Each entry with the newest log row at or before its entry date.

    Entries and log rows are stacked in time order and the last log row is carried forward,
    month by month, so neither side is multiplied.
    """
    from .equity import fill

    keys = ["strategy", "symbol"]
    mark = F.struct(F.col("timestamp").alias("ts"), F.col("signal").alias("signal"))
    logs = log.select(*keys, F.col("timestamp").alias("_ts"), F.lit(0).alias("_kind"), mark.alias("_sig"), F.lit(None).cast("string").alias("id"))
    rows = entries.select(*keys, F.col("entry_date").cast("timestamp").alias("_ts"), F.lit(1).alias("_kind"), F.lit(None).cast(logs.schema["_sig"].dataType).alias("_sig"), "id")
    both = fill(logs.unionByName(rows), "_sig", keys, ["_ts", "_kind", "id"], F.trunc("_ts", "MM"), backward=False)
    hits = both.filter("_kind = 1").select("id", F.col("_sig_filled.ts").alias("signal_ts"), F.col("_sig_filled.signal").alias("last_signal"))
    return entries.join(hits, "id")


def verdict_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Verdicts that changed between two snapshots, including new and removed rows."""
    keys = ["strategy", "universe", "symbol"]
    b = before.select(*keys, F.col("verdict").alias("old"))
    a = after.select(*keys, F.col("verdict").alias("new"))
    j = b.join(a, keys, "full_outer").withColumns({"old": F.coalesce("old", F.lit("NEW")), "new": F.coalesce("new", F.lit("REMOVED"))})
    return j.filter(F.col("old") != F.col("new"))


def summary(book: DataFrame) -> DataFrame:
    """Closed trades, wins, P&L and open count, by strategy and in total."""
    pnl = F.when(F.col("status") == "closed", F.coalesce(F.col("pnl_dollars"), F.lit(0.0)))
    n = F.count(pnl)
    g = book.rollup("strategy").agg(
        n.alias("n_trades"), F.count_if(pnl > 0).alias("n_wins"),
        F.when(n > 0, F.bround(F.count_if(pnl > 0) / n * 100, 1)).otherwise(F.lit(0.0)).alias("win_rate"),
        F.bround(F.coalesce(F.sum(pnl), F.lit(0.0)), 2).alias("total_pnl"), F.count_if(F.col("status") == "open").alias("n_open"))
    return g.withColumn("strategy", F.coalesce("strategy", F.lit("ALL")))


def journal_stats(entries: DataFrame) -> DataFrame:
    shut = F.col("status") == "closed"
    pnl = F.when(shut, F.coalesce(F.col("pnl_dollars"), F.lit(0.0)))
    n = F.count_if(shut)
    return entries.agg(
        F.count(F.lit(1)).alias("total_trades"), F.count_if(~shut).alias("open_trades"), n.alias("closed_trades"), F.count_if(pnl > 0).alias("wins"),
        F.when(n > 0, F.bround(F.count_if(pnl > 0) / n * 100, 1)).otherwise(F.lit(0.0)).alias("win_rate"), F.bround(F.coalesce(F.sum(pnl), F.lit(0.0)), 2).alias("total_pnl"))


def searched(entries: DataFrame, text: str) -> DataFrame:
    """Case-insensitive substring in symbol, notes or tags."""
    s = text.lower()
    hit = [F.lower(F.coalesce(F.col(c), F.lit(""))).contains(s) for c in ("symbol", "notes", "tags")]
    return entries.filter(hit[0] | hit[1] | hit[2])
