"""Signals of the day: rule evaluation, guards, position actions and summaries."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scalars as S


def rsi_signal(status: Column, watch: Column, threshold: float = 10.0, buffer: float = 1.01) -> Column:
    rsi_ok, trend_ok = F.col("rsi_2") < threshold, F.col("close") > F.col("sma_200") * buffer
    both = rsi_ok & trend_ok
    opened = F.when(F.col("close") > F.col("sma_5"), "SELL").when(F.col("close") < F.col("sma_200"), "SAFETY_EXIT").otherwise("HOLD")
    pending = F.when(both, "PENDING_VALID").otherwise("PENDING_EXPIRED")
    return F.when(status == "pending", pending).when(status == "open", opened).when(watch, "WATCH").when(both, "BUY").otherwise("NO_SIGNAL")


def ibs_signal(status: Column, watch: Column, entry: float = 0.2, exit_: float = 0.8) -> Column:
    opened = (
        F.when(F.col("ibs") > exit_, "SELL").when(F.col("close") > F.col("prev_high"), "SELL")
        .when(F.col("close") < F.col("sma_200"), "SAFETY_EXIT").otherwise("HOLD")
    )
    both = (F.col("ibs") < entry) & (F.col("close") > F.col("sma_200"))
    return F.when(status == "open", opened).when(watch, "WATCH").when(both, "BUY").otherwise("NO_SIGNAL")


def tom_signal(status: Column, watch: Column, entry_date: Column, entry_days: int = 5, exit_day: int = 3) -> Column:
    new_month = F.trunc(entry_date, "MM") != F.trunc("date", "MM")
    opened = F.when(F.coalesce(new_month, F.lit(False)) & (F.col("dom") >= exit_day), "SELL").otherwise("HOLD")
    return F.when(status == "open", opened).when(watch, "WATCH").when(F.col("days_left") <= entry_days, "BUY").otherwise("NO_SIGNAL")


def rsi_notes(status: Column, watch: Column, threshold: float = 10.0, buffer: float = 1.01) -> Column:
    """Reason text of the mean-reversion signal."""
    rsi, c = S.fixed(F.col("rsi_2"), 1), S.fixed(F.col("close"), 2)
    rsi_ok, trend_ok = F.col("rsi_2") < threshold, F.col("close") > F.col("sma_200") * buffer
    t = str(threshold)
    why = F.concat_ws(", ", F.when(~rsi_ok, F.concat(F.lit("RSI(2)="), rsi, F.lit(f" >= {t}"))), F.when(~trend_ok, F.lit(f"Close < SMA200*{buffer}")))
    pending = F.when(rsi_ok & trend_ok, F.concat(F.lit("Pending BUY still valid (RSI="), rsi, F.lit(")"))).otherwise(F.concat(F.lit("Pending expired: "), why))
    opened = (
        F.when(F.col("close") > F.col("sma_5"), F.concat(F.lit("Close ("), c, F.lit(") > SMA5 ("), S.fixed(F.col("sma_5"), 2), F.lit(") -- sell at next open")))
        .when(F.col("close") < F.col("sma_200"), F.concat(F.lit("Close ("), c, F.lit(") < SMA200 ("), S.fixed(F.col("sma_200"), 2), F.lit(") -- safety exit at next open")))
        .otherwise("No exit condition met")
    )
    hit = F.when(watch, F.concat(F.lit("Would trigger BUY (RSI="), rsi, F.lit(f" < {t}, trend OK) -- watchlist only"))).otherwise(
        F.concat(F.lit("RSI(2)="), rsi, F.lit(f" < {t}, trend OK -- buy at next open")))
    return F.when(status == "pending", pending).when(status == "open", opened).when(rsi_ok & trend_ok, hit).otherwise("No entry conditions met")


def evaluate(members: DataFrame, snapshot: DataFrame, positions: DataFrame) -> DataFrame:
    """Signal per (strategy, symbol) from the latest snapshot and the open positions.

    Symbols without a complete snapshot give ``NO_SIGNAL`` with an error note.
    """
    whole = snapshot.filter("sma_200 IS NOT NULL AND sma_5 IS NOT NULL AND rsi_2 IS NOT NULL AND prev_high IS NOT NULL")
    held = positions.filter("status = 'open'").groupBy("strategy", "symbol").agg(F.min("entry_date").alias("_entry"), F.lit("open").alias("_status"))
    j = members.join(whole, "symbol", "left").join(held, ["strategy", "symbol"], "left")
    status, watch = F.coalesce("_status", F.lit("none")), F.col("is_watch")
    sig = (
        F.when(F.col("close").isNull(), "NO_SIGNAL").when(F.col("strategy") == "rsi2", rsi_signal(status, watch))
        .when(F.col("strategy") == "ibs", ibs_signal(status, watch)).when(F.col("strategy") == "tom", tom_signal(status, watch, F.col("_entry")))
    )
    note = F.when(F.col("close").isNull(), "ERROR: no data").otherwise("")
    value = F.when(F.col("strategy") == "rsi2", F.col("rsi_2")).when(F.col("strategy") == "ibs", F.col("ibs")).otherwise(F.col("days_left").cast("double"))
    return j.withColumns({"raw_signal": sig, "notes": note, "indicator_value": value})


def guard(evaluated: DataFrame, open_counts: DataFrame, limits: Mapping[str, int], capital: float, fraction: float, as_of: Column) -> DataFrame:
    """Slot guard, then stale guard, in list order per strategy.

    A BUY takes a slot when shares can be bought; a sell earlier in the list frees one. The number of
    open slots is a running sum held at the limit: the sum minus the most by which it has exceeded the limit so
    far. A strategy that starts above its limit buys nothing until its sells have brought it down to it.
    """
    lim = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])[F.col("strategy")]
    w = Window.partitionBy("strategy").orderBy("ord", "symbol")
    so_far, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    yes = lambda c: F.coalesce(c, F.lit(False))
    sell = F.col("raw_signal").isin("SELL", "SAFETY_EXIT")
    g = evaluated.join(open_counts, "strategy", "left").fillna(0, ["n_open"]).select(
        "strategy", "ord", "symbol", "raw_signal", F.col("n_open").cast("long").alias("_open"), lim.alias("_lim"),
        F.coalesce(S.whole_quantity(F.lit(capital * fraction), F.col("close")), F.lit(0.0)).alias("_shares"),
        yes(S.stale(F.col("date"), as_of)).alias("_stale"), yes((F.col("raw_signal") == "BUY") & ~F.col("is_watch")).alias("_buy"), yes(sell).cast("int").alias("_sell"))
    g = g.withColumns({"_left": F.col("_open") - F.sum("_sell").over(so_far), "_held": F.col("_open") - F.coalesce(F.sum("_sell").over(before), F.lit(0))})
    takes = F.col("_buy") & ~F.col("_stale") & (F.col("_shares") > 0) & yes(F.col("_held") <= F.coalesce("_lim", "_held"))
    g = g.withColumn("_step", takes.cast("int") - F.col("_sell"))
    g = g.withColumn("_sum", F.col("_open") + F.sum("_step").over(so_far))
    above = F.max(F.when(F.col("_left") <= F.col("_lim"), F.col("_sum") - F.col("_lim"))).over(so_far)
    g = g.withColumn("_n", F.col("_sum") - F.greatest(F.lit(0), above))
    full = yes(F.coalesce(F.lag("_n").over(w), F.col("_open")) >= F.col("_lim"))
    final = F.when(F.col("_buy") & full, "SKIP").when((F.col("raw_signal") == "BUY") & F.col("_stale"), "SKIP").otherwise(F.col("raw_signal"))
    return g.select("strategy", "symbol", final.alias("signal"), F.when(final == "BUY", F.col("_shares")).alias("shares"))


def approaching(evaluated: DataFrame) -> DataFrame:
    """Entries close to triggering, nearest first."""
    rsi, ibs = F.col("rsi_2"), F.col("ibs")
    is_rsi, is_ibs = F.col("strategy") == "rsi2", F.col("strategy") == "ibs"
    quiet = F.col("raw_signal").isin("NO_SIGNAL", "WATCH")
    near_rsi = is_rsi & (F.col("close") > F.col("sma_200") * 1.01) & (rsi > 10) & (rsi < 20)
    near_ibs = is_ibs & (F.col("close") > F.col("sma_200")) & (ibs > 0.2) & (ibs < 0.4)
    pct = F.when(is_rsi, S.proximity_pct(rsi, F.lit(10.0), F.lit(20.0))).otherwise(S.proximity_pct(ibs, F.lit(0.2), F.lit(0.4)))
    label = F.when(is_rsi, F.concat(F.lit("RSI="), S.fixed(rsi, 1), F.lit("/10"))).otherwise(F.concat(F.lit("IBS="), S.fixed(ibs, 3), F.lit("/0.2")))
    return evaluated.filter(quiet & (near_rsi | near_ibs)).select("symbol", "strategy", label.alias("label"), pct.alias("pct"))


def summary(signals: DataFrame, positions: DataFrame, prices: DataFrame) -> DataFrame:
    """Per strategy: signals by kind, open positions with their unrealised P&L, and the line of the message."""
    kinds = ("BUY", "SELL", "HOLD", "SKIP")
    wide = signals.groupBy("strategy").pivot("kind", list(kinds)).agg(F.count(F.lit(1))).fillna(0)
    wide = wide.select("strategy", *[F.col(k).alias(f"n_{k.lower()}") for k in kinds])
    marked = positions.join(prices, "symbol", "left")
    name = F.struct("symbol", "shares", F.concat("symbol", F.lit(" "), F.col("shares").cast("long").cast("string")).alias("text"))
    gain = F.bround(F.sum((F.col("current_price") - F.col("entry_price")) * F.col("shares")), 2)
    book = marked.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("n_open"), gain.alias("unrealized_pnl"), F.array_join(F.transform(F.array_sort(F.collect_list(name)), lambda x: x["text"]), ", ").alias("positions"))
    out = wide.join(book, "strategy", "left").fillna(0, ["n_open", "unrealized_pnl"]).fillna("", ["positions"])
    return out.withColumn("line", F.concat(F.upper("strategy"), F.lit(": "), F.col("n_buy").cast("string"), F.lit(" BUY, "), F.col("n_sell").cast("string"), F.lit(" SELL")))
