"""The daily scan as one stateful stream: three rules, their indicators and positions per (strategy, symbol), and the stale gate.

The state of a key holds what its rules read: a ring of the last closes in whole millionths (moving averages are exact sums), the Wilder averages
of RSI(2), yesterday's high, the bar's place in its month, and the open position. Bars that the watermark has not reached wait in a map of
time buckets; a timer takes the buckets it has passed, one at a time and each in date order, so files and batches
may bring bars in any order within the delay, and a backlog is never sorted whole.

Without a rhythm every bar is scanned on its own day. With ``every``, the scan runs on each day whose number is divisible by it, bar or no bar, on the key's latest bar;
timers wake keys without new bars. A BUY on a bar older than ``max_age`` days becomes SKIP, and the position stays closed.
"""

from __future__ import annotations

import datetime
import math
from collections.abc import Iterator, Sequence
from dataclasses import astuple, dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from .jobs import _timed

DAY = 86_400_000
LONGEST, SHORT = 200, 5
STRATEGIES = ("rsi2", "ibs", "tom")
BOOK = "ring array<long>, n long, gain double, loss double, close double, high double, low double, prev_high double, left long, dom long, day long, since long, scanned long"
SIGNALS = "strategy string, symbol string, date date, scan_date date, signal string, entry_date date, close double"


@dataclass
class Book:
    """Indicators and position of one key; days are numbers from the epoch."""

    ring: list[int] = field(default_factory=list)
    n: int = 0
    gain: float = 0.0
    loss: float = 0.0
    close: float | None = None
    high: float | None = None
    low: float | None = None
    prev_high: float | None = None
    left: int | None = None
    dom: int = 0
    day: int | None = None
    since: int | None = None
    scanned: int | None = None

    def bar(self, day: int, high: float, low: float, close: float, left: int) -> None:
        change = close - self.close if self.n else 0.0
        up, down = max(change, 0.0), max(-change, 0.0)
        if self.n <= 2:
            self.gain, self.loss = self.gain + up * 0.5, self.loss + down * 0.5
        else:
            self.gain, self.loss = self.gain * 0.5 + up * 0.5, self.loss * 0.5 + down * 0.5
        same = self.day is not None and month(self.day) == month(day)
        self.dom = self.dom + 1 if same else 1
        self.ring = [*self.ring[-(LONGEST - 1) :], math.floor(close * 1e6 + 0.5)]
        self.prev_high, self.n = self.high, self.n + 1
        self.day, self.high, self.low, self.close, self.left = day, high, low, close, left

    def sma(self, p: int) -> float:
        return float(sum(self.ring[-p:])) / p / 1e6

    def signal(self, strategy: str, rsi_entry: float, buffer: float) -> str | None:
        """BUY, SELL or SAFETY_EXIT on the latest bar, once there are enough bars for every indicator."""
        if self.n < LONGEST:
            return None
        c, trend = self.close, self.sma(LONGEST)
        if strategy == "rsi2":
            rsi = 100.0 if self.loss == 0 else 100 - 100 / (1 + self.gain / self.loss)
            buy, sell, safe = rsi < rsi_entry and c > trend * buffer, c > self.sma(SHORT), c < trend
        elif strategy == "ibs":
            place = (c - self.low) / (self.high - self.low) if self.high > self.low else 0.5
            buy, sell, safe = place < 0.2 and c > trend, place > 0.8 or c > self.prev_high, c < trend
        else:
            buy, safe = self.left <= 5, False
            sell = self.since is not None and month(self.since) != month(self.day) and self.dom >= 3
        if self.since is None:
            return "BUY" if buy else None
        return "SELL" if sell else "SAFETY_EXIT" if safe else None


def month(day: int) -> tuple[int, int]:
    d = date(day)
    return d.year, d.month


def date(day: int) -> datetime.date:
    return datetime.date(1970, 1, 1) + datetime.timedelta(days=day)


def scan_signals(bars: DataFrame, strategies: Sequence[str] = STRATEGIES, every: int | None = None, max_age: int = 2, delay: str = "10 days", bucket_days: int = 32,
                 rsi_entry: float = 10.0, buffer: float = 1.01) -> DataFrame:
    """BUY, SKIP, SELL and SAFETY_EXIT per (strategy, symbol); ``bars`` has symbol, date, high, low, close and days_left (of the month)."""
    rows = _timed(bars, delay).withColumn("strategy", F.explode(F.array(*[F.lit(s) for s in strategies])))
    rows = rows.select("strategy", "symbol", "ts", day_of(F.col("date")).alias("day"), "high", "low", "close", F.col("days_left").cast("long").alias("left"))
    return rows.groupBy("strategy", "symbol").transformWithStateInPandas(
        statefulProcessor=_scanner(every, max_age, bucket_days, rsi_entry, buffer), outputStructType=SIGNALS, outputMode="Append", timeMode="EventTime")


def day_of(d: Column) -> Column:
    return F.unix_date(d.cast("date")).cast("long")


def _scanner(every: int | None, max_age: int, bucket_days: int, rsi_entry: float, buffer: float):
    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    columns = ["day", "high", "low", "close", "left"]

    class Scanner(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.book = handle.getValueState("book", BOOK)
            self.pending = handle.getMapState("pending", "bucket long", "day array<long>, high array<double>, low array<double>, close array<double>, left array<long>")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            first = None
            for r in rows:
                for bucket, part in r.groupby(r["day"] // bucket_days):
                    held = self.waiting(int(bucket))
                    self.pending.updateValue((int(bucket),), tuple([*h, *part[c].tolist()] for h, c in zip(held, columns)))
                low = int(r["day"].min())
                first = low if first is None else min(first, low)
            if first is not None:
                self.handle.registerTimer(first * DAY)
            return iter([])

        def waiting(self, bucket: int) -> list[list]:
            return [list(c) for c in self.pending.getValue((bucket,))] if self.pending.containsKey((bucket,)) else [[] for _ in columns]

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            today = timerValues.getCurrentWatermarkInMs() // DAY
            book = Book(*self.book.get()) if self.book.exists() else Book()
            book.ring = list(book.ring)
            out, later = [], []
            buckets = sorted(k[0] for k in self.pending.keys()) if self.pending.exists() else []
            for bucket in buckets:
                if bucket * bucket_days > today:
                    later.append(bucket * bucket_days)
                    break
                rows = sorted(zip(*self.waiting(bucket)), key=lambda b: b[0])
                due = [b for b in rows if b[0] <= today]
                for b in due:
                    self.scans(key, book, b[0] - 1, out)
                    book.bar(*b)
                    if every is None:
                        self.scan(key, book, b[0], out)
                if len(due) < len(rows):
                    self.pending.updateValue((bucket,), tuple(list(c) for c in zip(*rows[len(due) :])))
                    later.append(rows[len(due)][0])
                    break
                self.pending.removeKey((bucket,))
            self.scans(key, book, today, out)
            self.book.update(astuple(book))
            if every and book.day is not None:
                later.append((today // every + 1) * every)
            if later:
                self.handle.registerTimer(max(today + 1, min(later)) * DAY)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SIGNALS.split(", ")])

        def scans(self, key, book: Book, until: int, out: list) -> None:
            """The scans after the last one up to a day, on the latest bar."""
            if every is None or book.day is None:
                return
            last = book.day - 1 if book.scanned is None else book.scanned
            for day in range((last // every + 1) * every, until + 1, every):
                self.scan(key, book, day, out)
                book.scanned = day

        def scan(self, key, book: Book, day: int, out: list) -> None:
            signal = book.signal(key[0], rsi_entry, buffer)
            if signal is None:
                return
            if signal == "BUY" and day - book.day > max_age:
                signal = "SKIP"
            elif signal == "BUY":
                book.since = book.day
            out.append((key[0], key[1], date(book.day), date(day), signal, None if book.since is None else date(book.since), book.close))
            if signal in ("SELL", "SAFETY_EXIT"):
                book.since = None

        def close(self) -> None:
            pass

    return Scanner()
