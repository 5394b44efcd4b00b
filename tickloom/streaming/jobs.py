"""The daily scan as Structured Streaming jobs: bars, upserts, positions, staleness."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import shared_dir
from ..sources import bartable

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Off: rows before a batch's own watermark are late, not those before the last batch's, which depends on whether an empty batch ran between. A job has one operator with state.
ONE_WATERMARK = "spark.sql.streaming.statefulOperator.allowMultiple"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    files = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return files.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_bars(events: DataFrame, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """OHLCV per event type and window; rows later than the watermark are dropped."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.col("event_type").alias("symbol"), F.window("ts", width).alias("w"))
        .agg(F.min_by("value", "event_id").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
             F.max_by("value", "event_id").alias("close"), F.count(F.lit(1)).alias("volume"))
        .select("symbol", F.col("w.start").alias("date"), "open", "high", "low", "close", "volume")
    )


def without_duplicates(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each event id once, remembered as long as the watermark allows duplicates to arrive."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process what is available into a parquet table in the shared folder and read it."""
    spark = stream.sparkSession
    root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(ONE_WATERMARK, None)
    spark.conf.set(ONE_WATERMARK, "false")
    try:
        q = (
            stream.writeStream.format("parquet").outputMode(mode).option("path", f"{root}/out").option("checkpointLocation", f"{root}/progress")
            .trigger(availableNow=True).start()
        )
    finally:
        spark.conf.unset(ONE_WATERMARK) if before is None else spark.conf.set(ONE_WATERMARK, before)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def upsert_bars(stream: DataFrame, name: str) -> DataFrame:
    """Bar updates into a table keyed by (symbol, date); replaying a batch changes nothing.

    A batch rewrites the buckets and months it touches, so readers see one version of each bar and nothing piles up.
    """
    spark = stream.sparkSession
    root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def apply(batch: DataFrame, batch_id: int) -> None:
        bartable.update(batch, f"{root}/table")

    q = stream.writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    return bartable.read(spark, f"{root}/table", stream.schema)


def bar_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Bar files as a stream; without a number of files per trigger, all that are there make one batch."""
    files = spark.readStream.schema(schema)
    return (files.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else files).parquet(path)


def _timed(bars: DataFrame, delay: str) -> DataFrame:
    """Bars with their event time, as a timestamp under a watermark and in milliseconds (``at``)."""
    return bars.withColumn("ts", F.col("date").cast("timestamp")).withColumn("at", F.unix_millis("ts")).withWatermark("ts", delay)


def position_signals(bars: DataFrame, entry: float = 0.2, exit_: float = 0.8, delay: str = "10 days") -> DataFrame:
    """Flat -> open -> closed per symbol; emits BUY and SELL once the watermark has passed the bar.

    State per key: the bars the watermark has not reached, and since when a position is open. A timer takes the
    bars up to the watermark in date order, so files and batches may bring them in any order within the delay.
    """
    return _timed(bars, delay).groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=_lifecycle(entry, exit_), outputStructType="symbol string, date date, signal string, entry_date date, close double",
        outputMode="Append", timeMode="EventTime",
    )


def _held(pending, watermark: int) -> tuple[list[tuple], list[tuple]]:
    """Held rows (at first) up to the watermark, in order, and those beyond it."""
    rows = sorted(pending.get()) if pending.exists() else []
    cut = next((i for i, r in enumerate(rows) if r[0] > watermark), len(rows))
    return rows[:cut], rows[cut:]


def _lifecycle(entry: float, exit_: float):
    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    class Lifecycle(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.position = handle.getValueState("position", "since date")
            self.pending = handle.getListState("pending", "at long, date date, place double, close double")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            first = None
            for r in rows:
                r = r[r["high"] > r["low"]]
                if len(r):
                    place = (r["close"] - r["low"]) / (r["high"] - r["low"])
                    self.pending.appendList(list(zip(r["at"].tolist(), r["date"], place.tolist(), r["close"].tolist())))
                    first = min(int(r["at"].min()), first if first is not None else int(r["at"].min()))
            if first is not None:
                self.handle.registerTimer(first)
            return iter([])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            due, later = _held(self.pending, timerValues.getCurrentWatermarkInMs())
            since = self.position.get()[0] if self.position.exists() else None
            out = []
            for _, day, place, close in due:
                if since is None and place < entry:
                    since = day
                    out.append((key[0], day, "BUY", day, close))
                elif since is not None and place > exit_:
                    out.append((key[0], day, "SELL", since, close))
                    since = None
            _put(self.position, None if since is None else (since,))
            _put(self.pending, later)
            if later:
                self.handle.registerTimer(later[0][0])
            yield pd.DataFrame(out, columns=["symbol", "date", "signal", "entry_date", "close"])

        def close(self) -> None:
            pass

    return Lifecycle()


def _put(state, value) -> None:
    """Replace a state, or remove it if there is nothing to keep."""
    if not value:
        state.clear()
    elif isinstance(value, list):
        state.put(value)
    else:
        state.update(value)


def stale_symbols(bars: DataFrame, max_days: int = 2, delay: str = "10 days") -> DataFrame:
    """Each bar after which its symbol had no other for ``max_days`` days of 24 hours, once the watermark has passed them.

    Event-time timers per symbol; bars are taken in date order as in ``position_signals``, so what is emitted
    does not depend on how they are spread over files and batches within the delay.
    """
    return _timed(bars, delay).groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=_staleness(max_days), outputStructType="symbol string, last_date date", outputMode="Append", timeMode="EventTime")


def _staleness(max_days: int):
    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    wait = max_days * 86_400_000

    class Staleness(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.last = handle.getValueState("last", "at long, date date, told boolean")
            self.pending = handle.getListState("pending", "at long, date date")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            first = None
            for r in rows:
                self.pending.appendList(list(zip(r["at"].tolist(), r["date"])))
                first = min(int(r["at"].min()), first if first is not None else int(r["at"].min()))
            if first is not None:
                self.handle.registerTimer(first)
            return iter([])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            watermark = timerValues.getCurrentWatermarkInMs()
            due, later = _held(self.pending, watermark)
            at, day, told = self.last.get() if self.last.exists() else (None, None, True)
            out = []
            for next_at, next_day in due:
                if not told and next_at > at + wait:
                    out.append((key[0], day))
                at, day, told = next_at, next_day, False
            if not told and at + wait <= watermark:
                out.append((key[0], day))
                told = True
            if at is not None:
                self.last.update((at, day, told))
            _put(self.pending, later)
            if later:
                self.handle.registerTimer(later[0][0])
            if not told:
                self.handle.registerTimer(at + wait)
            yield pd.DataFrame(out, columns=["symbol", "last_date"])

        def close(self) -> None:
            pass

    return Staleness()


def activity_sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Stretches of activity per event type: events less than ``gap`` apart belong together, and a session ends ``gap`` after its last event.

    Sessions are merged in the state store as events arrive; one is emitted once the watermark has passed its end, and later rows are dropped.
    """
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.col("event_type").alias("symbol"), F.session_window("ts", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("n_events"), F.min("value").alias("low"), F.max("value").alias("high"))
        .select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events", "low", "high")
    )
