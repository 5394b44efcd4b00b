"""Queries that run a streaming job over the given files to its end."""

from __future__ import annotations

import re

from ..sources import store
from ..streaming import jobs as J, scan
from .base import CTES, cte, query, with_

_HOUR = """SELECT event_type AS symbol, date_trunc('hour', ts) AS date, arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low, arg_max(value, event_id) AS close, count(*) AS volume FROM events GROUP BY ALL"""


@query("STM1", f"SELECT * FROM ({_HOUR}) WHERE date + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def stm1(t):
    return J.run_to_table(J.tumbling_bars(J.event_stream(t.spark, t.sf_dir)), "stream-bars")


@query("STM2", "SELECT event_id, ts, event_type, value FROM events")
def stm2(t):
    twice = J.event_stream(t.spark, t.sf_dir).union(J.event_stream(t.spark, t.sf_dir))
    return J.run_to_table(J.without_duplicates(twice).select("event_id", "ts", "event_type", "value"), "stream-events")


@query("STM2_upsert", _HOUR)
def stm2_upsert(t):
    return J.upsert_bars(J.tumbling_bars(J.event_stream(t.spark, t.sf_dir)), "stream-upsert")


def with_state_store(t, build):
    """Run with the state store that stateful processors need; the session setting is put back."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = t.spark.conf.get(key, None)
    t.spark.conf.set(key, J.STATE_PROVIDER)
    try:
        return build()
    finally:
        t.spark.conf.unset(key) if before is None else t.spark.conf.set(key, before)


def bar_files(t, grain="region"):
    bars = t.bars(grain).select("symbol", "date", "high", "low", "close", "days_left")
    return J.bar_stream(t.spark, store.written(bars, "bar-files"), bars.schema)


_STEP = "{'since': %s, 'out': %s}"
_STM3 = with_("bars", body=f"""SELECT * FROM (SELECT symbol, unnest(w.out, recursive := true) FROM (SELECT symbol, list_reduce(list({{'d': date, 'w': (close - low) / (high - low), 'c': close}} ORDER BY date),
   lambda s, c: CASE WHEN s.since IS NULL AND c.w < 0.2 THEN {_STEP % ("c.d", "list_append(s.out, {'date': c.d, 'signal': 'BUY', 'entry_date': c.d, 'close': c.c})")}
     WHEN s.since IS NOT NULL AND c.w > 0.8 THEN {_STEP % ("CAST(NULL AS DATE)", "list_append(s.out, {'date': c.d, 'signal': 'SELL', 'entry_date': s.since, 'close': c.c})")} ELSE {_STEP % ("s.since", "s.out")} END,
   {_STEP % ("CAST(NULL AS DATE)", "CAST([] AS STRUCT(date DATE, signal VARCHAR, entry_date DATE, close DOUBLE)[])")}) AS w FROM bars WHERE high > low GROUP BY symbol)) WHERE date <= (SELECT max(date) - 10 FROM bars)""")


@query("STM3_range", _STM3)
def stm3_range(t):
    return with_state_store(t, lambda: J.run_to_table(J.position_signals(bar_files(t)), "stream-signals"))


_STM4 = """SELECT symbol, date AS last_date FROM (SELECT symbol, date, lead(date) OVER (PARTITION BY symbol ORDER BY date) AS next, max(date) OVER () - 10 AS top FROM bars)
WHERE (next IS NULL OR next > date + 1) AND date + 1 <= top"""


@query("STM4_gaps", with_("bars", body=_STM4))
def stm4_gaps(t):
    return with_state_store(t, lambda: J.run_to_table(J.stale_symbols(bar_files(t), max_days=1), "stream-stale"))


_CHAIN = ("ticks", "bars0", "bars", "trange", "gain2", "loss2", "rsi2", "ind")
for _n in _CHAIN:  # the same bars and indicators with nations as symbols
    _deps, _sql = CTES[_n]
    _sql = re.sub(rf"\b({'|'.join(_CHAIN)})\b(?=[\s,)]|$)", r"nation_\1", _sql) if _n != "ticks" else _sql.replace("r_name", "n_name")
    cte(f"nation_{_n}", _sql, *[f"nation_{d}" for d in _deps])
for _p in ("", "nation_"):
    cte(f"{_p}rules", f"""SELECT v.strategy, symbol, date, close, dom, month,
   CASE v.strategy WHEN 'rsi2' THEN rsi_2 < 25 AND close > sma_200 WHEN 'ibs' THEN coalesce(ibs, 0.5) < 0.2 AND close > sma_200 ELSE days_left <= 5 END AS buy,
   CASE v.strategy WHEN 'rsi2' THEN CASE WHEN close > sma_5 THEN 'SELL' WHEN close < sma_200 THEN 'SAFETY_EXIT' END
     WHEN 'ibs' THEN CASE WHEN coalesce(ibs, 0.5) > 0.8 OR close > p_high THEN 'SELL' WHEN close < sma_200 THEN 'SAFETY_EXIT' END END AS way
  FROM {_p}ind JOIN {_p}rsi2 USING (symbol, bar_ix), (VALUES ('rsi2'), ('ibs'), ('tom')) v(strategy) WHERE bar_ix >= 199""", f"{_p}ind", f"{_p}rsi2")


def scan_sql(prefix: str, every: int | None = None, max_age: int = 2) -> str:
    """The scan as one fold per (strategy, symbol) over its bars, or over its scan days with the latest bar of each."""
    top = f"(SELECT max(date) - 10 FROM {prefix}bars)"
    seen = f"SELECT *, date AS day FROM {prefix}rules"
    if every:
        seen = f"""SELECT r.*, d.day FROM (SELECT strategy, symbol, CAST(unnest(generate_series(min(date), {top}, INTERVAL 1 DAY)) AS DATE) AS day FROM {prefix}rules GROUP BY strategy, symbol) d
    ASOF JOIN {prefix}rules r ON d.strategy = r.strategy AND d.symbol = r.symbol AND d.day >= r.date WHERE (d.day - DATE '1970-01-01') % {every} = 0"""
    none = "CAST(NULL AS DATE)"
    step = lambda since, signal, entry: f"{{'since': {since}, 'out': list_append(s.out, {{'date': c.d, 'scan_date': c.a, 'signal': {signal}, 'entry_date': {entry}, 'close': c.c}})}}"
    return with_(f"{prefix}rules", f"{prefix}bars", body=f"""SELECT * FROM (SELECT strategy, symbol, unnest(w.out, recursive := true) FROM (
  SELECT strategy, symbol, list_reduce(list({{'d': date, 'a': day, 'b': buy, 'x': way, 't': strategy = 'tom' AND dom >= 3, 'm': CAST(month AS DATE), 'c': close, 'old': day - date > {max_age}}} ORDER BY day),
    lambda s, c: CASE WHEN s.since IS NULL AND c.b AND c.old THEN {step(none, "'SKIP'", none)} WHEN s.since IS NULL AND c.b THEN {step("c.d", "'BUY'", "c.d")}
      WHEN s.since IS NOT NULL AND c.t AND CAST(date_trunc('month', s.since) AS DATE) <> c.m THEN {step(none, "'SELL'", "s.since")}
      WHEN s.since IS NOT NULL AND c.x IS NOT NULL THEN {step(none, "c.x", "s.since")} ELSE s END,
    {{'since': {none}, 'out': CAST([] AS STRUCT(date DATE, scan_date DATE, signal VARCHAR, entry_date DATE, close DOUBLE)[])}}) AS w
  FROM ({seen}) GROUP BY strategy, symbol)) WHERE scan_date <= {top}""")


@query("STM3", scan_sql("nation_"))
def stm3(t):
    """Every bar is scanned on its day: the signals of the batch rules for the position the stream holds."""
    return with_state_store(t, lambda: J.run_to_table(scan.scan_signals(bar_files(t, "nation"), rsi_entry=25.0, buffer=1.0), "stream-scan"))


@query("STM4", scan_sql("nation_", 7))
def stm4(t):
    """A weekly scan, with timers: a BUY on a bar older than two days is skipped."""
    return with_state_store(t, lambda: J.run_to_table(scan.scan_signals(bar_files(t, "nation"), every=7, rsi_entry=25.0, buffer=1.0), "stream-weekly"))


@query("STM5", """SELECT symbol, min(ts) AS "start", max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n_events, min(value) AS low, max(value) AS high FROM (
   SELECT *, sum(fresh) OVER (PARTITION BY symbol ORDER BY ts, event_id) AS session FROM (
     SELECT *, event_type AS symbol, CASE WHEN ts < lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events))
  GROUP BY symbol, session HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stm5(t):
    return J.run_to_table(J.activity_sessions(J.event_stream(t.spark, t.sf_dir)), "stream-sessions")
