"""Queries on rules, scalar functions and trade ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import equity as E
from ..operators import blocks as K
from ..operators.indicators import home_rows
from ..operators.ledger import candidates, first_of, frame_for, ledger, pair, variant, with_mark
from ..operators.rules import DONCHIAN, IBS, IBS_TOM, LONG, RSI2, RULES, SHORT, TOM
from ..presets import FEE_FIELDS, FEES
from .base import ACCOUNT, AS_OF, MID, SPLIT, STRICT, cte, ibs_ctes, query, walk_cte, with_

TRADE_DIGITS = {"entry_price": 6, "exit_price": 6, "quantity": 6, "pnl": 4, "return_pct": 8, "capital_after": 4}


def flags(t, rule, params, sides=(LONG, SHORT)):
    """Per bar: does a side enter, and which exit would fire."""
    f = home_rows(frame_for(t.bars(), rule, [params]))
    cols = []
    for side, tag in zip((LONG, SHORT), ("long", "short")):
        if side in sides:
            cols.append(F.coalesce(rule.entry(params, side), F.lit(False)).alias(f"enter_{tag}"))
            if rule.exits:
                cols.append(first_of(rule.exits(params, side), F.col("bar_ix"), F.col("date"))["reason"].alias(f"exit_{tag}"))
    return f.select("symbol", "bar_ix", *cols)


@query("STR1", with_("ind", "rsi2", body="""SELECT symbol, bar_ix, coalesce(r1 < 20 AND p_close > p_sma_200 * 1.0, false) AS enter_long,
  CASE WHEN close > sma_5 THEN 'sma_exit' WHEN rsi_2 > 70 THEN 'rsi_exit' WHEN close < sma_200 THEN 'trend_break' END AS exit_long,
  coalesce(r1 > 80 AND p_close < p_sma_200 / 1.0, false) AS enter_short,
  CASE WHEN close < sma_5 THEN 'sma_exit' WHEN rsi_2 < 30 THEN 'rsi_exit' WHEN close > sma_200 THEN 'trend_break' END AS exit_short
  FROM (SELECT i.*, r.rsi_2, lag(r.rsi_2) OVER (PARTITION BY symbol ORDER BY bar_ix) AS r1 FROM ind i LEFT JOIN rsi2 r USING (symbol, bar_ix))"""))
def str1(t):
    return flags(t, RSI2, RSI2.params(rsi_entry_threshold=20, sma_trend_buffer=1.0, rsi_exit_threshold=70.0))


@query("STR2", with_("ind", body="""SELECT symbol, bar_ix, coalesce(p_ibs < 0.2 AND p_close > p_sma_200, false) AS enter_long,
  CASE WHEN ibs > 0.8 THEN 'ibs_exit' WHEN close > p_high THEN 'prev_high_exit' WHEN close < sma_200 THEN 'trend_break' END AS exit_long,
  coalesce(p_ibs > 1.0 - CAST(0.2 AS DOUBLE) AND p_close < p_sma_200, false) AS enter_short,
  CASE WHEN ibs < 1.0 - CAST(0.8 AS DOUBLE) THEN 'ibs_exit' WHEN close < p_low THEN 'prev_low_exit' WHEN close > sma_200 THEN 'trend_break' END AS exit_short FROM ind"""))
def str2(t):
    return flags(t, IBS, IBS.params())


def ahead_cands(name: str, enter: str, hit: str, reason: str, hold: int = 10) -> str:
    """Candidates whose exit is the first bar within ``hold`` that satisfies a condition on the pair."""
    cte(f"{name}_hit", f"""SELECT e.symbol, e.bar_ix AS eix, min(b.bar_ix) AS xix FROM ind e JOIN ind b ON b.symbol = e.symbol
      AND b.bar_ix BETWEEN e.bar_ix AND e.bar_ix + {hold} WHERE {enter} AND ({hit}) GROUP BY ALL""", "ind")
    cte(name, f"""SELECT e.symbol, e.bar_ix AS entry_ix, e.date AS entry_date, e.open AS entry_open, 1 AS direction, b.bar_ix AS exit_ix, b.date AS exit_date,
      b.close AS exit_raw, {reason} AS exit_reason, false AS exit_slip, m.mark_ix, m.mark_price
      FROM ind e LEFT JOIN {name}_hit h ON h.symbol = e.symbol AND h.eix = e.bar_ix LEFT JOIN ind b ON b.symbol = e.symbol AND b.bar_ix = h.xix
      JOIN last_bar m ON m.symbol = e.symbol WHERE {enter}""", f"{name}_hit", "ind", "last_bar")
    return name


_NEWM = "(b.month <> e.month)"
ahead_cands("tom_cand", "e.p_left <= 5 AND e.bar_ix >= 30", f"b.bar_ix - e.bar_ix >= 10 OR ({_NEWM} AND b.dom >= 3)",
            "CASE WHEN b.bar_ix IS NULL THEN NULL WHEN b.bar_ix - e.bar_ix >= 10 THEN 'max_holding_exit' ELSE 'tom_exit' END")
ahead_cands("itom_cand", "e.p_left <= 6 AND e.p_ibs < 0.25 AND e.p_close > e.p_sma_100 AND e.bar_ix >= 110",
            f"b.bar_ix - e.bar_ix >= 10 OR ({_NEWM} AND b.dom >= 3) OR ({_NEWM} AND b.ibs > 0.8)",
            f"CASE WHEN b.bar_ix IS NULL THEN NULL WHEN b.bar_ix - e.bar_ix >= 10 THEN 'max_holding_exit' WHEN {_NEWM} AND b.dom >= 3 THEN 'tom_exit' ELSE 'ibs_early_exit' END")
_FX = FEES["forex_saxo"]
walk_cte("tom_tr", "tom_cand", 100000.0, 1.0, 0.0003, _FX, False)
walk_cte("itom_tr", "itom_cand", 100000.0, 1.0, 0.0003, _FX, False)
_TCOLS = "symbol, direction, entry_ix, entry_date, exit_ix, exit_date, entry_price, exit_price, quantity, pnl, return_pct, holding_days, exit_reason, capital_after, closed"
ITOM = IBS_TOM.params(entry_days_before_eom=6, ibs_entry_threshold=0.25, sma_trend_period=100)


def trades_out(df):
    return df.filter("status IN ('closed', 'open')").select(*[c.strip() for c in _TCOLS.split(",")])


@query("STR3", with_("tom_tr", body=f"SELECT {_TCOLS} FROM tom_tr"), round=TRADE_DIGITS)
def str3(t):
    return trades_out(ledger(t.bars(), TOM, account=ACCOUNT))


@query("STR4", with_("itom_tr", body=f"SELECT {_TCOLS} FROM itom_tr"), round=TRADE_DIGITS)
def str4(t):
    return trades_out(ledger(t.bars(), IBS_TOM, [ITOM], ACCOUNT))


cte("trend", """SELECT b.*, lag(b.close) OVER s AS p_close, lag(a.adx) OVER s AS p_adx, lag(r.y) OVER s AS p_atr, lag(h20) OVER s AS p_h20, lag(h50) OVER s AS p_h50, lag(h80) OVER s AS p_h80, lag(l20) OVER s AS p_l20,
   lag(h10) OVER s AS p_h10, lag(l10) OVER s AS p_l10, lag(f.y) OVER s AS f1, lag(f.y, 2) OVER s AS f2, lag(g.y) OVER s AS s1, lag(g.y, 2) OVER s AS s2
  FROM (SELECT *, CASE WHEN bar_ix >= 50 THEN max(high) OVER (PARTITION BY symbol ORDER BY bar_ix ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) END AS h50,
          CASE WHEN bar_ix >= 80 THEN max(high) OVER (PARTITION BY symbol ORDER BY bar_ix ROWS BETWEEN 80 PRECEDING AND 1 PRECEDING) END AS h80,
          CASE WHEN bar_ix >= 20 THEN max(high) OVER (PARTITION BY symbol ORDER BY bar_ix ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS h20,
          CASE WHEN bar_ix >= 20 THEN min(low) OVER (PARTITION BY symbol ORDER BY bar_ix ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS l20,
          CASE WHEN bar_ix >= 10 THEN max(high) OVER (PARTITION BY symbol ORDER BY bar_ix ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) END AS h10,
          CASE WHEN bar_ix >= 10 THEN min(low) OVER (PARTITION BY symbol ORDER BY bar_ix ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) END AS l10 FROM bars) b
  LEFT JOIN adx14 a USING (symbol, bar_ix) LEFT JOIN atr14 r USING (symbol, bar_ix) LEFT JOIN ema9 f USING (symbol, bar_ix) LEFT JOIN ema50 g USING (symbol, bar_ix)
  WINDOW s AS (PARTITION BY b.symbol ORDER BY b.bar_ix)""", "bars", "adx14", "atr14", "ema9", "ema50")


@query("STR5", with_("trend", body="""SELECT symbol, bar_ix, coalesce(p_close > p_h20 AND p_adx >= 10, false) AS breakout_long, coalesce(p_close < p_l20 AND p_adx >= 10, false) AS breakout_short,
  coalesce(f1 > s1 AND f2 <= s2, false) AS cross_long, coalesce(f1 < s1 AND f2 >= s2, false) AS cross_short FROM trend"""))
def str5(t):
    a = DONCHIAN.params(donchian_entry_period=20, adx_threshold=10)
    b = DONCHIAN.params(entry_mode="ema_cross", adx_threshold=0)
    f = home_rows(frame_for(t.bars(), DONCHIAN, [a, b]))
    pick = lambda p, side: F.coalesce(DONCHIAN.entry(p, side), F.lit(False))
    return f.select("symbol", "bar_ix", pick(a, LONG).alias("breakout_long"), pick(a, SHORT).alias("breakout_short"),
                    pick(b, LONG).alias("cross_long"), pick(b, SHORT).alias("cross_short"))


def trend_machine(name: str, enter: str, warm: int, mode: str, stop: float, mult: float, slip: float, cool: int, legacy: bool = False,
                  chan: str = "NULL", back: str = "false") -> str:
    """Bar-by-bar state machine (long side) as a fold over each symbol's bars: the plain statement of the trend exits."""
    trail = mode == "trailing" if legacy else mode in ("trailing", "channel")
    price = f"(c.o * (1 + CAST({slip} AS DOUBLE)))"
    pos0 = {"e": "c.i", "p": price, "sl": f"{price} * (1 - CAST({stop / 100} AS DOUBLE))", "h": price,
            "l": f"CASE WHEN {str(trail).lower()} AND c.a > 0 THEN {price} - c.a * {mult} ELSE 0.0 END"}
    # position seen by this bar: the running one, or a fresh one
    fresh = "(s.e < 0 AND s.cool = 0 AND c.ent)"
    e, p, sl, h, l = (f"(CASE WHEN s.e >= 0 THEN s.{k} ELSE {v} END)" for k, v in pos0.items())
    later = "(s.e >= 0)"
    up = f"({str(trail).lower()} AND c.a > 0 AND {later} AND c.h > {h})"
    h2, l2 = f"(CASE WHEN {up} THEN c.h ELSE {h} END)", f"(CASE WHEN {up} THEN c.h - c.a * {mult} ELSE {l} END)"
    gap_sl, hard = f"({later} AND c.o <= {sl})", f"(c.l <= {sl})"
    gap_tr, soft = f"({l} > 0 AND c.o <= {l})", f"({later} AND {l2} > 0 AND c.l <= {l2})"
    ch, rev = f"({later} AND c.c < c.ch)", "(c.bk)"
    k = f"(1 - CAST({slip} AS DOUBLE))"
    steps = [(gap_sl, "c.o", "gap_sl"), (hard, f"{sl} * {k}", "intraday_sl"), (gap_tr, "c.o", "gap_trailing"), (soft, f"{l2} * {k}", "trailing")]
    if legacy:
        steps = [steps[0], steps[2], steps[1], steps[3]]
    if mode == "channel":
        steps.append((ch, "c.c", "channel"))
    if mode == "signal":
        steps.append((rev, f"c.o * {k}", "signal_reverse"))
    hit = " OR ".join(f"coalesce({x[0]}, false)" for x in steps)
    xp = "CASE " + " ".join(f"WHEN {x[0]} THEN {x[1]}" for x in steps) + " END"
    xr = "CASE " + " ".join(f"WHEN {x[0]} THEN '{x[2]}'" for x in steps) + " END"
    st = "{'e': %s, 'p': %s, 'sl': %s, 'h': %s, 'l': %s, 'cool': %s, 'out': %s}"
    idle = st % ("s.e", "s.p", "s.sl", "s.h", "s.l", "greatest(s.cool - 1, 0)", "s.out")
    done = st % ("CAST(-1 AS BIGINT)", "s.p", "s.sl", "s.h", "s.l", f"CAST({cool} AS BIGINT)",
                 f"list_append(s.out, {{'entry_ix': {e}, 'entry_price': {p}, 'exit_ix': c.i, 'exit_price': {xp}, 'exit_reason': {xr}}})")
    hold = st % (e, p, sl, h2, l2, "s.cool", "s.out")
    zero = "CAST(0 AS DOUBLE)"
    init = st % ("CAST(-1 AS BIGINT)", zero, zero, zero, zero, "CAST(0 AS BIGINT)",
                 "CAST([] AS STRUCT(entry_ix BIGINT, entry_price DOUBLE, exit_ix BIGINT, exit_price DOUBLE, exit_reason VARCHAR)[])")
    cte(f"{name}_m", f"""SELECT symbol, list_reduce(list({{'i': bar_ix, 'o': open, 'h': high, 'l': low, 'c': close, 'a': coalesce(p_atr, 0.0), 'ent': coalesce({enter}, false),
        'ch': {chan}, 'bk': coalesce({back}, false)}} ORDER BY bar_ix),
      lambda s, c: CASE WHEN s.e < 0 AND NOT {fresh} THEN {idle} WHEN {hit} THEN {done} ELSE {hold} END, {init}) AS w FROM trend WHERE bar_ix >= {warm} GROUP BY symbol""", "trend")
    cte(name, f"SELECT symbol, unnest(w.out, recursive := true) FROM {name}_m", f"{name}_m")
    return with_(name, body=f"SELECT * FROM {name}")


TREND = DONCHIAN.params(donchian_entry_period=20, donchian_exit_period=10, adx_threshold=0, trailing_atr_mult=1.0, sl_percent=6.0, cooldown_candles=3)
_TREND_OUT = ["symbol", "entry_ix", "entry_price", "exit_ix", "exit_price", "exit_reason"]
_TREND_DIGITS = {"entry_price": 6, "exit_price": 6}


def trend_trades(t, params, legacy=False):
    return ledger(t.bars(), DONCHIAN, [params], ACCOUNT, legacy=legacy).filter("closed").select(*_TREND_OUT)


@query("STR6", trend_machine("tm_chan", "p_close > p_h20", 30, "channel", 6.0, 2.0, 0.0003, 3, chan="p_l10"), round=_TREND_DIGITS)
def str6(t):
    return trend_trades(t, {**TREND, "exit_mode": "channel", "trailing_atr_mult": 2.0})


@query("LED4", trend_machine("tm_trail", "p_close > p_h20", 30, "trailing", 6.0, 1.0, 0.0003, 3), round=_TREND_DIGITS)
def led4(t):
    return trend_trades(t, TREND)


@query("LED9", trend_machine("tm_old", "p_close > p_h20", 30, "trailing", 6.0, 1.0, 0.0003, 3, legacy=True), round=_TREND_DIGITS)
def led9(t):
    return trend_trades(t, TREND, legacy=True)


@query("STR6_signal", trend_machine("tm_sig", "f1 > s1 AND f2 <= s2", 52, "signal", 6.0, 2.0, 0.0003, 3, back="f1 < s1 AND f2 >= s2"), round=_TREND_DIGITS)
def str6_signal(t):
    return trend_trades(t, {**TREND, "entry_mode": "ema_cross", "exit_mode": "signal", "position_fraction": 0.01})


@query("STR7", with_("bars", body=f"""SELECT symbol, k AS strategy, w AS warmup, count(*) FILTER (bar_ix >= w) AS n_usable FROM bars, (VALUES {', '.join(f"('{k}', {w})" for k, w in [("rsi2", 210), ("ibs", 210), ("tom", 30), ("ibs_tom", 210), ("donchian", 52)])}) v(k, w) GROUP BY ALL"""), ints=("warmup",))
def str7(t):
    b = t.bars().groupBy("symbol").agg(*[F.count_if(F.col("bar_ix") >= r.warmup(r.params())).alias(k) for k, r in RULES.items()])
    long = b.unpivot(["symbol"], list(RULES), "strategy", "n_usable")
    w = F.create_map(*[F.lit(x) for k, r in RULES.items() for x in (k, r.warmup(r.params()))])
    return long.withColumn("warmup", w[F.col("strategy")])


def _grid_values(g):
    return ", ".join("(" + ", ".join(str(v) for v in row) + ")" for row in g)


@query("STR8", with_("bars", body=f"""SELECT b.symbol, a.v AS rsi_entry_threshold, s.v AS sma_trend_period, x.v AS sma_exit_period, count(*) FILTER (b.bar_ix >= greatest(s.v, x.v) + 10) AS n_usable
  FROM bars b, (VALUES (5), (10), (15), (20)) a(v), (VALUES (150), (200), (250)) s(v), (VALUES (3), (5), (7), (10)) x(v) GROUP BY ALL"""), ints=("rsi_entry_threshold", "sma_trend_period", "sma_exit_period"))
def str8(t):
    combos = RSI2.combos()
    n = t.bars().groupBy("symbol").agg(*[F.count_if(F.col("bar_ix") >= w).alias(f"w{w}") for w in sorted({RSI2.warmup(p) for p in combos})])
    rows = [F.struct(F.lit(p["rsi_entry_threshold"]).alias("rsi_entry_threshold"), F.lit(p["sma_trend_period"]).alias("sma_trend_period"),
                     F.lit(p["sma_exit_period"]).alias("sma_exit_period"), F.col(f"w{RSI2.warmup(p)}").alias("n_usable")) for p in combos]
    return n.select("symbol", F.inline(F.array(*rows)))


@query("STR9", trend_machine("tm_def", "p_close > p_h20 AND p_adx >= 10", 30, "trailing", 10.0, 4.0, 0.0003, 3), round=_TREND_DIGITS)
def str9(t):
    return trend_trades(t, DONCHIAN.params(donchian_entry_period=20, adx_threshold=10))


@query("STR9_legacy", trend_machine("tm_leg", "p_close > p_h50 AND p_adx >= 20", DONCHIAN.warmup(DONCHIAN.params()), "trailing", 10.0, 4.0, 0.0003, 3, legacy=True), round=_TREND_DIGITS)
def str9_legacy(t):
    return trend_trades(t, DONCHIAN.params(), legacy=True)


_CALENDAR_RUNS, _TREND_RUNS = [], []
for _i, _p in enumerate(TOM.combos()):
    ahead_cands(f"tomg{_i}_c", f"e.p_left <= {_p['entry_days_before_eom']} AND e.bar_ix >= {TOM.warmup(_p)}", f"b.bar_ix - e.bar_ix >= 10 OR ({_NEWM} AND b.dom >= {_p['exit_day_of_new_month']})", "'x'")
    walk_cte(f"tomg{_i}", f"tomg{_i}_c", 100000.0, 1.0, 0.0003, _FX, False)
    _CALENDAR_RUNS.append(("tom", _i, f"tomg{_i}"))
for _i, _p in enumerate(IBS_TOM.combos()):
    ahead_cands(f"itomg{_i}_c", f"e.p_left <= {_p['entry_days_before_eom']} AND e.p_ibs < {_p['ibs_entry_threshold']} AND e.p_close > e.p_sma_200 AND e.bar_ix >= {IBS_TOM.warmup(_p)}",
                f"b.bar_ix - e.bar_ix >= 10 OR ({_NEWM} AND b.dom >= {_p['exit_day_of_new_month']}) OR ({_NEWM} AND b.ibs > 0.8)", "'x'")
    walk_cte(f"itomg{_i}", f"itomg{_i}_c", 100000.0, 1.0, 0.0003, _FX, False)
    _CALENDAR_RUNS.append(("ibs_tom", _i, f"itomg{_i}"))
for _i, _p in enumerate(DONCHIAN.combos()):
    trend_machine(f"tmg{_i}", f"p_close > p_h{_p['donchian_entry_period']} AND p_adx >= {_p['adx_threshold']}", DONCHIAN.warmup(_p), "trailing", _p["sl_percent"], _p["trailing_atr_mult"], 0.0003, _p["cooldown_candles"])
    _TREND_RUNS.append(("donchian", _i, f"tmg{_i}"))


def grid_runs(t, rules):
    """Trades of every combination of the grids, counted by exit and holding time."""
    out = None
    for r in rules:
        g = ledger(t.bars(), r, r.combos(), ACCOUNT).filter("closed").groupBy(F.lit(r.key).alias("rule"), "combo_id", "symbol").agg(
            F.count(F.lit(1)).alias("n_trades"), F.sum(F.col("exit_ix") - F.col("entry_ix")).alias("days"), F.sum(F.col("exit_price") - F.col("entry_price")).alias("points"))
        out = g if out is None else out.unionByName(g)
    return out


def grid_sql(runs, closed="WHERE closed"):
    one = "SELECT '{}' AS rule, CAST({} AS BIGINT) AS combo_id, symbol, count(*) AS n_trades, CAST(sum(exit_ix - entry_ix) AS BIGINT) AS days, sum(exit_price - entry_price) AS points FROM {} {} GROUP BY symbol"
    return with_(*[n for _, _, n in runs], body=" UNION ALL ".join(one.format(r, i, n, closed) for r, i, n in runs))


@query("STR8_calendar", grid_sql(_CALENDAR_RUNS), round={"points": 4})
def str8_calendar(t):
    return grid_runs(t, [TOM, IBS_TOM])


@query("STR8_trend", grid_sql(_TREND_RUNS, ""), round={"points": 4})
def str8_trend(t):
    return grid_runs(t, [DONCHIAN])


ibs_ctes("own", thr=0.3, xthr=0.6, sma=100, where="true")


@query("STR10", with_("own", body="SELECT symbol, entry_ix, exit_ix, exit_reason FROM own WHERE closed"))
def str10(t):
    """A rule a user writes: the stock range-position rule with its own exits and warm-up."""
    from dataclasses import replace

    from ..operators.rules import Exit, lag

    def exits(p, side):
        c = F.col("close")
        return [Exit(F.col("ibs") > 0.6, c, "ibs_exit"), Exit(c > lag("high"), c, "prev_high_exit"), Exit(c < F.col("sma_100"), c, "trend_break")]

    own = replace(IBS, key="own", warmup=lambda p: p["sma_trend_period"] + 10, exits=exits,
                  entry=lambda p, side: (lag("ibs") < 0.3) & (lag("close") > lag("sma_100")))
    got = ledger(t.bars(), own, [own.params(sma_trend_period=100)], ACCOUNT)
    return got.filter("closed").select("symbol", "entry_ix", "exit_ix", "exit_reason")


# ---------------------------------------------------------------- scalar functions on trades and bars

_F = {k: dict(zip(FEE_FIELDS, v)) for k, v in FEES.items()}
_FV = ", ".join(f"('{k}', " + ", ".join(f"CAST({x!r} AS DOUBLE)" for x in v) + ")" for k, v in FEES.items())
cte("fees", f"SELECT * FROM (VALUES {_FV}) v(fee, {', '.join(FEE_FIELDS)})")
_N = "t.quantity * t.entry_price"


def with_fees(t, trades):
    """Trades once per fee schedule; the schedule table has one row per preset."""
    rows = [F.struct(F.lit(k).alias("fee"), *[F.lit(v).alias(f) for f, v in fee.items()]) for k, fee in _F.items()]
    return trades.select("*", F.inline(F.array(*rows)))


@query("SCA1", with_("tr", "fees", body=f"SELECT symbol, entry_ix, fee, commission_per_trade + {_N} * commission_pct + {_N} * spread_pct / 2 + {_N} * fx_conversion_pct + {_N} * tax_pct AS cost FROM tr t, fees"), round={"cost": 4})
def sca1(t):
    n = F.col("quantity") * F.col("entry_price")
    return with_fees(t, t.ibs_trades()).select("symbol", "entry_ix", "fee", S.entry_cost(n, S.fee_columns()).alias("cost"))


_X = "t.quantity * t.exit_price"


@query("SCA2", with_("tr", "fees", body=f"SELECT symbol, entry_ix, fee, commission_per_trade + {_X} * commission_pct + {_X} * spread_pct / 2 + {_X} * fx_conversion_pct AS cost FROM tr t, fees"), round={"cost": 4})
def sca2(t):
    n = F.col("quantity") * F.col("exit_price")
    return with_fees(t, t.ibs_trades()).select("symbol", "entry_ix", "fee", S.exit_cost(n, S.fee_columns()).alias("cost"))


@query("SCA3", with_("tr", body=f"SELECT symbol, entry_ix, {_N} * 0.0002 * holding_days AS cost FROM tr t"), round={"cost": 4})
def sca3(t):
    fee = {**S.fee_literals("zero"), "overnight_daily_pct": F.lit(0.0002)}
    return t.ibs_trades().select("symbol", "entry_ix", S.overnight_cost(F.col("quantity") * F.col("entry_price"), F.col("holding_days"), fee).alias("cost"))


@query("SCA4", with_("tr", body=f"""SELECT symbol, entry_ix, d AS direction, d * (exit_price - entry_price) * quantity - (10 + {_N} * (0.001 + 0.0005 + 0.003)) - (10 + {_X} * (0.001 + 0.0005)) AS pnl
  FROM tr t, (VALUES (1), (-1)) v(d)"""), round={"pnl": 4}, ints=("direction",))
def sca4(t):
    tr = t.ibs_trades().drop("direction").withColumn("direction", F.explode(F.array(F.lit(1), F.lit(-1))))
    pnl = S.net_pnl(F.col("direction"), F.col("entry_price"), F.col("exit_price"), F.col("quantity"), F.col("holding_days"), S.fee_literals("eu_stocks"))
    return tr.select("symbol", "entry_ix", "direction", pnl.alias("pnl"))


@query("SCA5", with_("bars", body="SELECT symbol, bar_ix, d AS direction, open * (1 + d * 0.0003) AS buy, close * (1 - d * 0.0003) AS sell FROM bars, (VALUES (1), (-1)) v(d)"), round={"buy": 6, "sell": 6}, ints=("direction",))
def sca5(t):
    b = t.bars().withColumn("direction", F.explode(F.array(F.lit(1), F.lit(-1))))
    d = F.col("direction")
    return b.select("symbol", "bar_ix", "direction", S.entry_fill(F.col("open"), d, 0.0003).alias("buy"), S.exit_fill(F.col("close"), d, 0.0003).alias("sell"))


@query("SCA6", with_("bars", body="SELECT symbol, bar_ix, CASE WHEN floor(cash / open) >= 1 THEN floor(cash / open) END AS shares FROM (SELECT *, CASE WHEN bar_ix % 3 = 0 THEN 500.0 ELSE 5000.0 END AS cash FROM bars)"), round={"shares": 0})
def sca6(t):
    cash = F.when(F.col("bar_ix") % 3 == 0, F.lit(500.0)).otherwise(F.lit(5000.0))
    return t.bars().select("symbol", "bar_ix", S.whole_quantity(cash, F.col("open")).alias("shares"))


@query("SCA7", with_("bars", body="""SELECT symbol, CASE WHEN a > 0 AND b > 0 AND y > 0 THEN (pow(b / a, 1 / y) - 1) * 100 ELSE 0 END AS cagr_pct FROM
  (SELECT symbol, arg_min(close, date) AS a, arg_max(close, date) AS b, (max(date) - min(date)) / 365.25 AS y FROM bars GROUP BY symbol)"""), round={"cagr_pct": 6})
def sca7(t):
    g = t.bars().groupBy("symbol").agg(F.min_by("close", "date").alias("a"), F.max_by("close", "date").alias("b"), (F.date_diff(F.max("date"), F.min("date")) / 365.25).alias("y"))
    return g.select("symbol", S.cagr(F.col("a"), F.col("b"), F.col("y")).alias("cagr_pct"))


def simpson(f: str, hi: str, n: int = 2000) -> str:
    """Numeric integral of ``f`` (in x) from 0 to ``hi`` by Simpson's rule."""
    body = f.replace("{x}", f"(i * ({hi}) / {n}.0)")
    w = f"(CASE WHEN i = 0 OR i = {n} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    return f"(list_sum(list_transform(range(0, {n + 1}), lambda i: {w} * {body})) * ({hi}) / {n}.0 / 3)"


def tail_sql(t: str, nu: str) -> str:
    const = f"exp(lgamma((({nu}) + 1) / 2.0) - lgamma(({nu}) / 2.0)) / sqrt(({nu}) * pi())"
    return f"(0.5 - {const} * {simpson(f'pow(1 + {{x}} * {{x}} / ({nu}), -(({nu}) + 1) / 2.0)', t)})"


def cdf_sql(x: str) -> str:
    return f"(CASE WHEN {x} > 8 THEN 1.0 WHEN {x} < -8 THEN 0.0 ELSE 0.5 + {simpson('exp(-{x} * {x} / 2)', x)} / sqrt(2 * pi()) END)"


@query("SCA8", with_("tr", body=f"SELECT symbol, entry_ix, {cdf_sql('(return_pct * 100)')} AS p FROM tr"), round={"p": 8})
def sca8(t):
    return t.ibs_trades().select("symbol", "entry_ix", S.normal_cdf(F.col("return_pct") * 100).alias("p"))


@query("SCA9", with_("tr", body=f"SELECT symbol, entry_ix, {tail_sql('(abs(return_pct) * 100)', '(holding_days + 1)')} AS p FROM tr"), round={"p": 8})
def sca9(t):
    return t.ibs_trades().select("symbol", "entry_ix", S.student_tail(F.abs(F.col("return_pct")) * 100, F.col("holding_days") + 1).alias("p"))


@query("SCA10", with_("tr", body="""SELECT symbol, n AS n_trials, CASE WHEN n <= 1 THEN 0 ELSE sqrt(2 * ln(n)) - (ln(pi()) + 0.5772156649) / (2 * sqrt(2 * ln(n))) END AS value
  FROM (SELECT symbol, count(*) AS n FROM tr GROUP BY symbol)"""), round={"value": 8})
def sca10(t):
    g = t.ibs_trades().groupBy("symbol").agg(F.count(F.lit(1)).alias("n_trials"))
    return g.select("symbol", "n_trials", S.expected_max_sharpe(F.col("n_trials")).alias("value"))


def prox_sql(v: str, thr: str, zone: str) -> str:
    return f"round_even(CASE WHEN {v} <= {thr} THEN 100 WHEN {v} >= {zone} THEN 0 ELSE ({zone} - {v}) / ({zone} - {thr}) * 100 END, 1)"


@query("SCA11", with_("ind", body=f"""SELECT symbol, bar_ix, {prox_sql('ibs', '0.2', '0.4')} AS ibs_pct, coalesce(ibs < 0.4 AND ibs > 0.2 AND close > sma_200, false) AS ibs_near, 'IBS=' || printf('%.3f', round(ibs, 3)) AS ibs_label,
  round_even(CASE WHEN days_left <= 5 THEN 100 WHEN days_left > 8 THEN 0 ELSE (8 - days_left) / 3.0 * 100 END, 1) AS tom_pct, days_left <= 8 AND days_left > 5 AS tom_near, days_left || 'd left' AS tom_label
  FROM ind WHERE ibs IS NOT NULL AND sma_200 IS NOT NULL"""), round={"ibs_pct": 1, "tom_pct": 1})
def sca11(t):
    from ..operators.indicators import Needs, indicator_frame

    f = home_rows(indicator_frame(t.bars(), Needs(sma={200}))).filter("ibs IS NOT NULL AND sma_200 IS NOT NULL")
    ibs, left, ok = F.col("ibs"), F.col("days_left"), F.col("close") > F.col("sma_200")
    tom = F.bround(F.when(left <= 5, F.lit(100.0)).when(left > 8, F.lit(0.0)).otherwise((8 - left) / 3.0 * 100), 1)
    return f.select(
        "symbol", "bar_ix", S.proximity_pct(ibs, F.lit(0.2), F.lit(0.4)).alias("ibs_pct"),
        F.coalesce(S.proximity_near(ibs, F.lit(0.2), F.lit(0.4), ok), F.lit(False)).alias("ibs_near"), F.concat(F.lit("IBS="), S.fixed(ibs, 3)).alias("ibs_label"),
        tom.alias("tom_pct"), ((left <= 8) & (left > 5)).alias("tom_near"), F.concat(left.cast("string"), F.lit("d left")).alias("tom_label"))


@query("SCA16", with_("tr", body="""SELECT p, CASE WHEN p < 0.05 THEN 'OUI (p<0.05)' WHEN p < 0.10 THEN 'MARGINAL (p<0.10)' ELSE 'NON' END AS label, count(*) AS n FROM (SELECT round(abs(return_pct) * 10, 2) AS p FROM tr) GROUP BY ALL"""), round={"p": 2})
def sca16(t):
    tr = t.ibs_trades().select(F.round(F.abs(F.col("return_pct")) * 10, 2).alias("p"))
    return tr.withColumn("label", S.significance_label(F.col("p"))).groupBy("p", "label").agg(F.count(F.lit(1)).alias("n"))


@query("SCA17", with_("tr", body="""SELECT symbol, entry_ix, pct, greatest(1, round_even((holding_days + 10) * (1 + pct), 0)) AS whole_value, greatest(0.01, abs(return_pct) * (1 + pct)) AS real_value
  FROM tr, (VALUES (-0.1), (0.1), (-0.2), (0.2)) v(pct)"""), round={"pct": 2, "whole_value": 0, "real_value": 8})
def sca17(t):
    tr = t.ibs_trades().withColumn("pct", F.explode(F.array(*[F.lit(x) for x in (-0.1, 0.1, -0.2, 0.2)])))
    return tr.select("symbol", "entry_ix", "pct", S.perturbed((F.col("holding_days") + 10).cast("double"), F.col("pct"), True).alias("whole_value"),
                     S.perturbed(F.abs(F.col("return_pct")), F.col("pct"), False).alias("real_value"))


@query("SCA18", with_("tr", body="SELECT symbol, entry_ix, strftime(entry_date, '%Y-%m') AS entry_month, strftime(entry_date, '%Y-%m') <> strftime(exit_date, '%Y-%m') AS new_month FROM tr WHERE closed"))
def sca18(t):
    changed = F.trunc("entry_date", "MM") != F.trunc("exit_date", "MM")
    return t.ibs_trades().filter("closed").select("symbol", "entry_ix", F.date_format("entry_date", "yyyy-MM").alias("entry_month"), changed.alias("new_month"))


@query("SCA19", with_("bars", body=f"SELECT symbol, last_date, age_days, age_days > 2 AS is_stale FROM (SELECT symbol, last_date, DATE '{AS_OF}' + 2 - last_date AS age_days FROM (SELECT symbol, max(CASE WHEN symbol = 'ASIA' THEN date - 15 ELSE date END) AS last_date FROM bars GROUP BY symbol))"))
def sca19(t):
    """One symbol is delivered 15 days late."""
    as_of = F.date_add(F.lit(AS_OF).cast("date"), 2)
    day = F.when(F.col("symbol") == "ASIA", F.date_sub("date", 15)).otherwise(F.col("date"))
    b = t.bars().groupBy("symbol").agg(F.max(day).alias("last_date"))
    return b.select("symbol", "last_date", F.date_diff(as_of, "last_date").alias("age_days"), S.stale(F.col("last_date"), as_of).alias("is_stale"))


@query("SCA20", """SELECT event_id, CAST(json_extract(CASE WHEN event_id % 10 = 0 THEN NULL ELSE props END, '$.k') AS BIGINT) AS k,
  '{"id":' || event_id || ',"type":"' || event_type || '"}' AS encoded FROM events""")
def sca20(t):
    text = F.when(F.col("event_id") % 10 == 0, F.lit("{bad")).otherwise(F.col("props"))
    return t.raw("events").select("event_id", F.from_json(text, "k bigint")["k"].alias("k"),
                                  F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("encoded"))


@query("SCA21", with_("ind", body="""SELECT symbol, bar_ix, 'Close (' || printf('%.2f', round(close, 2)) || CASE WHEN close > sma_200 THEN ') &gt; SMA200 (' ELSE ') &lt; SMA200 (' END || printf('%.2f', round(sma_200, 2)) || ') &amp; IBS=' || coalesce(printf('%.4f', round(ibs, 4)), 'n/a') AS note
  FROM ind WHERE sma_200 IS NOT NULL"""))
def sca21(t):
    from ..operators.indicators import Needs, indicator_frame

    f = home_rows(indicator_frame(t.bars(), Needs(sma={200}))).filter("sma_200 IS NOT NULL")
    sign = F.when(F.col("close") > F.col("sma_200"), F.lit(") > SMA200 (")).otherwise(F.lit(") < SMA200 ("))
    note = F.concat(F.lit("Close ("), S.fixed(F.col("close"), 2), sign, S.fixed(F.col("sma_200"), 2), F.lit(") & IBS="),
                    F.when(F.col("ibs").isNull(), F.lit("n/a")).otherwise(S.fixed(F.col("ibs"), 4)))
    return f.select("symbol", "bar_ix", S.escape_html(note).alias("note"))


@query("SCA22", with_("tr", body="SELECT symbol, entry_ix, entry_date - 5 AS overlap_start, entry_date + 1 AS next_day, entry_date - 600 AS history_start FROM tr"))
def sca22(t):
    return t.ibs_trades().select("symbol", "entry_ix", F.date_sub("entry_date", 5).alias("overlap_start"), F.date_add("entry_date", 1).alias("next_day"),
                                 F.date_sub("entry_date", 600).alias("history_start"))


# ---------------------------------------------------------------- ledgers

_IG = [(i, p["ibs_entry_threshold"], p["ibs_exit_threshold"], p["sma_trend_period"]) for i, p in enumerate(IBS.combos())]
cte("igrid", f"SELECT * FROM (VALUES {_grid_values(_IG)}) v(combo_id, thr, xthr, per)")
cte("icand", """SELECT symbol, combo_id, bar_ix AS entry_ix, open * (1 + CAST(0.0003 AS DOUBLE)) AS entry_price, g.thr, g.xthr, g.per FROM ind i JOIN igrid g
  ON p_ibs < g.thr AND p_close > CASE g.per WHEN 150 THEN p_sma_150 WHEN 200 THEN p_sma_200 ELSE p_sma_250 END AND bar_ix >= g.per + 10""", "ind", "igrid")


@query("LED1", with_("icand", body="SELECT symbol, combo_id, entry_ix, entry_price FROM icand"), round={"entry_price": 6}, ints=("combo_id",))
def led1(t):
    combos = IBS.combos()
    c = candidates(frame_for(t.bars(), IBS, combos), IBS, combos)
    return c.select("symbol", "combo_id", "entry_ix", S.entry_fill(F.col("entry_open"), F.lit(1), 0.0003).alias("entry_price"))


@query("LED2", with_("tr", body="SELECT symbol, entry_ix, exit_ix, exit_reason FROM tr"))
def led2(t):
    p = IBS.params()
    c = pair(candidates(frame_for(t.bars(), IBS, [p]), IBS, [p]))
    return c.select("symbol", "entry_ix", F.col("exit.bar_ix").alias("exit_ix"), F.col("exit.reason").alias("exit_reason"))


cte("ibs_cand", """SELECT n.symbol, n.bar_ix AS entry_ix, n.date AS entry_date, n.open AS entry_open, 1 AS direction, x.bar_ix AS exit_ix, x.date AS exit_date,
  x.close AS exit_raw, x.reason AS exit_reason, false AS exit_slip, m.mark_ix, m.mark_price FROM tr_nx n LEFT JOIN tr_sig x ON x.symbol = n.symbol AND x.bar_ix = n.xix
  JOIN last_bar m ON m.symbol = n.symbol WHERE n.entry""", "tr_nx", "tr_sig", "last_bar")
cte("stop_cand", """SELECT c.* REPLACE (coalesce(h.ix, c.exit_ix) AS exit_ix, CASE WHEN h.ix IS NULL THEN c.exit_date ELSE b.date END AS exit_date,
   CASE WHEN h.ix IS NULL THEN c.exit_raw WHEN h.ix > c.entry_ix AND b.open <= stop THEN b.open ELSE stop END AS exit_raw,
   CASE WHEN h.ix IS NULL THEN c.exit_reason WHEN h.ix > c.entry_ix AND b.open <= stop THEN 'gap_sl' ELSE 'intraday_sl' END AS exit_reason,
   coalesce(h.ix IS NOT NULL AND NOT (h.ix > c.entry_ix AND b.open <= stop), false) AS exit_slip)
  FROM (SELECT *, entry_open * (1 + CAST(0.0003 AS DOUBLE)) * (1 - CAST(1.5 / 100 AS DOUBLE)) AS stop FROM ibs_cand) c
  LEFT JOIN (SELECT c.symbol, c.entry_ix, min(b.bar_ix) AS ix FROM ibs_cand c JOIN bars b ON b.symbol = c.symbol AND b.bar_ix BETWEEN c.entry_ix AND coalesce(c.exit_ix, c.mark_ix)
     AND b.low <= c.entry_open * (1 + CAST(0.0003 AS DOUBLE)) * (1 - CAST(1.5 / 100 AS DOUBLE)) GROUP BY ALL) h ON h.symbol = c.symbol AND h.entry_ix = c.entry_ix
  LEFT JOIN bars b ON b.symbol = h.symbol AND b.bar_ix = h.ix""", "ibs_cand", "bars")
_US = FEES["us_stocks_usd_account"]
walk_cte("stop_tr", "stop_cand", 100000.0, 0.2, 0.0003, _FX, False)
walk_cte("strict_tr", "ibs_cand", 10000.0, 0.2, 0.0003, _US, True, cooldown=2)


@query("LED3", with_("stop_tr", body=f"SELECT {_TCOLS} FROM stop_tr"), round=TRADE_DIGITS)
def led3(t):
    return trades_out(ledger(t.bars(), IBS, [IBS.params(sl_percent=1.5)], ACCOUNT))


@query("LED5", with_("strict_tr", body=f"SELECT {_TCOLS} FROM strict_tr"), round=TRADE_DIGITS)
def led5(t):
    return trades_out(ledger(t.bars(), IBS, [IBS.params(cooldown_candles=2)], STRICT))


walk_cte("poor_tr", "ibs_cand", 4600.0, 0.2, 0.0003, _US, True)


@query("LED5_skips", with_("poor_tr_state", body="SELECT symbol, n_skipped, final_capital FROM poor_tr_state"), round={"final_capital": 4})
def led5_skips(t):
    small = variant(STRICT, capital=4600.0)
    g = ledger(t.bars(), IBS, account=small).groupBy("symbol").agg(
        F.count_if(F.col("status") == "skipped").alias("n_skipped"), (F.coalesce(F.sum("pnl"), F.lit(0.0)) + small.capital).alias("final_capital"))
    return g


@query("LED6", with_("tr", body=f"SELECT {_TCOLS} FROM tr"), round=TRADE_DIGITS)
def led6(t):
    return trades_out(ledger(t.bars(), IBS, account=ACCOUNT))


@query("LED7", with_("tr", body="""SELECT symbol, count(*) FILTER (NOT closed) AS n_open, sum(pnl) FILTER (NOT closed) AS open_pnl, 100000 + sum(pnl) AS final_capital FROM tr GROUP BY symbol"""),
       round={"open_pnl": 4, "final_capital": 4})
def led7(t):
    return t.ibs_trades().groupBy("symbol").agg(F.count_if(~F.col("closed")).alias("n_open"), F.sum(F.when(~F.col("closed"), F.col("pnl"))).alias("open_pnl"),
                                                (F.sum("pnl") + 100_000).alias("final_capital"))


ibs_ctes("win", where=f"date >= DATE '{SPLIT}' AND date < DATE '{MID}'")


def between(lo, hi):
    d = F.col("date")
    return d >= F.lit(lo).cast("date"), d < F.lit(hi).cast("date")


@query("LED8", with_("win", body=f"SELECT {_TCOLS} FROM win"), round=TRADE_DIGITS)
def led8(t):
    lo, hi = between(SPLIT, MID)
    return trades_out(ledger(t.bars(), IBS, account=ACCOUNT, start=lo, end=hi))


cte("rsi_sig", """SELECT *, coalesce(r1 < 20 AND p_close > p_sma_200 AND bar_ix >= 202, false) AS entry,
  CASE WHEN close > sma_5 THEN 'sma_exit' WHEN close < sma_200 THEN 'trend_break' END AS reason
  FROM (SELECT i.*, r.rsi_2, lag(r.rsi_2) OVER (PARTITION BY symbol ORDER BY bar_ix) AS r1 FROM ind i LEFT JOIN rsi2 r USING (symbol, bar_ix))""", "ind", "rsi2")
cte("rsi_old", """SELECT e.symbol, e.bar_ix AS entry_ix, x.bar_ix AS exit_ix, x.reason AS exit_reason, e.open * (1 + CAST(0.0003 AS DOUBLE)) AS entry_price, x.close AS exit_price
  FROM (SELECT symbol, xix, min(bar_ix) AS eix FROM (SELECT *, min(CASE WHEN reason IS NOT NULL THEN bar_ix END) OVER (PARTITION BY symbol ORDER BY bar_ix ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS xix FROM rsi_sig)
    WHERE entry AND xix IS NOT NULL GROUP BY ALL) g JOIN rsi_sig e ON e.symbol = g.symbol AND e.bar_ix = g.eix JOIN rsi_sig x ON x.symbol = g.symbol AND x.bar_ix = g.xix""", "rsi_sig")
OLD_RSI = RSI2.params(rsi_entry_threshold=20, sma_trend_buffer=1.0)


def old_rsi_trades(t):
    """Older mean-reversion variant: shorter warm-up; return measured on capital after the trade."""
    from dataclasses import replace

    old = replace(RSI2, warmup=lambda p: max(p["sma_trend_period"], p["sma_exit_period"], p["rsi_period"] + 1) + 2)
    tr = ledger(t.bars(), old, [OLD_RSI], ACCOUNT)
    return tr.withColumn("return_pct", F.col("pnl") / F.col("capital_after"))


@query("LED10", with_("rsi_old", body="""SELECT symbol, entry_ix, exit_ix, exit_reason, 0.2 * r / (1 + 0.2 * r) AS return_pct
  FROM (SELECT *, (exit_price - entry_price) / entry_price - 0.000075 - exit_price / entry_price * 0.000075 AS r FROM rsi_old)"""), round={"return_pct": 8})
def led10(t):
    return old_rsi_trades(t).filter("closed").select("symbol", "entry_ix", "exit_ix", "exit_reason", "return_pct")


@query("LED13", with_("strict_tr", "bars", body="""SELECT t.symbol, t.entry_ix, t.exit_reason, t.pnl, CASE WHEN n.open IS NULL THEN t.pnl ELSE (n.open - t.entry_price) * t.quantity - (1 + t.quantity * t.entry_price * 0.00025) - (1 + t.quantity * n.open * 0.00025) END AS new_pnl
  FROM strict_tr t LEFT JOIN bars n ON n.symbol = t.symbol AND n.bar_ix = t.exit_ix + 1 WHERE t.closed"""), round={"pnl": 4, "new_pnl": 4})
def led13(t):
    tr = ledger(t.bars(), IBS, [IBS.params(cooldown_candles=2)], STRICT).filter("closed")
    return E.reprice_at_next_open(tr, t.bars(), "us_stocks_usd_account").select("symbol", "entry_ix", "exit_reason", "pnl", "new_pnl")


cte("mae", "SELECT t.symbol, t.entry_ix, t.pnl, t.return_pct, min(b.low) / t.entry_price - 1 AS mae_pct FROM tr t JOIN bars b ON b.symbol = t.symbol AND b.bar_ix BETWEEN t.entry_ix AND t.exit_ix WHERE t.closed GROUP BY t.symbol, t.entry_ix, t.pnl, t.return_pct, t.entry_price", "tr", "bars")


@query("LED14", with_("mae", body="SELECT symbol, entry_ix, mae_pct FROM mae"), round={"mae_pct": 8})
def led14(t):
    return E.adverse_excursion(t.ibs_trades().filter("closed"), t.bars()).select("symbol", "entry_ix", "mae_pct")


cte("daily", """SELECT b.symbol, b.date, b.bar_ix, 100000 + coalesce((SELECT sum(t.pnl) FROM tr t WHERE t.symbol = b.symbol AND t.closed AND t.exit_ix <= b.bar_ix), 0)
  + coalesce((SELECT sum((b.close - t.entry_price) * t.quantity) FROM tr t WHERE t.symbol = b.symbol AND t.entry_ix <= b.bar_ix AND (t.exit_ix IS NULL OR t.exit_ix > b.bar_ix)), 0) AS equity FROM bars b""", "tr", "bars")


@query("LED15", with_("daily", body="SELECT symbol, date, equity FROM daily"), round={"equity": 4})
def led15(t):
    return E.daily_equity(t.ibs_trades(), t.bars(), 100_000.0).select("symbol", "date", "equity")


@query("LED16", with_("bars", body="SELECT symbol, date, close / first_value(close) OVER (PARTITION BY symbol ORDER BY date) * 100000 AS equity FROM bars"), round={"equity": 4})
def led16(t):
    return E.buy_and_hold(t.bars(), 100_000.0).select("symbol", "date", "equity")


# ---------------------------------------------------------------- joins that feed the ledgers


@query("JON1", with_("bars", "igrid", body="SELECT combo_id, count(*) AS n_bars, sum(volume) AS volume FROM bars, igrid WHERE bar_ix >= per + 10 GROUP BY combo_id"), ints=("combo_id",))
def jon1(t):
    combos = IBS.combos()
    by_warm = t.bars().groupBy("symbol").agg(*[x for w in sorted({IBS.warmup(p) for p in combos}) for x in (
        F.count_if(F.col("bar_ix") >= w).alias(f"n{w}"), F.sum(F.when(F.col("bar_ix") >= w, F.col("volume"))).alias(f"v{w}"))])
    rows = [F.struct(F.lit(i).alias("combo_id"), F.col(f"n{IBS.warmup(p)}").alias("n"), F.col(f"v{IBS.warmup(p)}").alias("v")) for i, p in enumerate(combos)]
    return by_warm.select(F.inline(F.array(*rows))).groupBy("combo_id").agg(F.sum("n").alias("n_bars"), F.sum("v").alias("volume"))


@query("JON2", with_("stop_cand", body="SELECT symbol, entry_ix, exit_ix, exit_reason FROM stop_cand"))
def jon2(t):
    from ..operators.ledger import stop_exits

    p = IBS.params()
    c = with_mark(candidates(frame_for(t.bars(), IBS, [p]), IBS, [p]), t.bars())
    out = stop_exits(c, t.bars(), 1.5, 0.0003)
    return out.select("symbol", "entry_ix", F.col("exit.bar_ix").alias("exit_ix"), F.col("exit.reason").alias("exit_reason"))


@query("JON3", with_("tr", "bars", body="""SELECT t.symbol, t.entry_ix, count(*) AS n_bars, max(b.high) AS top, min(b.low) AS bottom, sum(b.volume) AS volume FROM tr t JOIN bars b ON b.symbol = t.symbol AND b.bar_ix BETWEEN t.entry_ix AND t.exit_ix WHERE t.closed GROUP BY t.symbol, t.entry_ix"""))
def jon3(t):
    found = K.between(t.ibs_trades().filter("closed").select("symbol", "entry_ix", "exit_ix"), K.bar_blocks(t.bars()), sums=True)
    return found.select("symbol", "entry_ix", "n_bars", F.col("high").alias("top"), F.col("low").alias("bottom"), "volume")


@query("JON4", with_("tr", "bars", body="""SELECT t.symbol, t.entry_ix, s.date AS signal_date, e.date AS entry_date, x.date AS exit_date, n.open AS next_open FROM tr t JOIN bars e ON e.symbol = t.symbol AND e.bar_ix = t.entry_ix
  JOIN bars s ON s.symbol = t.symbol AND s.bar_ix = t.entry_ix - 1 LEFT JOIN bars x ON x.symbol = t.symbol AND x.bar_ix = t.exit_ix LEFT JOIN bars n ON n.symbol = t.symbol AND n.bar_ix = t.exit_ix + 1"""))
def jon4(t):
    return E.trade_dates(t.ibs_trades(), t.bars()).select("symbol", "entry_ix", "signal_date", "entry_date", "exit_date", "next_open")


@query("WIN4", with_("bars", body="SELECT symbol, bar_ix, lag(close) OVER s AS prev_close, lead(open) OVER s AS next_open FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY bar_ix)"))
def win4(t):
    from ..operators.spans import span_order, spread

    w = span_order(["symbol"])
    f = spread(t.bars(), before=1, after=1).withColumns({"prev_close": F.lag("close").over(w), "next_open": F.lead("open").over(w)})
    return home_rows(f).select("symbol", "bar_ix", "prev_close", "next_open")


@query("WIN5", with_("bars", body="SELECT symbol, date, row_number() OVER (PARTITION BY symbol, month ORDER BY date) AS up, row_number() OVER (PARTITION BY symbol, month ORDER BY date DESC) AS down FROM bars"))
def win5(t):
    from pyspark.sql import Window

    w = Window.partitionBy("symbol", "month")
    b = t.bars()
    return b.select("symbol", "date", F.row_number().over(w.orderBy("date")).alias("up"), F.row_number().over(w.orderBy(F.col("date").desc())).alias("down"))
