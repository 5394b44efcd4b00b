"""Queries on sources, data quality, filters, projections and indicators."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.indicators import Needs, home_rows, indicator_frame, periods_of, true_range
from ..operators.rules import RSI2
from ..presets import ALIASES, FALLBACK_MARKET, MARKETS
from ..sources import bartable, bars as B, store
from .base import AS_OF, SPLIT, cte, query, sma_sql, with_

UNIVERSE = {"AFRICA": "1996-01-01", "AMERICA": None, "ASIA": "1997-06-15", "EUROPE": None, "MIDDLE EAST": None, "EURUSD=X": None}
DEFAULT_START = "1995-07-01"


def universe_rows(t):
    """The configured universe (a short list) with its start dates."""
    rows = t.spark.createDataFrame(list(UNIVERSE.items()), "symbol string, start string")
    return rows.select("symbol", F.to_date(F.coalesce("start", F.lit(DEFAULT_START))).alias("start_date"))


_U = ", ".join(f"('{k}', {chr(39) + v + chr(39) if v else 'NULL'})" for k, v in UNIVERSE.items())
cte("universe", f"SELECT s AS symbol, CAST(coalesce(st, '{DEFAULT_START}') AS DATE) AS start_date FROM (VALUES {_U}) v(s, st)")
_BAR = "symbol, date, open, high, low, close, volume"


@query("SRC1", with_("bars", body="SELECT date, open, high, low, close, close AS adj_close, volume FROM bars WHERE symbol = 'ASIA' AND date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'"))
def src1(t):
    return B.bars_of(t.bars(), "ASIA", "1996-01-01", "1998-12-31").select("date", "open", "high", "low", "close", "adj_close", "volume")


@query("SRC2", with_("bars", "universe", body="""SELECT u.symbol, u.start_date, count(b.date) AS n_bars, min(b.date) AS first_bar
 FROM universe u LEFT JOIN bars b ON b.symbol = u.symbol AND b.date >= u.start_date GROUP BY ALL"""))
def src2(t):
    u, b = universe_rows(t), t.bars().select(F.col("symbol").alias("s"), "date")
    joined = b.join(u, (b.s == u.symbol) & (b.date >= u.start_date), "right")
    return joined.groupBy("symbol", "start_date").agg(F.count("date").alias("n_bars"), F.min("date").alias("first_bar"))


@query("SRC3", with_("bars", body="""SELECT c.asset_class, c.market, c.fee_model, c.side, b.symbol, count(*) AS n_bars
 FROM (VALUES ('north', 'us_stocks', 'us_stocks', 'long', 'AMERICA'), ('north', 'us_stocks', 'us_stocks', 'long', 'EUROPE'),
   ('south', 'forex', 'forex_saxo', 'long', 'AFRICA'), ('south', 'forex', 'forex_saxo', 'long', 'ASIA'),
   ('south', 'forex', 'forex_saxo', 'short', 'AFRICA'), ('south', 'forex', 'forex_saxo', 'short', 'ASIA')) c(asset_class, market, fee_model, side, symbol)
 JOIN bars b ON b.symbol = c.symbol GROUP BY ALL"""))
def src3(t):
    cfg = t.spark.createDataFrame(
        [("north", "us_stocks", "us_stocks", ["long"], ["AMERICA", "EUROPE"]), ("south", "forex", "forex_saxo", ["long", "short"], ["AFRICA", "ASIA"])],
        "asset_class string, market string, fee_model string, sides array<string>, symbols array<string>",
    )
    rows = cfg.withColumn("side", F.explode("sides")).withColumn("symbol", F.explode("symbols"))
    n = t.bars().groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bars"))
    return n.join(rows, "symbol").select("asset_class", "market", "fee_model", "side", "symbol", "n_bars")


@query("SRC5", with_("bars", body="SELECT symbol, date, open, high, low, close, close AS adj_close, volume FROM bars"))
def src5(t):
    b = t.bars()
    raw = b.select(
        "symbol", (F.col("date").cast("timestamp") + F.expr("INTERVAL 16 HOURS")).alias("Date"), F.col("open").alias("Open"),
        F.col("high").alias("High"), F.col("low").alias("Low"), F.col("close").alias("Close"), F.col("close").alias("Adj Close"),
        F.col("volume").alias("Volume"), F.lit(0.0).alias("Dividends"),
    )
    return B.normalise_history(raw)


cte("raw", """SELECT symbol, date, open * k AS open, CASE WHEN symbol = 'AFRICA' AND dayofyear(date) = 45 THEN low - 1 ELSE high * k END AS high,
  low * k AS low, CASE WHEN symbol = 'EUROPE' AND day(date) = 13 THEN NULL ELSE close * k END AS close, close AS adj_close, volume
 FROM (SELECT *, CASE WHEN symbol = 'ASIA' AND date < DATE '1998-06-01' THEN 4.0 ELSE 1.0 END AS k FROM bars)""", "bars")


@query("DQ1", with_("raw", body="""SELECT symbol, date, open * f AS open, high * f AS high, low * f AS low, CASE WHEN adj THEN adj_close ELSE close END AS close
 FROM (SELECT *, CASE WHEN adj THEN adj_close / close ELSE 1 END AS f FROM (SELECT *, coalesce(bool_or(abs(adj_close / close - 1) > 1.01e-6) OVER (PARTITION BY symbol), false) AS adj FROM raw))"""),
       round={"open": 6, "high": 6, "low": 6, "close": 6})
def dq1(t):
    return B.adjust_splits(t.raw_history()).select("symbol", "date", "open", "high", "low", "close")


_RULES = "close IS NOT NULL AND adj_close IS NOT NULL"


@query("DQ2", with_("raw", body=f"""SELECT r.symbol, count(*) AS n_rows, min(date) AS first_date, sum(volume) AS volume FROM raw r WHERE {_RULES}
 AND symbol NOT IN (SELECT symbol FROM raw WHERE {_RULES} AND (high < low OR least(open, high, low, close) <= 0)) GROUP BY ALL"""))
def dq2(t):
    return B.clean_bars(t.raw_history()).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first_date"), F.sum("volume").alias("volume"))


@query("DQ2_report", with_("raw", body=f"""SELECT symbol, count(*) AS n_rows, count(*) FILTER (NOT ({_RULES})) AS n_null,
 count(*) FILTER ({_RULES} AND least(open, high, low, close, adj_close) <= 0) AS n_nonpositive,
 count(*) FILTER ({_RULES} AND high < low) AS n_inverted FROM raw GROUP BY symbol"""))
def dq2_report(t):
    return B.quality_report(t.raw_history())


@query("DQ3", with_("bars", body="""SELECT symbol, min(date) AS first_date, max(date) AS last_date,
 min(date) <= DATE '1995-01-05' + 7 AND max(date) >= DATE '2001-11-05' - 7 AS usable FROM bars GROUP BY symbol"""))
def dq3(t):
    return B.coverage(t.bars(), "1995-01-05", "2001-11-05")


@query("SNK1", with_("bars", body="""SELECT symbol, date, open, high, low, close, volume FROM bars WHERE date <= DATE '2001-01-31' AND date < DATE '2001-01-01'
 UNION ALL SELECT symbol, date, open + 1, high + 1, low + 1, close + 1, 0.0 FROM bars WHERE date >= DATE '2001-01-01'"""),
       round={"open": 4, "high": 4, "low": 4, "close": 4})
def snk1(t):
    b = t.bars().select(*store.BAR_COLUMNS)
    old = b.filter(F.col("date") <= F.lit("2001-01-31").cast("date"))
    late = b.filter(F.col("date") >= F.lit("2001-01-01").cast("date")).select(
        F.col("symbol").alias("Symbol"), F.col("date").alias("Date"), *[(F.col(c) + 1).alias(c.upper()) for c in ("open", "high", "low", "close")])
    path = store.written(store.upsert(old, store.fit_bars(late), ["symbol", "date"]), "bars-upsert")
    return t.spark.read.parquet(path)


@query("SNK1_table", with_("bars", body="""SELECT symbol, date, open, high, low, CASE WHEN date >= DATE '2001-01-01' THEN close + 1 ELSE close END AS close, volume FROM bars WHERE symbol IN ('ASIA', 'EUROPE') AND date >= DATE '2000-06-15'"""))
def snk1_table(t):
    """All bars, then a correction of one year, into the partitioned table; read for two symbols from a date on."""
    b = t.bars().select(*store.BAR_COLUMNS)
    path = f"{store.written(b.limit(0), 'bar-table')}/table"
    bartable.update(b, path)
    bartable.update(b.filter(F.col("date") >= F.lit("2001-01-01").cast("date")).withColumn("close", F.col("close") + 1), path)
    return bartable.read(t.spark, path, b.schema, ["ASIA", "EUROPE"], datetime.date(2000, 6, 15))


@query("SNK7", with_("bars", body=f"SELECT {_BAR} FROM bars WHERE symbol <> 'ASIA'"))
def snk7(t):
    b = t.bars().select(*store.BAR_COLUMNS)
    return t.spark.read.parquet(store.written(store.without_symbol(b, "ASIA"), "bars-cleared"))


@query("CAT1", with_("bars", body='SELECT symbol, min(date) AS "start", max(date) AS "end", count(*) AS n_rows FROM bars GROUP BY symbol'))
def cat1(t):
    return B.catalogue(t.bars())


@query("CAT2", with_("bars", "universe", body="""SELECT u.symbol, count(b.date) > 0 AS has_bars, min(b.date) AS first_date, max(b.date) AS last_date
 FROM universe u LEFT JOIN bars b USING (symbol) GROUP BY u.symbol"""))
def cat2(t):
    cat = B.catalogue(t.bars())
    return universe_rows(t).join(cat, "symbol", "left").select(
        "symbol", F.coalesce(F.col("n_rows") > 0, F.lit(False)).alias("has_bars"), F.col("start").alias("first_date"), F.col("end").alias("last_date"))


@query("CAT3", with_("bars", "tr", body="SELECT 'ohlcv' AS name, count(*) AS n FROM bars UNION ALL SELECT 'trades', count(*) FROM tr UNION ALL SELECT 'events', count(*) FROM events"))
def cat3(t):
    parts = {"ohlcv": t.bars(), "trades": t.ibs_trades(), "events": t.raw("events")}
    out = None
    for name, df in parts.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("CAT4", with_("bars", "universe", body="""SELECT u.symbol, l.last_date, coalesce(l.last_date, DATE '2003-01-01') - 5 AS load_from
 FROM universe u LEFT JOIN (SELECT symbol, max(date) AS last_date FROM bars GROUP BY symbol) l USING (symbol)"""))
def cat4(t):
    return B.update_plan(universe_rows(t).select("symbol"), t.bars())


cte("meta", "SELECT s AS symbol, n AS name FROM (VALUES ('ASIA', 'Asia Pacific'), ('EUROPE', 'Europe'), ('EURUSD=X', 'EUR/USD')) v(s, n)")


@query("CAT5", with_("bars", "meta", body="""SELECT b.symbol, b.date, m.name, b.close FROM bars b LEFT JOIN meta m USING (symbol)"""))
def cat5(t):
    meta = t.spark.createDataFrame([("ASIA", "Asia Pacific"), ("EUROPE", "Europe"), ("EURUSD=X", "EUR/USD")], "symbol string, name string")
    return t.bars().join(meta, "symbol", "left").select("symbol", "date", "name", "close")


@query("SNK5", with_("bars", "meta", body="""SELECT symbol, coalesce(n.name, m.name) AS name FROM meta m FULL JOIN
  (SELECT DISTINCT symbol, lower(symbol) AS name FROM bars) n USING (symbol)"""))
def snk5(t):
    meta = t.spark.createDataFrame([("ASIA", "Asia Pacific"), ("EUROPE", "Europe"), ("EURUSD=X", "EUR/USD")], "symbol string, name string")
    fresh = t.bars().select("symbol").distinct().withColumn("name", F.lower("symbol"))
    return t.spark.read.parquet(store.written(store.upsert(meta, fresh, ["symbol"]), "metadata"))


@query("CAT6", """SELECT page_id, url, split_part(regexp_replace(regexp_replace(url, '^https?://', ''), '^www\\.', ''), '/', 1) AS domain,
  CASE WHEN page_id % 2 = 0 THEN upper(substr(md5(url), 1, 3)) || '/' || upper(substr(md5(url), 4, 3)) ELSE upper(substr(md5(url), 1, 6)) END AS display FROM pages""")
def cat6(t):
    code = F.upper(F.substring(F.md5("url"), 1, 6))
    ticker = F.when(F.col("page_id") % 2 == 0, F.concat(code, F.lit("=X"))).otherwise(code)
    return t.raw("pages").select("page_id", "url", S.site_domain(F.col("url")).alias("domain"), S.display_name(ticker).alias("display"))


@query("CAT7", with_("bars", "tr", body="SELECT symbol FROM bars UNION SELECT lower(symbol) FROM tr UNION SELECT 'EURUSD=X' FROM bars"))
def cat7(t):
    extra = t.bars().select(F.lit("EURUSD=X").alias("symbol"))
    return t.bars().select("symbol").union(t.ibs_trades().select(F.lower("symbol"))).union(extra).distinct()


@query("FLT5", with_("bars", body=f"""SELECT symbol, count(*) FILTER (date < DATE '{SPLIT}') AS n_in_sample, count(*) FILTER (date >= DATE '{SPLIT}') AS n_out_of_sample,
  min(bar_ix) FILTER (date >= DATE '{SPLIT}') AS oos_start FROM bars GROUP BY symbol"""))
def flt5(t):
    oos = F.col("date") >= F.lit(SPLIT).cast("date")
    return t.bars().groupBy("symbol").agg(F.count_if(~oos).alias("n_in_sample"), F.count_if(oos).alias("n_out_of_sample"),
                                          F.min(F.when(oos, F.col("bar_ix"))).alias("oos_start"))


@query("FLT6", with_("bars", body="""SELECT symbol, start_ix, n_bars - start_ix AS n_oos FROM (SELECT symbol, count(*) AS n_bars,
  greatest(coalesce(min(bar_ix) FILTER (date >= DATE '1995-06-01'), count(*)), 210) AS start_ix FROM bars GROUP BY symbol) WHERE n_bars - start_ix >= 50"""))
def flt6(t):
    first = F.min(F.when(F.col("date") >= F.lit("1995-06-01").cast("date"), F.col("bar_ix")))
    g = t.bars().groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), first.alias("f"))
    start = F.greatest(F.coalesce("f", "n"), F.lit(RSI2.warmup(RSI2.params())))
    return g.select("symbol", start.alias("start_ix"), (F.col("n") - start).alias("n_oos")).filter("n_oos >= 50")


@query("FLT7", with_("bars", body="""SELECT symbol, min(bar_ix) FILTER (date >= DATE '1999-03-07') AS first_ix, max(bar_ix) FILTER (date < DATE '2000-03-05') + 1 AS end_ix FROM bars GROUP BY symbol"""))
def flt7(t):
    a, b = F.lit("1999-03-07").cast("date"), F.lit("2000-03-05").cast("date")
    return t.bars().groupBy("symbol").agg(F.min(F.when(F.col("date") >= a, F.col("bar_ix"))).alias("first_ix"),
                                          (F.max(F.when(F.col("date") < b, F.col("bar_ix"))) + 1).alias("end_ix"))


@query("FLT2", with_("bars", body="SELECT symbol, date, close FROM bars WHERE symbol IN ('ASIA', 'EUROPE', 'NONE')"))
def flt2(t):
    return t.bars().filter(F.col("symbol").isin("ASIA", "EUROPE", "NONE")).select("symbol", "date", "close")


@query("FLT4", with_("bars", body=f"SELECT symbol, date, close FROM bars WHERE date >= DATE '{AS_OF}' - 30"))
def flt4(t):
    return t.bars().filter(F.col("date") >= F.date_sub(F.lit(AS_OF).cast("date"), 30)).select("symbol", "date", "close")


@query("FLT3", """SELECT doc_id, lang, source FROM documents WHERE contains(lower(text), 'the') OR contains(lower(source), 'web') OR contains(lower(lang), 'de')""")
def flt3(t):
    hit = F.lower("text").contains("the") | F.lower("source").contains("web") | F.lower("lang").contains("de")
    return t.raw("documents").filter(hit).select("doc_id", "lang", "source")


@query("PRJ2", with_("bars", body="""SELECT symbol, CASE WHEN NOT contains(symbol, '=X') THEN '/api/market/asset/' || symbol || '/logo' END AS logo, count(*) AS n
  FROM (SELECT CASE WHEN bar_ix % 7 = 0 THEN symbol || '=X' ELSE symbol END AS symbol FROM bars) GROUP BY ALL"""))
def prj2(t):
    sym = F.when(F.col("bar_ix") % 7 == 0, F.concat("symbol", F.lit("=X"))).otherwise(F.col("symbol"))
    b = t.bars().select(sym.alias("symbol"))
    return b.select("symbol", S.logo_link(F.col("symbol")).alias("logo")).groupBy("symbol", "logo").agg(F.count(F.lit(1)).alias("n"))


_A = ", ".join(f"('{a}', '{k}')" for a, k in ALIASES.items())
_NAMES = "list_value('rsi2', 'IBS_mean_reversion', ' turn_of_month', 'ibs_tom', 'unknown')"


@query("PRJ3", with_("bars", body=f"""SELECT b.name, a.k AS strategy, count(*) AS n FROM (SELECT {_NAMES}[CAST(bar_ix % 5 AS INT) + 1] AS name FROM bars) b
  LEFT JOIN (VALUES {_A}) a(n, k) ON a.n = lower(trim(b.name)) GROUP BY ALL"""))
def prj3(t):
    names = F.array(*[F.lit(x) for x in ("rsi2", "IBS_mean_reversion", " turn_of_month", "ibs_tom", "unknown")])
    table = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    b = t.bars().select(names[F.col("bar_ix") % 5].alias("name"))
    return b.select("name", F.try_element_at(table, F.lower(F.trim("name"))).alias("strategy")).groupBy("name", "strategy").agg(F.count(F.lit(1)).alias("n"))


_M = ", ".join(f"('{m}', {c}, {str(w).lower()})" for m, (c, w) in MARKETS.items())


@query("PRJ4", with_("bars", body=f"""SELECT b.symbol, b.market, coalesce(b.override, m.c, {FALLBACK_MARKET[0]}) AS capital, coalesce(m.w, {str(FALLBACK_MARKET[1]).lower()}) AS whole_shares
  FROM (SELECT DISTINCT symbol, list_value('us_stocks', 'forex', 'crypto')[CAST(length(symbol) % 3 AS INT) + 1] AS market,
     CASE WHEN symbol = 'ASIA' THEN 2500.0 END AS override FROM bars) b LEFT JOIN (VALUES {_M}) m(k, c, w) ON m.k = b.market"""), round={"capital": 2})
def prj4(t):
    markets = t.spark.createDataFrame([(m, c, w) for m, (c, w) in MARKETS.items()], "market string, c double, w boolean")
    kind = F.array(F.lit("us_stocks"), F.lit("forex"), F.lit("crypto"))[F.length("symbol") % 3]
    s = t.bars().select("symbol").distinct().withColumn("market", kind).withColumn("o", F.when(F.col("symbol") == "ASIA", 2500.0))
    return s.join(markets, "market", "left").select(
        "symbol", "market", F.coalesce("o", "c", F.lit(FALLBACK_MARKET[0])).alias("capital"), F.coalesce("w", F.lit(FALLBACK_MARKET[1])).alias("whole_shares"))


# ---------------------------------------------------------------- indicators


def _frame(t, needs, *cols):
    return home_rows(indicator_frame(t.bars(), needs)).select("symbol", "bar_ix", *cols)


@query("IND1", with_("ind", body="SELECT symbol, bar_ix, sma_5, sma_200 FROM ind"), round={"sma_5": 6, "sma_200": 6})
def ind1(t):
    return _frame(t, Needs(sma={5, 200}), "sma_5", "sma_200")


def fold_list_sql(x: str, seed: str, a: float, k: float) -> str:
    """y from a list of inputs: list_reduce over x with y = a*y + k*x, seeded list."""
    return f"list_reduce({x}, lambda acc, v: list_append(acc, acc[-1] * CAST({a!r} AS DOUBLE) + v * CAST({k!r} AS DOUBLE)), [{seed}])"


def unrolled(name: str, src: str, value: str, first: int, p: int, a: float, k: float, seed: str, dep: str) -> None:
    """CTE (symbol, bar_ix, y): seed over ``first..first+p-1`` then the recurrence."""
    cte(name, f"""
     SELECT symbol, unnest(range({first + p - 1}, {first + p - 1} + len(y))) AS bar_ix, unnest(y) AS y FROM (
       SELECT symbol, {fold_list_sql(f"xs[{first + p + 1}:]", f"{seed}(xs[{first + 1}:{first + p}])", a, k)} AS y
       FROM (SELECT symbol, list({value} ORDER BY bar_ix) AS xs FROM {src} GROUP BY symbol) WHERE len(xs) >= {first + p})""", dep)


unrolled("ema9", "bars", "close", 0, 9, 8 / 10, 2 / 10, "list_avg", "bars")
unrolled("ema50", "bars", "close", 0, 50, 49 / 51, 2 / 51, "list_avg", "bars")


@query("IND2", with_("ema9", "ema50", body="SELECT b.symbol, b.bar_ix, e.y AS ema_9, f.y AS ema_50 FROM bars b LEFT JOIN ema9 e USING (symbol, bar_ix) LEFT JOIN ema50 f USING (symbol, bar_ix)"),
       round={"ema_9": 6, "ema_50": 6})
def ind2(t):
    return _frame(t, Needs(ema={9, 50}), "ema_9", "ema_50")


cte("trange", """SELECT *, CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr,
  coalesce(greatest(close - pc, 0), 0) AS gain, coalesce(greatest(pc - close, 0), 0) AS loss,
  CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END AS up, CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END AS dn
 FROM (SELECT *, lag(close) OVER s AS pc, lag(high) OVER s AS ph, lag(low) OVER s AS pl FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY bar_ix))""", "bars")


@query("IND3", with_("trange", body="SELECT symbol, bar_ix, tr FROM trange"), round={"tr": 6})
def ind3(t):
    return t.bars().select("symbol", "bar_ix", true_range(F.col("prev_close")).alias("tr"))


unrolled("atr14", "trange", "tr", 1, 14, 13 / 14, 1 / 14, "list_avg", "trange")


@query("IND4", with_("atr14", body="SELECT b.symbol, b.bar_ix, a.y AS atr_14 FROM bars b LEFT JOIN atr14 a USING (symbol, bar_ix)"), round={"atr_14": 6})
def ind4(t):
    return _frame(t, Needs(atr={14}), "atr_14")


for _p in (2, 14):
    unrolled(f"gain{_p}", "trange", "gain", 1, _p, (_p - 1) / _p, 1 / _p, "list_avg", "trange")
    unrolled(f"loss{_p}", "trange", "loss", 1, _p, (_p - 1) / _p, 1 / _p, "list_avg", "trange")
    cte(f"rsi{_p}", f"SELECT symbol, bar_ix, CASE WHEN l.y = 0 THEN 100 ELSE 100 - 100 / (1 + g.y / l.y) END AS rsi_{_p} FROM gain{_p} g JOIN loss{_p} l USING (symbol, bar_ix)", f"gain{_p}", f"loss{_p}")


@query("IND5", with_("rsi2", "rsi14", body="SELECT b.symbol, b.bar_ix, r.rsi_2, q.rsi_14 FROM bars b LEFT JOIN rsi2 r USING (symbol, bar_ix) LEFT JOIN rsi14 q USING (symbol, bar_ix)"),
       round={"rsi_2": 6, "rsi_14": 6})
def ind5(t):
    return _frame(t, Needs(rsi={2, 14}), "rsi_2", "rsi_14")


for _n, _c in (("s_tr", "tr"), ("s_up", "up"), ("s_dn", "dn")):
    unrolled(_n, "trange", _c, 1, 14, 13 / 14, 1.0, "list_sum", "trange")
cte("di", """SELECT symbol, bar_ix, p, m, CASE WHEN p + m > 0 THEN abs(p - m) / (p + m) * 100 ELSE 0 END AS dx FROM (
  SELECT symbol, bar_ix, CASE WHEN a.y > 0 THEN 100 * b.y / a.y ELSE 0 END AS p, CASE WHEN a.y > 0 THEN 100 * c.y / a.y ELSE 0 END AS m
  FROM s_tr a JOIN s_up b USING (symbol, bar_ix) JOIN s_dn c USING (symbol, bar_ix))""", "s_tr", "s_up", "s_dn")
cte("adx14", f"""SELECT symbol, unnest(range(27, 27 + len(y))) AS bar_ix, unnest(y) AS adx FROM (
   SELECT symbol, {fold_list_sql("xs[15:]", "list_avg(xs[1:14])", 13 / 14, 1 / 14)} AS y
   FROM (SELECT symbol, list(dx ORDER BY bar_ix) AS xs FROM di GROUP BY symbol) WHERE len(xs) >= 15)""", "di")


@query("IND6", with_("adx14", body="SELECT b.symbol, b.bar_ix, d.p AS di_plus_14, d.m AS di_minus_14, a.adx AS adx_14 FROM bars b LEFT JOIN di d USING (symbol, bar_ix) LEFT JOIN adx14 a USING (symbol, bar_ix)"),
       round={"di_plus_14": 6, "di_minus_14": 6, "adx_14": 6})
def ind6(t):
    return _frame(t, Needs(adx={14}), "di_plus_14", "di_minus_14", "adx_14")


@query("IND7", with_("bars", body="""SELECT symbol, bar_ix, CASE WHEN bar_ix >= 20 THEN max(high) OVER w END AS high_20, CASE WHEN bar_ix >= 20 THEN min(low) OVER w END AS low_20
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_ix ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"""))
def ind7(t):
    return _frame(t, Needs(high={20}, low={20}), "high_20", "low_20")


@query("IND8", with_("ind", body="SELECT symbol, bar_ix, ibs FROM ind"), round={"ibs": 9})
def ind8(t):
    return _frame(t, Needs(), "ibs")


@query("IND9", with_("bars", body="SELECT symbol, date, dom, days_left FROM bars"))
def ind9(t):
    return t.bars().select("symbol", "date", "dom", "days_left")


@query("IND10", with_("bars", body="SELECT symbol, bar_ix, " + ", ".join(f"{sma_sql(p)} AS sma_{p}" for p in (3, 5, 7, 10, 150, 200, 250)) + " FROM bars"),
       round={f"sma_{p}": 6 for p in (3, 5, 7, 10, 150, 200, 250)})
def ind10(t):
    grid = [{k: v for k, v in p.items() if k.startswith("sma") and k.endswith("period")} for p in [*RSI2.combos(), RSI2.params()]]
    periods = periods_of(grid)
    return _frame(t, Needs(sma=periods), *[f"sma_{p}" for p in sorted(periods)])


@query("IND11", with_("bars", body="SELECT symbol, CASE WHEN count(*) <= 1 THEN 1.0 ELSE count(*) * 365.0 / 252.0 END AS total_days FROM bars GROUP BY symbol"), round={"total_days": 6})
def ind11(t):
    n = F.count(F.lit(1))
    return t.bars().groupBy("symbol").agg(F.when(n <= 1, F.lit(1.0)).otherwise(n * 365.0 / 252.0).alias("total_days"))


def snapshot(t, end=None):
    """Latest bar per symbol with what the daily rules read."""
    needs = Needs(sma={5, 200}, rsi={2})
    b = t.bars() if end is None else t.bars().filter(F.col("date") <= F.lit(end).cast("date"))
    f = home_rows(indicator_frame(b, needs)).withColumn("ibs", F.coalesce("ibs", F.lit(0.5)))
    cols = ["bar_ix", "date", "open", "high", "low", "close", "prev_high", "rsi_2", "sma_5", "sma_200", "ibs", "dom", "days_left"]
    left = F.col("days_left") if end is None else None
    last = f.groupBy("symbol").agg(F.max_by(F.struct(*cols), "bar_ix").alias("r"))
    out = last.select("symbol", "r.*")
    # the newest bar always counts as the last one of the bars present in its month
    return out.withColumn("days_left", F.lit(1)) if left is None else out


cte("snap", """SELECT i.symbol, i.bar_ix, i.date, i.open, i.high, i.low, i.close, i.p_high AS prev_high, r.rsi_2, i.sma_5, i.sma_200,
  coalesce(i.ibs, 0.5) AS ibs, i.dom, i.days_left FROM ind i LEFT JOIN rsi2 r USING (symbol, bar_ix)
  QUALIFY row_number() OVER (PARTITION BY i.symbol ORDER BY i.bar_ix DESC) = 1""", "ind", "rsi2")
SNAP_DIGITS = {"rsi_2": 6, "sma_5": 6, "sma_200": 6, "ibs": 6}


@query("IND12", with_("snap", body="SELECT * FROM snap"), round=SNAP_DIGITS)
def ind12(t):
    return snapshot(t)


@query("IND13", with_("ind", body="SELECT symbol, avg(CASE WHEN close > sma_200 THEN 1.0 ELSE 0.0 END) * 100 AS pct_above FROM ind WHERE sma_200 IS NOT NULL GROUP BY symbol"), round={"pct_above": 6})
def ind13(t):
    f = _frame(t, Needs(sma={200}), "close", "sma_200").filter("sma_200 IS NOT NULL")
    return f.groupBy("symbol").agg((F.avg(F.when(F.col("close") > F.col("sma_200"), 1.0).otherwise(0.0)) * 100).alias("pct_above"))


@query("IND14", with_("ind", "rsi2", body="""SELECT symbol, count(*) FILTER (r < 5) AS below_5, count(*) FILTER (r < 10) AS below_10, count(*) FILTER (r < 25) AS below_25,
  count(*) FILTER (p_close > p_sma_200) AS trend_ok, count(*) FILTER (r < 10 AND p_close > p_sma_200) AS both_ok
  FROM (SELECT i.*, lag(q.rsi_2) OVER (PARTITION BY symbol ORDER BY bar_ix) AS r FROM ind i LEFT JOIN rsi2 q USING (symbol, bar_ix)) GROUP BY symbol"""))
def ind14(t):
    needs = Needs(sma={200}, rsi={2}).lag("rsi_2").lag("close").lag("sma_200")
    f = home_rows(indicator_frame(t.bars(), needs))
    r, ok = F.col("rsi_2_lag1"), F.col("close_lag1") > F.col("sma_200_lag1")
    return f.groupBy("symbol").agg(F.count_if(r < 5).alias("below_5"), F.count_if(r < 10).alias("below_10"), F.count_if(r < 25).alias("below_25"),
                                   F.count_if(ok).alias("trend_ok"), F.count_if((r < 10) & ok).alias("both_ok"))


def trend_context(t, trades):
    """Trades with the slope of the 200-bar mean over 20 bars and the distance to it, at the signal bar."""
    needs = Needs(sma={200}).lag("sma_200").lag("sma_200", 21).lag("close")
    f = home_rows(indicator_frame(t.bars(), needs)).select("symbol", F.col("bar_ix").alias("entry_ix"), "sma_200_lag1", "sma_200_lag21", "close_lag1")
    now, ago = F.col("sma_200_lag1"), F.col("sma_200_lag21")
    out = trades.join(f, ["symbol", "entry_ix"]).filter((F.col("entry_ix") >= 20) & (ago > 0) & now.isNotNull())
    return out.withColumn("slope_pct", (now - ago) / ago * 100).withColumn("distance_pct", (F.col("close_lag1") - now) / now * 100)


cte("tctx", """SELECT t.*, (i.p_sma_200 - g.ago) / g.ago * 100 AS slope_pct, (i.p_close - i.p_sma_200) / i.p_sma_200 * 100 AS distance_pct
  FROM tr t JOIN ind i ON i.symbol = t.symbol AND i.bar_ix = t.entry_ix
  JOIN (SELECT symbol, bar_ix, lag(sma_200, 21) OVER (PARTITION BY symbol ORDER BY bar_ix) AS ago FROM ind) g ON g.symbol = t.symbol AND g.bar_ix = t.entry_ix
  WHERE g.ago > 0 AND i.p_sma_200 IS NOT NULL AND t.entry_ix >= 20""", "tr", "ind")


@query("IND15", with_("tctx", body="SELECT symbol, entry_ix, slope_pct, distance_pct FROM tctx"), round={"slope_pct": 6, "distance_pct": 6})
def ind15(t):
    return trend_context(t, t.ibs_trades()).select("symbol", "entry_ix", "slope_pct", "distance_pct")
