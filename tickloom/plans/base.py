"""Query registry, the tables queries start from, and the shared CTEs of the check SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions import scalars as S
from ..operators.equity import daily_equity
from ..operators.indicators import Needs, home_rows, indicator_frame
from ..operators.ledger import Account, ledger
from ..operators.metrics import profit_factor, t_test, trade_metrics
from ..operators.rules import IBS
from ..session import materialise
from ..sources import bars as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_BUILT: dict[tuple, DataFrame] = {}
SPLIT, MID, AS_OF = "1998-01-01", "2000-01-01", "2001-11-04"


@dataclass
class Tables:
    """Inputs of one query run: given tables and what Spark derives from them."""

    spark: SparkSession
    sf_dir: str

    def raw(self, name: str) -> DataFrame:
        return B.read_table(self.spark, self.sf_dir, name)

    def _kept(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """Built once per application and state of the data folder, stored in the shared folder."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, folder_state(self.spark, self.sf_dir), name)
        if key not in _BUILT:
            _BUILT[key] = materialise(build(), name)
        return _BUILT[key]

    def bars(self, grain: str = "region") -> DataFrame:
        """Daily bars from order lines, indexed and clustered by symbol and date."""
        def build():
            ticks = B.lineitem_ticks(self.spark, self.sf_dir, grain)
            return B.index_bars(B.ohlcv(ticks, ["symbol"], "date")).sortWithinPartitions("symbol", "date")
        return self._kept(f"bars-{grain}", build)

    def hourly(self) -> DataFrame:
        """Hourly bars from events."""
        def build():
            bars = B.ohlcv(B.event_ticks(self.spark, self.sf_dir), ["symbol"], "date")
            return B.index_bars(bars, bucket=F.to_date("date"))
        return self._kept("bars-hourly", build)

    def ibs_trades(self) -> DataFrame:
        """Trades of the default range-position rule on a fractional account."""
        return self._kept("ibs-trades", lambda: ledger(self.bars(), IBS, account=ACCOUNT).drop("combo_id"))

    def equity(self) -> DataFrame:
        """Daily equity per symbol of those trades."""
        return self._kept("daily-equity", lambda: daily_equity(self.ibs_trades(), self.bars(), ACCOUNT.capital))

    def all_trades(self) -> DataFrame:
        """Trades of three settings of the range-position rule, as strategies."""
        def build():
            combos = [IBS.params(ibs_entry_threshold=a, ibs_exit_threshold=b) for a, b in STRATEGIES.values()]
            name = F.array(*[F.lit(k) for k in STRATEGIES])
            return ledger(self.bars(), IBS, combos, ACCOUNT).withColumn("strategy", name[F.col("combo_id")]).drop("combo_id")
        return self._kept("all-trades", build)

    def screened_trades(self) -> DataFrame:
        """Closed trades once per screening run they belong to: the first run knows those closed before 2000, the second all."""
        stamps = [F.lit(r).cast("timestamp") for r in RUNS]
        runs = F.when(F.col("exit_date") < F.lit(MID).cast("date"), F.array(*stamps)).otherwise(F.array(stamps[1]))
        universe = F.when(F.col("symbol").isin("AMERICA", "EUROPE"), "north").otherwise("south")
        return self.all_trades().filter("closed").withColumn("universe", universe).withColumn("timestamp", F.explode(runs))

    def screens(self) -> DataFrame:
        """Two screening runs: one on trades closed before 2000, one on all."""
        return self._kept("screens", lambda: trade_metrics(self.screened_trades(), SCREEN_KEYS).drop("final_capital"))

    def validations(self) -> DataFrame:
        """Screening rows with their tests: grid, halves, significance, verdict.

        ``robustness_pct`` is the share of the whole grid that earns on the symbol in the out-of-sample trades closed by
        the run; the halves of a run meet at the start of the out-of-sample period (first run) or in its middle.
        """
        def build():
            tr = self.screened_trades()
            first = F.col("exit_date") < F.when(F.col("timestamp") == F.lit(RUNS[0]).cast("timestamp"), F.lit(SPLIT)).otherwise(F.lit(MID)).cast("date")
            halves = tr.groupBy(*SCREEN_KEYS).agg(profit_factor(F.when(first, F.col("pnl"))).alias("_a"), profit_factor(F.when(~first, F.col("pnl"))).alias("_b"))
            tests = t_test(tr, SCREEN_KEYS).select(*SCREEN_KEYS, F.col("p_value").alias("ttest_p"))
            combos, start = IBS.combos(), F.col("date") >= F.lit(SPLIT).cast("date")
            stamps = [F.lit(r).cast("timestamp") for r in RUNS]
            runs = F.when(F.col("exit_date") < F.lit(MID).cast("date"), F.array(*stamps)).otherwise(F.array(stamps[1]))
            grid = ledger(self.bars(), IBS, combos, ACCOUNT, start=start).filter("closed").withColumn("timestamp", F.explode(runs))
            grid = trade_metrics(grid, ["timestamp", "symbol", "combo_id"]).groupBy("timestamp", "symbol")
            grid = grid.agg((F.count_if((F.col("n_trades") >= 3) & (F.col("profit_factor") > 1)) / len(combos) * 100).alias("robustness_pct"))
            v = self.screens().join(halves, SCREEN_KEYS).join(tests, SCREEN_KEYS).join(grid, ["timestamp", "symbol"], "left").fillna(0.0, ["robustness_pct"])
            v = v.withColumn("stable", (F.col("_a") > 1) & (F.col("_b") > 1)).drop("_a", "_b")
            return v.withColumn("verdict", S.verdict(F.col("robustness_pct") >= 80, F.col("stable"), F.col("ttest_p") < 0.1))
        return self._kept("validations", build)

    def paper(self) -> DataFrame:
        """Paper positions of all strategies: whole shares for 5000 per trade; some closes are not booked yet."""
        def build():
            p = self.all_trades()
            settled = (F.col("strategy") == "ibs") & F.col("symbol").isin("AFRICA", "EUROPE")
            due = F.col("closed") & ((F.col("entry_ix") % 5 != 0) | settled)
            return _positions(p, F.coalesce(due, F.lit(False)))
        return self._kept("paper", build)

    def desk(self) -> DataFrame:
        """The paper positions known on the book date: closes booked 8 days late."""
        def build():
            d = F.lit(BOOK).cast("date")
            p = self.all_trades().filter((F.col("entry_date") <= d) & (F.col("strategy") != "ibs_tight"))
            return _positions(p, F.coalesce(F.col("closed") & (F.col("exit_date") <= F.date_sub(d, 8)), F.lit(False)))
        return self._kept("desk", build)

    def live(self) -> DataFrame:
        """Live trades that follow the paper positions at slightly worse prices; every second one is not linked to its position."""
        def build():
            p = self.paper()
            linked = F.substring_index("id", "-", -1).cast("int") % 2 == 0
            ep, xp = F.col("entry_price") * 1.001, F.col("exit_price") * 0.999
            pnl = (xp - ep) * F.col("shares") - 2.0
            return p.select(F.concat(F.lit("L"), "id").alias("id"), "strategy", "symbol", "entry_date", ep.alias("entry_price"), "shares", "status", "exit_date",
                            xp.alias("exit_price"), F.lit(1.0).alias("fees_entry"), F.when(F.col("status") == "closed", F.lit(1.0)).alias("fees_exit"), pnl.alias("pnl_dollars"),
                            (pnl / (ep * F.col("shares")) * 100).alias("pnl_pct"), F.lit("filled").alias("notes"), F.when(linked, F.col("id")).alias("paper_position_id"))
        return self._kept("live", build)

    def signal_log(self) -> DataFrame:
        """Signals of all strategies on every date."""
        def build():
            f = home_rows(indicator_frame(self.bars(), Needs(sma={200})))
            ok = F.coalesce(F.col("close") > F.col("sma_200"), F.lit(False))
            ibs_row = lambda name, entry: F.struct(
                F.lit(name).alias("strategy"), F.when((F.col("ibs") < entry) & ok, "BUY").otherwise("NO_SIGNAL").alias("signal"), F.col("ibs").alias("indicator_value"),
                F.to_json(F.struct(F.round("ibs", 4).alias("ibs"), ok.alias("trend_ok"))).alias("details_json"))
            tom_row = F.struct(F.lit("ibs_loose").alias("strategy"), F.when(F.col("days_left") <= 5, "BUY").otherwise("NO_SIGNAL").alias("signal"), F.col("days_left").cast("double").alias("indicator_value"),
                               F.to_json(F.struct(F.col("days_left").alias("days_left"))).alias("details_json"))
            return f.select(F.col("date").cast("timestamp").alias("timestamp"), "symbol", F.col("close").alias("close_price"), F.inline(F.array(ibs_row("ibs", 0.2), tom_row, ibs_row("ibs_tight", 0.15))))
        return self._kept("signal-log", build)

    def raw_history(self) -> DataFrame:
        """Bars as a provider would deliver them: a 4:1 split in one symbol, a few bad rows."""
        b = self.bars().select("symbol", "date", "open", "high", "low", "close", "volume")
        before = (F.col("symbol") == "ASIA") & (F.col("date") < F.lit("1998-06-01").cast("date"))
        k = F.when(before, F.lit(4.0)).otherwise(F.lit(1.0))
        hole = (F.col("symbol") == "EUROPE") & (F.dayofmonth("date") == 13)
        flipped = (F.col("symbol") == "AFRICA") & (F.dayofyear("date") == 45)
        return b.select(
            "symbol", "date", (F.col("open") * k).alias("open"),
            F.when(flipped, F.col("low") - 1).otherwise(F.col("high") * k).alias("high"),
            (F.col("low") * k).alias("low"), F.when(~hole, F.col("close") * k).alias("close"),
            F.col("close").alias("adj_close"), "volume",
        )


def folder_state(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of what a folder holds: tables derived from changed files are built anew."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    held = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in held))


def _positions(trades: DataFrame, shut) -> DataFrame:
    """Trades as paper positions; those not ``shut`` are open and have no exit."""
    p = trades.withColumns({
        "id": F.concat_ws("-", "strategy", "symbol", "entry_ix"), "shares": F.floor(5000 / F.col("entry_price")).cast("double"),
        "status": F.when(shut, "closed").otherwise("open"), "exit_date": F.when(shut, F.col("exit_date")), "exit_price": F.when(shut, F.col("exit_price"))})
    gain = F.col("exit_price") - F.col("entry_price")
    return p.select("id", "strategy", "symbol", "entry_date", "entry_price", "shares", "status", "exit_date", "exit_price",
                    (gain * F.col("shares")).alias("pnl_dollars"), (gain / F.col("entry_price") * 100).alias("pnl_pct"),
                    F.concat(F.lit("entry "), "symbol").alias("notes"), F.when(F.month("entry_date") == 12, F.lit("december")).alias("tags"))


STRATEGIES = {"ibs": (0.2, 0.8), "ibs_loose": (0.25, 0.7), "ibs_tight": (0.15, 0.9)}
RUNS = ("2000-01-01 18:00:00", "2001-11-05 18:00:00")
SCREEN_KEYS = ["timestamp", "strategy", "universe", "symbol"]
BOOK = "2000-03-17"
ACCOUNT = Account(capital=100_000.0, slippage=0.0003, fees="forex_saxo")
STRICT = Account(capital=10_000.0, slippage=0.0003, fees="us_stocks_usd_account", whole_shares=True)


def query(name: str, sql: str | None = None, round: dict[str, int] | None = None, ints: tuple[str, ...] = ()):
    """Register a query and, where SQL can say the same, its check.

    Both sides get the same finish: rounding of the named doubles (never minus zero),
    infinity as NULL, whole numbers as 64-bit.
    """
    digits = round or {}

    def deco(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _finish(fn(Tables(spark, sf_dir)), digits)

        QUERIES[name] = run
        if sql is not None:
            rep = ", ".join(f"round(CASE WHEN isfinite(CAST({c} AS DOUBLE)) THEN CAST({c} AS DOUBLE) END, {d}) + 0.0 AS {c}" for c, d in digits.items())
            rep = ", ".join(filter(None, [rep, *[f"CAST({c} AS BIGINT) AS {c}" for c in ints]]))
            ORACLES[name] = f"SELECT * REPLACE ({rep}) FROM ({sql})" if rep else sql
        return fn

    return deco


def _finish(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in digits:
            d = c.cast("double")
            c = F.round(F.when(F.abs(d) < float("inf"), d), digits[f.name]) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("long")
        cols.append(c.alias(f.name))
    return df.select(*cols)


# ---------------------------------------------------------------- check SQL

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, sql: str, *deps: str) -> None:
    CTES[name] = (deps, sql)


def with_(*names: str, body: str) -> str:
    seen: list[str] = []

    def visit(n: str) -> None:
        if n in seen:
            return
        for d in CTES[n][0]:
            visit(d)
        seen.append(n)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in seen) + "\n" + body


cte("ticks", """
 SELECT r_name AS symbol, CAST(l_shipdate AS DATE) AS date, {'o': l_orderkey, 'l': l_linenumber} AS k,
        CAST(floor(p_retailprice * (1 - l_discount) * 100 + 0.5) AS BIGINT) AS cents, l_quantity AS qty
 FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
 JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
cte("bars0", """
 SELECT symbol, date, CAST(arg_min(cents, {'k': k, 'c': cents}) AS DOUBLE) / CAST(100 AS DOUBLE) AS open,
        CAST(max(cents) AS DOUBLE) / CAST(100 AS DOUBLE) AS high, CAST(min(cents) AS DOUBLE) / CAST(100 AS DOUBLE) AS low,
        CAST(arg_max(cents, {'k': k, 'c': cents}) AS DOUBLE) / CAST(100 AS DOUBLE) AS close, sum(qty) AS volume
 FROM ticks GROUP BY symbol, date""", "ticks")
cte("bars", """
 SELECT *, CAST(date_trunc('month', date) AS DATE) AS month,
        row_number() OVER (PARTITION BY symbol, date_trunc('month', date) ORDER BY date) AS dom,
        count(*) OVER (PARTITION BY symbol, date_trunc('month', date))
          - row_number() OVER (PARTITION BY symbol, date_trunc('month', date) ORDER BY date) + 1 AS days_left,
        row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS bar_ix
 FROM bars0""", "bars0")


def sma_sql(p: int, partition: str = "symbol") -> str:
    w = f"OVER (PARTITION BY {partition} ORDER BY bar_ix ROWS BETWEEN {p - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN bar_ix >= {p - 1} THEN avg(CAST(round(close * 1e6) AS BIGINT)) {w} / 1e6 END"


IBS_SQL = "CASE WHEN high - low > 0 THEN (close - low) / (high - low) END"
cte("ind", f"""
 SELECT *, lag(ibs) OVER s AS p_ibs, lag(close) OVER s AS p_close, lag(high) OVER s AS p_high, lag(low) OVER s AS p_low,
        lag(days_left) OVER s AS p_left, lag(sma_200) OVER s AS p_sma_200, lag(sma_150) OVER s AS p_sma_150,
        lag(sma_250) OVER s AS p_sma_250, lag(sma_100) OVER s AS p_sma_100
 FROM (SELECT *, {IBS_SQL} AS ibs, {sma_sql(3)} AS sma_3, {sma_sql(5)} AS sma_5, {sma_sql(7)} AS sma_7, {sma_sql(10)} AS sma_10,
   {sma_sql(100)} AS sma_100, {sma_sql(150)} AS sma_150, {sma_sql(200)} AS sma_200, {sma_sql(250)} AS sma_250 FROM bars)
 WINDOW s AS (PARTITION BY symbol ORDER BY bar_ix)""", "bars")
cte("last_bar", "SELECT symbol, max(bar_ix) AS mark_ix, arg_max(close, bar_ix) AS mark_price FROM bars GROUP BY symbol", "bars")


def ibs_ctes(p: str, thr=0.2, xthr=0.8, sma=200, where="true", frac=0.2, cap=100000.0) -> str:
    """CTE chain for one parameter set of the range-position rule; returns the trade CTE name."""
    cte(f"{p}_sig", f"""
     SELECT *, coalesce(p_ibs < {thr} AND p_close > p_sma_{sma} AND bar_ix >= {sma + 10} AND ({where}), false) AS entry,
       CASE WHEN NOT ({where}) THEN NULL WHEN ibs > {xthr} THEN 'ibs_exit' WHEN close > p_high THEN 'prev_high_exit'
            WHEN close < sma_{sma} THEN 'trend_break' END AS reason FROM ind""", "ind")
    cte(f"{p}_nx", f"""
     SELECT *, min(CASE WHEN reason IS NOT NULL THEN bar_ix END) OVER (PARTITION BY symbol ORDER BY bar_ix
       ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS xix FROM {p}_sig""", f"{p}_sig")
    cte(f"{p}_raw", f"""
     SELECT e.symbol, e.bar_ix AS entry_ix, e.date AS entry_date, e.open * (1 + CAST(0.0003 AS DOUBLE)) AS entry_price,
       x.bar_ix AS exit_ix, x.date AS exit_date, coalesce(x.close, m.mark_price) AS exit_price, x.reason AS exit_reason,
       x.bar_ix IS NOT NULL AS closed, coalesce(x.bar_ix, m.mark_ix) - e.bar_ix AS holding_days, CAST(1 AS BIGINT) AS direction
     FROM (SELECT symbol, xix, min(bar_ix) AS eix FROM {p}_nx WHERE entry GROUP BY symbol, xix) g
     JOIN {p}_sig e ON e.symbol = g.symbol AND e.bar_ix = g.eix
     LEFT JOIN {p}_sig x ON x.symbol = g.symbol AND x.bar_ix = g.xix
     JOIN (SELECT symbol, max(bar_ix) AS mark_ix, arg_max(close, bar_ix) AS mark_price FROM {p}_sig WHERE {where} GROUP BY symbol) m
       ON m.symbol = g.symbol""", f"{p}_nx")
    cte(f"{p}_ret", f"""
     SELECT *, (exit_price - entry_price) / entry_price - 0.000075 - exit_price / entry_price * 0.000075 AS return_pct
     FROM {p}_raw""", f"{p}_raw")
    cte(p, f"""
     SELECT *, before * {frac} * return_pct AS pnl, before * (1 + {frac} * return_pct) AS capital_after,
       before * {frac} / entry_price AS quantity, before * {frac} * 0.000075 AS entry_fee,
       before * {frac} / entry_price * exit_price * 0.000075 AS exit_fee
     FROM (SELECT *, CAST({cap} AS DOUBLE) * coalesce(product(1 + {frac} * return_pct) OVER (PARTITION BY symbol ORDER BY entry_ix
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS before FROM {p}_ret)""", f"{p}_ret")
    return p


ibs_ctes("tr")


def pf_sql(pnl: str = "pnl", cond: str = "true", inf: str = "NULL") -> str:
    """Profit factor; infinity is NULL unless asked for."""
    win = f"coalesce(sum(CASE WHEN {cond} AND {pnl} > 0 THEN {pnl} END), 0)"
    loss = f"abs(coalesce(sum(CASE WHEN {cond} AND {pnl} <= 0 THEN {pnl} END), 0))"
    return f"CASE WHEN {loss} = 0 THEN (CASE WHEN {win} > 0 THEN {inf} ELSE 0 END) ELSE {win} / {loss} END"


def sharpe_sql(cond: str = "true") -> str:
    c = lambda x: f"CASE WHEN {cond} THEN {x} END"
    n, sd = f"count({c('return_pct')})", f"stddev_pop({c('return_pct')})"
    span = f"greatest(max({c('exit_ix')}) - min({c('entry_ix')}), 1)"
    return f"CASE WHEN {n} >= 2 AND {sd} > 0 THEN avg({c('return_pct')}) / {sd} * sqrt({n} / ({span} / 252.0)) ELSE 0 END"


INF = "'infinity'::DOUBLE"


def metrics_sql(table: str, keys: str = "symbol", capital: float = 100000.0, inf: str = "NULL") -> str:
    return f"""SELECT {keys}, count(CASE WHEN closed THEN 1 END) AS n_trades,
      CASE WHEN count(CASE WHEN closed THEN 1 END) > 0 THEN count(CASE WHEN closed AND pnl > 0 THEN 1 END) / count(CASE WHEN closed THEN 1 END) ELSE 0 END AS win_rate,
      {pf_sql(cond='closed', inf=inf)} AS profit_factor, {sharpe_sql('closed')} AS sharpe,
      coalesce(sum(pnl), 0) / {capital} * 100 AS net_return_pct, coalesce(sum(pnl), 0) + {capital} AS final_capital
      FROM {table} GROUP BY {keys}"""


METRIC_DIGITS = {"win_rate": 6, "profit_factor": 6, "sharpe": 6, "net_return_pct": 6, "final_capital": 4}


def walk_cte(name: str, cands: str, capital: float, fraction: float, slip: float, fee: tuple, whole: bool,
             cooldown: int = 0, dd: float = 80.0, keys: str = "symbol") -> str:
    """Ordered walk over candidates as a list fold; the candidate CTE has
    entry_ix, entry_date, entry_open, direction, exit_ix, exit_date, exit_raw, exit_reason, exit_slip, mark_ix, mark_price."""
    com, cpct, spr, fx, tax, night = fee
    rate = cpct + spr / 2 + fx
    d = lambda v: f"CAST({v!r} AS DOUBLE)"
    price = f"(c.o * (1 + c.d * {d(slip)}))"
    qty0 = f"(s.cap * {d(fraction)} / {price})"
    qty = f"floor({qty0})" if whole else qty0
    out = f"(CASE WHEN c.x IS NULL THEN c.mp WHEN c.sl THEN c.xp * (1 - c.d * {d(slip)}) ELSE c.xp END)"
    held = "(coalesce(c.x, c.mi) - c.e)"
    fin, fout = f"({d(com)} + {qty} * {price} * {d(rate + tax)})", f"({d(com)} + {out} * {qty} * {d(rate)})"
    pnl = f"(c.d * ({out} - {price}) * {qty} - {fin} - {fout} - {qty} * {price} * {d(night)} * {held})"
    # one field per value, so each is computed once
    state = "{'cap': %s, 'peak': %s, 'free': %s, 'halt': %s, 'skip': %s, 'out': %s}"
    row = (f"{{'entry_ix': c.e, 'entry_date': c.ed, 'exit_ix': c.x, 'exit_date': c.xd, 'entry_price': {price}, 'exit_price': {out}, "
           f"'quantity': {qty}, 'pnl': {pnl}, 'return_pct': {pnl} / ({qty} * {price}), 'holding_days': {held}, 'exit_reason': c.r, "
           f"'closed': c.x IS NOT NULL, 'capital_after': s.cap + {pnl}, 'direction': c.d}}")
    same = state % ("s.cap", "s.peak", "s.free", "s.halt", "s.skip", "s.out")
    stop = state % ("s.cap", "s.peak", "s.free", "true", "s.skip", "s.out")
    skip = state % ("s.cap", "s.peak", "s.free", "s.halt", "s.skip + 1", "s.out")
    take = state % (f"s.cap + {pnl}", f"CASE WHEN c.x IS NULL THEN s.peak ELSE greatest(s.peak, s.cap + {pnl}) END",
                    f"CASE WHEN c.x IS NULL THEN s.free ELSE c.x + {1 + cooldown} END", "c.x IS NULL", "s.skip", f"list_append(s.out, {row})")
    cond = f"WHEN s.halt OR c.e < s.free THEN {same} WHEN s.cap < s.peak * {d(1 - dd / 100)} THEN {stop} "
    cond += f"WHEN {qty} < 1 THEN {skip} " if whole else ""
    init = ("{'cap': %s, 'peak': %s, 'free': CAST(-1 AS BIGINT), 'halt': false, 'skip': CAST(0 AS BIGINT), 'out': "
            "CAST([] AS STRUCT(entry_ix BIGINT, entry_date DATE, exit_ix BIGINT, exit_date DATE, entry_price DOUBLE, exit_price DOUBLE, "
            "quantity DOUBLE, pnl DOUBLE, return_pct DOUBLE, holding_days BIGINT, exit_reason VARCHAR, closed BOOLEAN, "
            "capital_after DOUBLE, direction BIGINT)[])}") % (d(capital), d(capital))
    cte(f"{name}_walk", f"""
     SELECT {keys}, list_reduce(list({{'e': entry_ix, 'ed': entry_date, 'o': entry_open, 'd': CAST(direction AS BIGINT), 'x': exit_ix, 'xd': exit_date,
        'xp': exit_raw, 'r': exit_reason, 'sl': exit_slip, 'mi': mark_ix, 'mp': mark_price}} ORDER BY entry_ix, direction DESC),
        lambda s, c: CASE {cond} ELSE {take} END, {init}) AS w FROM {cands} GROUP BY {keys}""", cands)
    cte(f"{name}_state", f"SELECT {keys}, w.skip AS n_skipped, w.cap AS final_capital FROM {name}_walk", f"{name}_walk")
    cte(name, f"SELECT {keys}, unnest(w.out, recursive := true) FROM {name}_walk", f"{name}_walk")
    return name


# ---------------------------------------------------------------- stored tables

for _k, (_a, _b) in STRATEGIES.items():
    ibs_ctes(f"st_{_k}", thr=_a, xthr=_b)
cte("all_trades", " UNION ALL ".join(f"SELECT '{k}' AS strategy, * FROM st_{k}" for k in STRATEGIES), *[f"st_{k}" for k in STRATEGIES])
cte("screen_src", f"""SELECT *, CASE WHEN symbol IN ('AMERICA', 'EUROPE') THEN 'north' ELSE 'south' END AS universe,
  CAST(unnest(CASE WHEN exit_date < DATE '{MID}' THEN ['{RUNS[0]}', '{RUNS[1]}'] ELSE ['{RUNS[1]}'] END) AS TIMESTAMP) AS timestamp FROM all_trades WHERE closed""", "all_trades")
cte("screens", f"SELECT * EXCLUDE (final_capital) FROM ({metrics_sql('screen_src', 'timestamp, strategy, universe, symbol')})", "screen_src")
def _positions_sql(shut: str, where: str = "true") -> str:
    return f"""SELECT id, strategy, symbol, entry_date, entry_price, shares, CASE WHEN shut THEN 'closed' ELSE 'open' END AS status, CASE WHEN shut THEN exit_date END AS exit_date, CASE WHEN shut THEN exit_price END AS exit_price,
   CASE WHEN shut THEN (exit_price - entry_price) * shares END AS pnl_dollars, CASE WHEN shut THEN (exit_price - entry_price) / entry_price * 100 END AS pnl_pct, 'entry ' || symbol AS notes, CASE WHEN month(entry_date) = 12 THEN 'december' END AS tags
  FROM (SELECT *, strategy || '-' || symbol || '-' || entry_ix AS id, floor(5000 / entry_price) AS shares, coalesce({shut}, false) AS shut FROM all_trades WHERE {where})"""


cte("paper", _positions_sql("closed AND (entry_ix % 5 <> 0 OR strategy = 'ibs' AND symbol IN ('AFRICA', 'EUROPE'))"), "all_trades")
cte("desk", _positions_sql(f"closed AND exit_date <= DATE '{BOOK}' - 8", f"entry_date <= DATE '{BOOK}' AND strategy <> 'ibs_tight'"), "all_trades")
cte("live", """SELECT 'L' || id AS id, strategy, symbol, entry_date, ep AS entry_price, shares, status, exit_date, xp AS exit_price, 1.0 AS fees_entry, CASE WHEN status = 'closed' THEN 1.0 END AS fees_exit,
   (xp - ep) * shares - 2.0 AS pnl_dollars, ((xp - ep) * shares - 2.0) / (ep * shares) * 100 AS pnl_pct, 'filled' AS notes, CASE WHEN CAST(split_part(id, '-', -1) AS INT) % 2 = 0 THEN id END AS paper_position_id
  FROM (SELECT *, entry_price * CAST(1.001 AS DOUBLE) AS ep, exit_price * CAST(0.999 AS DOUBLE) AS xp FROM paper)""", "paper")
cte("signal_log", """SELECT CAST(date AS TIMESTAMP) AS timestamp, symbol, close AS close_price, v.name AS strategy, CASE WHEN ibs < v.entry AND close > sma_200 THEN 'BUY' ELSE 'NO_SIGNAL' END AS signal, ibs AS indicator_value, coalesce(close > sma_200, false) AS trend_ok, NULL AS left_days FROM ind, (VALUES ('ibs', 0.2), ('ibs_tight', 0.15)) v(name, entry)
  UNION ALL SELECT CAST(date AS TIMESTAMP), symbol, close, 'ibs_loose', CASE WHEN days_left <= 5 THEN 'BUY' ELSE 'NO_SIGNAL' END, days_left, NULL, days_left FROM ind""", "ind")
