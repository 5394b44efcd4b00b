"""Queries on trade metrics, validation and trade forensics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sqlnames
from ..operators import equity as E, forensics as X, metrics as M, sketches as K
from ..operators.ledger import ledger, variant
from ..operators.ranks import percentiles, ranked
from ..operators.rules import IBS, RSI2, TOM
from ..operators.validation import Periods, grid_metrics, halves, usable_symbols, validate
from ..presets import FEES, STOP_LEVELS
from .base import ACCOUNT, INF, METRIC_DIGITS, MID, RUNS, SPLIT, STRICT, cte, ibs_ctes, metrics_sql, pf_sql, query, sharpe_sql, walk_cte, with_
from .inputs import trend_context
from .trading import ITOM, _US, tail_sql

_M = ["symbol", "n_trades", "win_rate", "profit_factor", "sharpe", "net_return_pct", "final_capital"]


def closed(t):
    return t.ibs_trades().filter("closed")


cte("trc", "SELECT * FROM tr WHERE closed", "tr")


@query("AGG1", with_("tr", body=metrics_sql("tr")), round=METRIC_DIGITS)
def agg1(t):
    return M.trade_metrics(ledger(t.bars(), IBS, account=ACCOUNT), ["symbol"])


cte("rsi_post", """SELECT *, before * 0.2 * r AS pnl, 0.2 * r / (1 + 0.2 * r) AS return_pct FROM (
  SELECT *, 100000 * coalesce(product(1 + 0.2 * r) OVER (PARTITION BY symbol ORDER BY entry_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS before
  FROM (SELECT *, (exit_price - entry_price) / entry_price - 0.000075 - exit_price / entry_price * 0.000075 AS r FROM rsi_old))""", "rsi_old")
cte("old_ibs", "SELECT *, pnl / capital_after AS ret2 FROM tr WHERE closed", "tr")


@query("AGG2", with_("old_ibs", "bars", body=f"""SELECT symbol, count(*) AS n_trades, sum(pnl) / 100000 * 100 AS net_return_pct, {pf_sql()} AS profit_factor,
  CASE WHEN count(*) >= 3 AND stddev_pop(ret2) > 1e-10 THEN least(100.0, avg(ret2) / stddev_pop(ret2) * sqrt(count(*) / greatest(any_value(d), 1.0) * 365)) ELSE 0 END AS sharpe
  FROM old_ibs JOIN (SELECT symbol, count(*) * 365.0 / 252.0 AS d FROM bars GROUP BY symbol) USING (symbol) GROUP BY symbol"""), round={"net_return_pct": 6, "profit_factor": 6, "sharpe": 6})
def agg2(t):
    days = t.bars().groupBy("symbol").agg((F.count(F.lit(1)) * 365.0 / 252.0).alias("total_days"))
    tr = closed(t).withColumn("ret", F.col("pnl") / F.col("capital_after"))
    g = tr.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_trades"), (F.sum("pnl") / 100_000.0 * 100).alias("net_return_pct"), M.profit_factor(F.col("pnl")).alias("profit_factor"),
        F.avg("ret").alias("_m"), F.stddev_pop("ret").alias("_s")).join(days, "symbol")
    sh = F.least(F.lit(100.0), F.try_divide(F.col("_m"), F.col("_s")) * F.sqrt(F.col("n_trades") / F.greatest(F.col("total_days"), F.lit(1.0)) * 365))
    return g.withColumn("sharpe", F.when((F.col("n_trades") >= 3) & (F.col("_s") > 1e-10), sh).otherwise(F.lit(0.0))).drop("_m", "_s", "total_days")


_AVG = {"avg_win": 8, "avg_loss": 8, "avg_holding": 6, "avg_pnl": 4, "avg_size": 4}


@query("AGG3", with_("poor_tr", "poor_tr_state", body="""SELECT s.symbol, count(*) FILTER (t.closed) AS n_trades, any_value(s.n_skipped) AS n_skipped, coalesce(avg(t.return_pct) FILTER (t.closed AND t.pnl > 0), 0) AS avg_win,
  coalesce(avg(t.return_pct) FILTER (t.closed AND t.pnl <= 0), 0) AS avg_loss, coalesce(avg(t.holding_days) FILTER (t.closed), 0) AS avg_holding, coalesce(avg(t.pnl) FILTER (t.closed), 0) AS avg_pnl,
  coalesce(avg(t.entry_price * t.quantity) FILTER (t.closed), 0) AS avg_size FROM poor_tr_state s LEFT JOIN poor_tr t USING (symbol) GROUP BY s.symbol"""), round=_AVG)
def agg3(t):
    return M.mean_stats(ledger(t.bars(), IBS, account=variant(STRICT, capital=4600.0)), ["symbol"])


@query("AGG4", with_("trc", body=f"""SELECT coalesce(symbol, 'POOLED') AS symbol, count(*) AS n_trades, count(*) FILTER (pnl > 0) / count(*) AS win_rate, {pf_sql()} AS profit_factor,
  avg(return_pct) * 100 AS mean_return FROM trc GROUP BY ROLLUP (symbol)"""), round={"win_rate": 6, "profit_factor": 6, "mean_return": 6})
def agg4(t):
    g = closed(t).rollup("symbol").agg(F.count(F.lit(1)).alias("n_trades"), M.win_rate(F.col("pnl")).alias("win_rate"), M.profit_factor(F.col("pnl")).alias("profit_factor"), (F.avg("return_pct") * 100).alias("mean_return"))
    return g.withColumn("symbol", F.coalesce("symbol", F.lit("POOLED")))


@query("AGG5", with_("trc", body=f"""SELECT symbol, period, count(*) AS n_trades, count(*) FILTER (pnl > 0) / count(*) AS win_rate, {pf_sql()} AS profit_factor, sum(pnl) AS pnl
  FROM (SELECT *, unnest(CASE WHEN entry_date >= DATE '{SPLIT}' THEN ['full', 'oos'] WHEN exit_date < DATE '{SPLIT}' THEN ['full', 'is'] ELSE ['full'] END) AS period FROM trc) GROUP BY ALL"""), round={"win_rate": 6, "profit_factor": 6, "pnl": 4})
def agg5(t):
    cut = F.lit(SPLIT).cast("date")
    part = F.when(F.col("entry_date") >= cut, F.array(F.lit("full"), F.lit("oos"))).when(F.col("exit_date") < cut, F.array(F.lit("full"), F.lit("is"))).otherwise(F.array(F.lit("full")))
    return closed(t).withColumn("period", F.explode(part)).groupBy("symbol", "period").agg(
        F.count(F.lit(1)).alias("n_trades"), M.win_rate(F.col("pnl")).alias("win_rate"), M.profit_factor(F.col("pnl")).alias("profit_factor"), F.sum("pnl").alias("pnl"))


# grid of the range-position rule in SQL: candidates x grid, next exit per exit setting
cte("gx", """SELECT i.*, e.xthr, e.per, min(CASE WHEN (ibs > e.xthr OR close > p_high OR close < CASE e.per WHEN 150 THEN sma_150 WHEN 200 THEN sma_200 ELSE sma_250 END) AND date >= DATE '%s' THEN bar_ix END)
   OVER (PARTITION BY symbol, e.xthr, e.per ORDER BY bar_ix ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS xix FROM ind i, (SELECT DISTINCT xthr, per FROM igrid) e""" % SPLIT, "ind", "igrid")
cte("gtr0", """SELECT g.symbol, c.combo_id, g.xix AS exit_ix, min(g.bar_ix) AS entry_ix FROM gx g JOIN icand c ON c.symbol = g.symbol AND c.entry_ix = g.bar_ix AND c.xthr = g.xthr AND c.per = g.per
   WHERE g.date >= DATE '%s' GROUP BY ALL""" % SPLIT, "gx", "icand")
cte("gtr1", """SELECT t.symbol, t.combo_id, t.entry_ix, t.exit_ix, t.exit_ix IS NOT NULL AS closed, x.date AS exit_date, e.open * (1 + CAST(0.0003 AS DOUBLE)) AS ep, coalesce(x.close, m.mark_price) AS xp
   FROM gtr0 t JOIN bars e ON e.symbol = t.symbol AND e.bar_ix = t.entry_ix LEFT JOIN bars x ON x.symbol = t.symbol AND x.bar_ix = t.exit_ix JOIN last_bar m ON m.symbol = t.symbol""", "gtr0", "bars", "last_bar")
cte("gtr", """SELECT *, before * 0.2 * return_pct AS pnl FROM (SELECT *, 100000 * coalesce(product(1 + 0.2 * return_pct) OVER (PARTITION BY symbol, combo_id ORDER BY entry_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS before
   FROM (SELECT *, (xp - ep) / ep - 0.000075 - xp / ep * 0.000075 AS return_pct FROM gtr1))""", "gtr1")
cte("gm", f"SELECT symbol, combo_id, count(*) FILTER (closed) AS n_trades, {pf_sql(cond='closed')} AS profit_factor, {sharpe_sql('closed')} AS sharpe FROM gtr GROUP BY ALL", "gtr")
cte("usable", f"""SELECT symbol, start_ix FROM (SELECT symbol, count(*) AS n, greatest(coalesce(min(bar_ix) FILTER (date >= DATE '{SPLIT}'), count(*)), 210) AS start_ix FROM bars GROUP BY symbol) WHERE n - start_ix >= 50""", "bars")
cte("gpf", f"""SELECT s.symbol, g.*, CASE WHEN m.n_trades >= 3 AND s.start_ix >= g.per + 10 THEN coalesce(m.profit_factor, {INF}) ELSE 0 END AS pf
  FROM usable s CROSS JOIN igrid g LEFT JOIN gm m ON m.symbol = s.symbol AND m.combo_id = g.combo_id""", "usable", "igrid", "gm")
cte("rob", """SELECT symbol, count(*) AS n_combos, count(*) FILTER (pf > 1) AS n_profitable, count(*) FILTER (pf > 1) / count(*) * 100 AS pct_profitable, max(pf) AS best_pf, min(pf) AS worst_pf,
  quantile_cont(pf, 0.5) AS median_pf, count(*) FILTER (pf > 1) / count(*) * 100 >= 80 AS robust FROM gpf GROUP BY symbol""", "gpf")
PER = Periods(SPLIT, MID)
_ROB = {"pct_profitable": 6, "best_pf": 6, "worst_pf": 6, "median_pf": 6}


def grid_runs(t):
    combos = IBS.combos()
    start, end = PER.within(PER.start, PER.end)
    symbols = usable_symbols(t.bars(), start, IBS.warmup(IBS.params()))
    return combos, symbols, grid_metrics(t.bars(), IBS, combos, ACCOUNT, start, end, symbols)


def grid_params(df, combos, names):
    table = F.array(*[F.struct(*[F.lit(float(p[n])).alias(n) for n in names]) for p in combos])
    return df.select("*", *[table[F.col("combo_id")][n].alias(n) for n in names])


@query("AGG6", with_("rob", body="SELECT * FROM rob"), round=_ROB)
def agg6(t):
    combos, symbols, m = grid_runs(t)
    return M.robustness(m, len(combos), symbols)


_DIMS = {"thr": "ibs_entry_threshold", "xthr": "ibs_exit_threshold", "per": "sma_trend_period"}


@query("AGG7", with_("gm", "igrid", "usable", body="""SELECT dim, value, avg(profit_factor) AS mean_pf, count(*) FILTER (profit_factor > 1) AS n_above_1, count(*) FILTER (profit_factor > 1.2) AS n_above_12 FROM (
   SELECT profit_factor, unnest([{'dim': 'thr', 'value': CAST(thr AS DOUBLE)}, {'dim': 'xthr', 'value': CAST(xthr AS DOUBLE)}, {'dim': 'per', 'value': CAST(per AS DOUBLE)}], recursive := true) FROM gm JOIN igrid USING (combo_id) JOIN usable USING (symbol) WHERE start_ix >= per + 10) GROUP BY ALL"""),
       round={"value": 4, "mean_pf": 6})
def agg7(t):
    combos, _, m = grid_runs(t)
    p = grid_params(m, combos, _DIMS.values()).withColumnsRenamed({v: k for k, v in _DIMS.items()})
    pf = F.when(F.abs("profit_factor") < float("inf"), F.col("profit_factor"))
    return p.unpivot(["symbol", "profit_factor"], list(_DIMS), "dim", "value").groupBy("dim", "value").agg(
        F.avg(pf).alias("mean_pf"), F.count_if(pf > 1).alias("n_above_1"), F.count_if(pf > 1.2).alias("n_above_12"))


@query("AGG7_best", with_("gm", "igrid", "usable", body="""SELECT symbol, arg_max(combo_id, {'a': profit_factor, 'b': -combo_id}) AS best_combo, max(profit_factor) AS best_pf, arg_min(combo_id, {'a': profit_factor, 'b': combo_id}) AS worst_combo, min(profit_factor) AS worst_pf
   FROM (SELECT symbol, combo_id, round(profit_factor, 9) AS profit_factor FROM gm JOIN igrid USING (combo_id) JOIN usable USING (symbol) WHERE start_ix >= per + 10) WHERE profit_factor IS NOT NULL GROUP BY symbol"""), round={"best_pf": 6, "worst_pf": 6}, ints=("best_combo", "worst_combo"))
def agg7_best(t):
    _, _, m = grid_runs(t)
    m = m.filter(F.abs("profit_factor") < float("inf")).withColumn("profit_factor", F.round("profit_factor", 9))
    up, down = F.struct("profit_factor", -F.col("combo_id")), F.struct("profit_factor", "combo_id")
    return m.groupBy("symbol").agg(F.max_by("combo_id", up).alias("best_combo"), F.max("profit_factor").alias("best_pf"),
                                   F.min_by("combo_id", down).alias("worst_combo"), F.min("profit_factor").alias("worst_pf"))


@query("AGG8", with_("gpf", body="""SELECT symbol, thr AS y, max(CASE WHEN xthr = 0.7 THEN pf END) AS x_07, max(CASE WHEN xthr = 0.8 THEN pf END) AS x_08, max(CASE WHEN xthr = 0.9 THEN pf END) AS x_09 FROM gpf GROUP BY ALL"""),
       round={"y": 2, "x_07": 6, "x_08": 6, "x_09": 6})
def agg8(t):
    combos, symbols, m = grid_runs(t)
    grid = symbols.select("symbol").withColumn("combo_id", F.explode(F.sequence(F.lit(0), F.lit(len(combos) - 1))))
    pf = F.coalesce(F.when(F.col("n_trades") >= 3, F.col("profit_factor")), F.lit(0.0))
    full = grid_params(grid.join(m.select("symbol", "combo_id", "n_trades", "profit_factor"), ["symbol", "combo_id"], "left").withColumn("pf", pf), combos, _DIMS.values())
    wide = full.groupBy("symbol", F.col("ibs_entry_threshold").alias("y")).pivot("ibs_exit_threshold", [0.7, 0.8, 0.9]).agg(F.max("pf"))
    return wide.withColumnsRenamed({"0.7": "x_07", "0.8": "x_08", "0.9": "x_09"})


cte("bufs", "SELECT * FROM (VALUES (0, 1.0), (1, 1.01), (2, 1.02)) v(combo_id, buf)")
cte("brs", """SELECT s.symbol, b.combo_id, s.bar_ix, s.open, s.close, s.reason, coalesce(r1 < 20 AND p_close > p_sma_200 * CAST(b.buf AS DOUBLE) AND bar_ix >= 210, false) AS ent FROM rsi_sig s, bufs b""", "rsi_sig", "bufs")
cte("btr", """SELECT symbol, combo_id, xix AS exit_ix, min(bar_ix) AS entry_ix FROM (SELECT *, min(CASE WHEN reason IS NOT NULL THEN bar_ix END) OVER (PARTITION BY symbol, combo_id ORDER BY bar_ix ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS xix FROM brs) WHERE ent AND xix IS NOT NULL GROUP BY ALL""", "brs")


@query("AGG9", with_("btr", "bars", body="""SELECT combo_id, count(*) AS n_trades, count(*) FILTER (r > 0) AS n_wins, avg(r) * 100 AS mean_return FROM (
   SELECT t.*, (x.close - e.open * (1 + CAST(0.0003 AS DOUBLE))) / (e.open * (1 + CAST(0.0003 AS DOUBLE))) - 0.000075 - x.close / (e.open * (1 + CAST(0.0003 AS DOUBLE))) * 0.000075 AS r FROM btr t JOIN bars e ON e.symbol = t.symbol AND e.bar_ix = t.entry_ix JOIN bars x ON x.symbol = t.symbol AND x.bar_ix = t.exit_ix) GROUP BY combo_id"""),
       round={"mean_return": 6}, ints=("combo_id",))
def agg9(t):
    combos = RSI2.combos({"sma_trend_buffer": [1.0, 1.01, 1.02]}, rsi_entry_threshold=20)
    tr = ledger(t.bars(), RSI2, combos, ACCOUNT).filter("closed")
    return tr.groupBy("combo_id").agg(F.count(F.lit(1)).alias("n_trades"), F.count_if(F.col("return_pct") > 0).alias("n_wins"), (F.avg("return_pct") * 100).alias("mean_return"))


ibs_ctes("ha", where=f"date >= DATE '{SPLIT}' AND date < DATE '{MID}'")
ibs_ctes("hb", where=f"date >= DATE '{MID}'")
cte("half", f"""SELECT symbol, coalesce(a.n_trades, 0) AS n_trades_a, coalesce(a.profit_factor, 0) AS pf_a, coalesce(a.sharpe, 0) AS sharpe_a, coalesce(b.n_trades, 0) AS n_trades_b, coalesce(b.profit_factor, 0) AS pf_b, coalesce(b.sharpe, 0) AS sharpe_b,
  coalesce(a.profit_factor > 1 AND b.profit_factor > 1, false) AS stable FROM ({metrics_sql('ha', inf=INF)}) a FULL JOIN ({metrics_sql('hb', inf=INF)}) b USING (symbol)""", "ha", "hb")
_HALF = {"pf_a": 6, "sharpe_a": 6, "pf_b": 6, "sharpe_b": 6}


@query("AGG10", with_("half", body="SELECT * FROM half"), round=_HALF)
def agg10(t):
    return halves(t.bars(), IBS, IBS.params(), ACCOUNT, PER)


def ttest_sql(table: str, key: str = "symbol", alpha: float = 0.10) -> str:
    return f"""SELECT {key}, n_trades, t_stat, p_value, mean_return_pct, p_value < {alpha} AS significant, CASE WHEN p_value < 0.05 THEN 'OUI (p<0.05)' WHEN p_value < 0.10 THEN 'MARGINAL (p<0.10)' ELSE 'NON' END AS label
     FROM (SELECT *, CASE WHEN t_stat > 0 THEN {tail_sql('t_stat', '(n_trades - 1)')} ELSE 1.0 END AS p_value FROM (
       SELECT {key}, count(*) AS n_trades, avg(return_pct) * 100 AS mean_return_pct, CASE WHEN count(*) >= 2 AND stddev_samp(return_pct) > 0 THEN avg(return_pct) / (stddev_samp(return_pct) / sqrt(count(*))) ELSE 0 END AS t_stat FROM {table} GROUP BY {key}))"""


@query("AGG11", with_("trc", body=f"{ttest_sql('trc')} UNION ALL BY NAME {ttest_sql('(SELECT * REPLACE (chr(80) || lower(chr(79)) AS symbol) FROM trc)')}"), round={"t_stat": 6, "p_value": 6, "mean_return_pct": 6})
def agg11(t):
    tr = t.ibs_trades()
    return M.t_test(tr, ["symbol"]).unionByName(M.t_test(tr.withColumn("symbol", F.lit("Po")), ["symbol"]))


_KEYS = "timestamp, strategy, universe, symbol"
_FIRST = f"(exit_date < CASE WHEN timestamp = TIMESTAMP '{RUNS[0]}' THEN DATE '{SPLIT}' ELSE DATE '{MID}' END)"
cte("vgrid", f"""SELECT timestamp, symbol, count(*) FILTER (n >= 3 AND pf > 1) / (SELECT count(*) FROM igrid) * 100 AS robustness_pct FROM (
   SELECT timestamp, symbol, combo_id, count(*) AS n, {pf_sql(inf=INF)} AS pf FROM (SELECT *, CAST(unnest(CASE WHEN exit_date < DATE '{MID}' THEN ['{RUNS[0]}', '{RUNS[1]}'] ELSE ['{RUNS[1]}'] END) AS TIMESTAMP) AS timestamp FROM gtr WHERE closed) GROUP BY ALL)
   GROUP BY ALL""", "gtr", "igrid")
cte("vhalf", f"SELECT {_KEYS}, ({pf_sql(cond=_FIRST, inf=INF)}) > 1 AND ({pf_sql(cond=f'NOT {_FIRST}', inf=INF)}) > 1 AS stable FROM screen_src GROUP BY {_KEYS}", "screen_src")
cte("validations", f"""SELECT *, CASE WHEN robustness_pct >= 80 AND stable AND ttest_p < 0.1 THEN 'VALIDATED' WHEN robustness_pct >= 80 AND (stable OR ttest_p < 0.1) THEN 'CONDITIONAL' ELSE 'REJECTED' END AS verdict
  FROM (SELECT s.*, coalesce(g.robustness_pct, 0) AS robustness_pct, h.stable, p.p_value AS ttest_p FROM screens s JOIN vhalf h USING ({_KEYS}) JOIN ({ttest_sql('screen_src', _KEYS)}) p USING ({_KEYS}) LEFT JOIN vgrid g USING (timestamp, symbol))""", "screens", "screen_src", "vhalf", "vgrid")


ibs_ctes("oos", where=f"date >= DATE '{SPLIT}'")
cte("oosc", "SELECT * FROM oos WHERE closed", "oos")
_POOLED = "(SELECT * REPLACE ('POOLED' AS symbol) FROM oosc)"
_VAL = "symbol, n_trades, win_rate, profit_factor, sharpe, net_return_pct, pct_profitable, median_pf, pf_a, pf_b, stable, t_stat, p_value, significant, verdict"
cte("validated", f"""SELECT symbol, m.n_trades, m.win_rate, m.profit_factor, m.sharpe, m.net_return_pct, r.pct_profitable, r.median_pf, h.pf_a, h.pf_b, h.stable, t.t_stat, t.p_value, t.significant,
   CASE WHEN r.robust AND h.stable AND t.significant THEN 'VALIDATED' WHEN r.robust AND (h.stable OR t.significant) THEN 'CONDITIONAL' ELSE 'REJECTED' END AS verdict
   FROM ({metrics_sql('oos')}) m JOIN rob r USING (symbol) JOIN half h USING (symbol) JOIN ({ttest_sql('oosc')}) t USING (symbol)""", "oos", "oosc", "rob", "half")


@query("SQL_metrics", with_("trc", body=f"""SELECT symbol, n_trades, profit_factor, t_stat, p_value FROM ({ttest_sql('trc')}) JOIN (SELECT symbol, {pf_sql()} AS profit_factor FROM trc GROUP BY symbol) USING (symbol)"""),
       round={"profit_factor": 6, "t_stat": 6, "p_value": 6})
def sql_metrics(t):
    """The table function, asked in SQL text."""
    sqlnames.register_table(t.spark, t.ibs_trades())
    return t.spark.sql("SELECT symbol, n_trades, profit_factor, t_stat, p_value FROM trade_metrics()")


@query("AGG12", with_("validated", "oosc", body=f"SELECT {_VAL} FROM validated UNION ALL BY NAME SELECT symbol, n_trades, t_stat, p_value, significant FROM ({ttest_sql(_POOLED)})"), round={"win_rate": 6, "profit_factor": 6, "sharpe": 6, "net_return_pct": 6, "pct_profitable": 6, "median_pf": 6, "pf_a": 6, "pf_b": 6, "t_stat": 6, "p_value": 6})
def agg12(t):
    return validate(t.bars(), IBS, ACCOUNT, PER, pooled="POOLED").select(*[c.strip() for c in _VAL.split(",")])


@query("SCA15", with_("validated", body="SELECT verdict, count(*) AS n FROM validated GROUP BY verdict"))
def sca15(t):
    return validate(t.bars(), IBS, ACCOUNT, PER).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def screened(t):
    """Metrics after the start date of symbols with at least 50 bars from there and from the warm-up on."""
    start, end = PER.within(PER.start, PER.end)
    bars, warmup = t.bars(), IBS.warmup(IBS.params())
    m = M.trade_metrics(ledger(bars, IBS, account=ACCOUNT, start=start & (F.col("bar_ix") >= warmup), end=end), ["symbol"])
    return m.join(usable_symbols(bars, start, warmup), "symbol", "left_semi")


@query("AGG13", with_("oos", body=f"SELECT * FROM ({metrics_sql('oos')}) ORDER BY profit_factor DESC"), round=METRIC_DIGITS)
def agg13(t):
    return screened(t).orderBy(F.col("profit_factor").desc())


@query("AGG13_profitable", with_("oos", body=f"SELECT count(*) AS n_symbols, count(*) FILTER (profit_factor > 1) AS n_profitable FROM ({metrics_sql('oos')})"))
def agg13_profitable(t):
    return screened(t).agg(F.count(F.lit(1)).alias("n_symbols"), F.count_if(F.col("profit_factor") > 1).alias("n_profitable"))


_Q = ", ".join(f"quantile_cont(r, {p / 100}) AS p{p}" for p in X.PERCENTS)


@query("AGG14", with_("trc", body=f"""SELECT symbol, count(*) AS n_trades, avg(r) AS mean, stddev_pop(r) AS std, sum(pow(r - m, 3)) / count(*) / pow(stddev_pop(r), 3) AS skew, sum(pow(r - m, 4)) / count(*) / pow(stddev_pop(r), 4) - 3 AS excess_kurtosis,
   min(r) AS "min", max(r) AS "max", coalesce(avg(r) FILTER (r > 0), 0) AS avg_win, coalesce(avg(r) FILTER (r <= 0), 0) AS avg_loss, {_Q}, abs(coalesce(avg(r) FILTER (r > 0), 0) / avg(r) FILTER (r <= 0)) AS wl_ratio
   FROM (SELECT *, return_pct * 100 AS r, avg(return_pct * 100) OVER (PARTITION BY symbol) AS m FROM trc) GROUP BY symbol"""),
       round={**{f"p{p}": 6 for p in X.PERCENTS}, "mean": 6, "std": 6, "skew": 6, "excess_kurtosis": 6, "min": 6, "max": 6, "avg_win": 6, "avg_loss": 6, "wl_ratio": 6})
def agg14(t):
    return X.distribution(closed(t), ["symbol"])


cte("trk", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY pnl DESC, entry_ix) AS rank FROM trc", "trc")
_TOP = ", ".join(f"CASE WHEN sum(pnl) <> 0 THEN sum(pnl) FILTER (rank <= {n}) / sum(pnl) * 100 ELSE 0 END AS top_{n}_pct, CASE WHEN count(*) > {n} THEN {pf_sql(cond=f'rank > {n}')} END AS pf_without_{n}, "
                 f"CASE WHEN count(*) > {n} THEN count(*) FILTER (rank > {n} AND pnl > 0) / count(*) FILTER (rank > {n}) END AS wr_without_{n}" for n in (5, 10, 20))


_SKP = (5, 25, 50, 75, 95)


@query("AGG14_sketch", with_("trc", body="SELECT symbol, year, n, n_days, " + ", ".join(f"rs[CAST(greatest(1, ceil(round({p / 100} * n, 9))) AS BIGINT)] AS p{p}" for p in _SKP) + """ FROM (
   SELECT symbol, year(exit_date) AS year, count(*) AS n, count(DISTINCT exit_date) AS n_days, list_sort(list(return_pct)) AS rs FROM trc GROUP BY ALL)"""), round={f"p{p}": 8 for p in _SKP})
def agg14_sketch(t):
    """Percentiles per year from stored monthly sketches; exact here, as no year has as many trades as the sketch keeps."""
    months = t._kept("trade-sketches", lambda: K.monthly_sketches(closed(t)))
    years = K.merged(months, ["symbol", F.year("month").cast("long").alias("year")])
    return K.percentiles_of(years, ["symbol", "year"], "return_pct", _SKP)


@query("AGG15", with_("trk", body=f"SELECT symbol, sum(pnl) AS total_pnl, {_TOP} FROM trk GROUP BY symbol"),
       round={"total_pnl": 4, **{f"{c}_{n}{s}": d for n in (5, 10, 20) for c, s, d in (("top", "_pct", 3), ("pf_without", "", 6), ("wr_without", "", 6))}})
def agg15(t):
    return X.concentration(closed(t), ["symbol"])


@query("WIN7", with_("trk", body="SELECT symbol, entry_ix, rank FROM trk"))
def win7(t):
    return ranked(closed(t), ["symbol"], "pnl", "entry_ix").select("symbol", "entry_ix", "rank")


_BK = "CASE WHEN holding_days = 1 THEN 'Short (1d)' WHEN holding_days BETWEEN 2 AND 3 THEN 'Medium (2-3d)' WHEN holding_days BETWEEN 4 AND 7 THEN 'Long (4-7d)' WHEN holding_days >= 8 THEN 'Very long (8+d)' END"
_BD = {"mean_return": 6, "win_rate": 6, "avg_pnl": 4, "profit_factor": 6}


def bucket_sql(table: str, bucket: str) -> str:
    return f"""SELECT symbol, bucket, count(*) AS n_trades, avg(return_pct) * 100 AS mean_return, count(*) FILTER (pnl > 0) / count(*) AS win_rate, avg(pnl) AS avg_pnl, {pf_sql()} AS profit_factor
      FROM (SELECT *, {bucket} AS bucket FROM {table}) WHERE bucket IS NOT NULL GROUP BY ALL"""


@query("AGG16", with_("trc", body=bucket_sql("trc", _BK)), round=_BD)
def agg16(t):
    return X.by_bucket(closed(t), ["symbol"], X.duration_bucket(F.col("holding_days")))


def corr_sql(table: str, x: str) -> str:
    tt = "(abs(r) * sqrt((n - 2) / (1 - r * r)))"
    return f"SELECT symbol, r, n, CASE WHEN n > 2 AND abs(r) < 1 THEN 2 * {tail_sql(tt, '(n - 2)')} END AS p_value FROM (SELECT symbol, CASE WHEN stddev_pop({x}) * stddev_pop(return_pct) > 0 AND count(*) > 2 THEN corr({x}, return_pct) END AS r, count(*) AS n FROM {table} GROUP BY symbol)"


@query("AGG16_r", with_("trc", body=corr_sql("trc", "holding_days")), round={"r": 6, "p_value": 6})
def agg16_r(t):
    return X.correlation(closed(t), ["symbol"], "holding_days", "return_pct")


@query("AGG17", with_("trc", body=f"""SELECT symbol, year(entry_date) AS year, count(*) AS n_trades, count(*) FILTER (pnl > 0) / count(*) AS win_rate, {pf_sql()} AS profit_factor, avg(return_pct) * 100 AS avg_return, sum(pnl) AS total_pnl, count(*) FILTER ({pf_sql(inf="'infinity'::DOUBLE")} < 1) OVER (PARTITION BY symbol) AS years_below_1 FROM trc GROUP BY symbol, year(entry_date)"""),
       round={"win_rate": 6, "profit_factor": 6, "avg_return": 6, "total_pnl": 4})
def agg17(t):
    return X.by_year(closed(t), ["symbol"])


@query("AGG18", with_("tctx", body=bucket_sql("(SELECT * FROM tctx WHERE closed)", "CASE WHEN slope_pct > 0.5 THEN 'rising' WHEN slope_pct < -0.5 THEN 'falling' ELSE 'flat' END")), round=_BD)
def agg18(t):
    return X.by_bucket(trend_context(t, closed(t)), ["symbol"], X.slope_class(F.col("slope_pct")))


@query("AGG18_distance", with_("tctx", body=bucket_sql("(SELECT * FROM tctx WHERE closed)", "CASE WHEN distance_pct < 2 THEN 'Close (< 2%)' WHEN distance_pct < 5 THEN 'Mid (2-5%)' ELSE 'Far (> 5%)' END")), round=_BD)
def agg18_distance(t):
    return X.by_bucket(trend_context(t, closed(t)), ["symbol"], X.distance_bucket(F.col("distance_pct")))


@query("AGG18_r", with_("tctx", body=corr_sql("(SELECT * FROM tctx WHERE closed)", "slope_pct")), round={"r": 6, "p_value": 6})
def agg18_r(t):
    return X.correlation(trend_context(t, closed(t)), ["symbol"], "slope_pct", "return_pct")


@query("AGG19", with_("trc", body=f"""SELECT symbol, exit_reason, count(*) AS n_trades, count(*) FILTER (pnl > 0) / count(*) AS win_rate, {pf_sql()} AS profit_factor, avg(return_pct) * 100 AS avg_return, avg(holding_days) AS avg_days FROM trc GROUP BY ALL"""),
       round={"win_rate": 6, "profit_factor": 6, "avg_return": 6, "avg_days": 6})
def agg19(t):
    pnl = F.col("pnl")
    return closed(t).groupBy("symbol", "exit_reason").agg(F.count(F.lit(1)).alias("n_trades"), M.win_rate(pnl).alias("win_rate"), M.profit_factor(pnl).alias("profit_factor"),
                                                          (F.avg("return_pct") * 100).alias("avg_return"), F.avg("holding_days").alias("avg_days"))


cte("prof0", "SELECT *, return_pct * 100 AS r, avg(return_pct * 100) OVER (PARTITION BY symbol) AS m, row_number() OVER (PARTITION BY symbol ORDER BY pnl DESC, entry_ix) AS place FROM trc", "trc")
cte("prof", f"""SELECT symbol, CAST(count(*) AS DOUBLE) AS n_trades, count(*) FILTER (pnl > 0) / count(*) AS win_rate, {pf_sql(inf=INF)} AS profit_factor, avg(r) AS mean_return, quantile_cont(r, 0.5) AS median_return,
   coalesce(avg(r) FILTER (r > 0), 0) AS avg_win, coalesce(avg(r) FILTER (r <= 0), 0) AS avg_loss, CASE WHEN coalesce(avg(r) FILTER (r <= 0), 0) <> 0 THEN abs(coalesce(avg(r) FILTER (r > 0), 0) / avg(r) FILTER (r <= 0)) ELSE {INF} END AS wl_ratio,
   CASE WHEN count(*) < 3 OR stddev_pop(r) = 0 THEN 0 ELSE sum(pow(r - m, 3)) / count(*) / pow(stddev_pop(r), 3) END AS skew, CASE WHEN count(*) < 3 OR stddev_pop(r) = 0 THEN 0 ELSE sum(pow(r - m, 4)) / count(*) / pow(stddev_pop(r), 4) - 3 END AS excess_kurtosis,
   CASE WHEN sum(pnl) <> 0 THEN sum(pnl) FILTER (place <= 10) / sum(pnl) * 100 ELSE 0 END AS top_10_pct, avg(holding_days) AS avg_days FROM prof0 GROUP BY symbol""", "prof0")


@query("AGG20", with_("prof", body=f"""SELECT metric, max(best) AS best, max(value) FILTER (symbol = 'EUROPE') AS reference, max(value) FILTER (symbol = best) AS other FROM (
   SELECT *, (SELECT symbol FROM prof WHERE symbol <> 'EUROPE' ORDER BY profit_factor DESC, symbol LIMIT 1) AS best FROM (UNPIVOT prof ON {", ".join(X.PROFILE)} INTO NAME metric VALUE value)) WHERE symbol IN ('EUROPE', best) GROUP BY metric"""),
       round={"reference": 6, "other": 6})
def agg20(t):
    return X.best_against(closed(t), "EUROPE")


@query("AGG20_synthesis", with_("prof", "trc", body=f"""SELECT *, CASE WHEN avg_skew > 0.5 AND avg_wl_ratio > 2.0 THEN 'momentum' ELSE 'mean reversion' END AS pattern,
   CASE WHEN top_20_pct > 50 AND pct_years_ok <= 70 THEN 'do not trade' WHEN top_20_pct > 50 THEN 'investigate, small size' WHEN pct_years_ok > 70 THEN 'trade with care' ELSE 'investigate' END AS recommendation
  FROM (SELECT avg(skew) AS avg_skew, avg(wl_ratio) AS avg_wl_ratio FROM prof WHERE symbol <> 'EUROPE'),
   (SELECT CASE WHEN sum(pnl) <> 0 THEN sum(pnl) FILTER (place <= 20) / sum(pnl) * 100 ELSE 0 END AS top_20_pct, quantile_cont(return_pct * 100, 0.5) AS median_return FROM (SELECT *, row_number() OVER (ORDER BY pnl DESC, entry_ix) AS place FROM trc WHERE symbol <> 'EUROPE')),
   (SELECT count(*) AS n_years, count(*) FILTER (pf < 1) AS years_below_1, (count(*) - count(*) FILTER (pf < 1)) / count(*) * 100 AS pct_years_ok FROM (SELECT {pf_sql(inf=INF)} AS pf FROM trc WHERE symbol <> 'EUROPE' GROUP BY symbol, year(entry_date)))"""),
       round={"avg_skew": 6, "avg_wl_ratio": 6, "top_20_pct": 6, "median_return": 6, "pct_years_ok": 6})
def agg20_synthesis(t):
    return X.synthesis(closed(t), "EUROPE")


cte("slw", f"""SELECT symbol, level, count(*) AS n_trades, count(*) FILTER (mae_pct <= level) AS n_stopped, count(*) FILTER (mae_pct <= level AND pnl > 0) AS n_winners FROM mae, (VALUES {', '.join(f'({x})' for x in STOP_LEVELS)}) v(level) GROUP BY ROLLUP (symbol), level""", "mae")


def excursions(t):
    return E.adverse_excursion(closed(t).select("symbol", "entry_ix", "exit_ix", "entry_price", "pnl"), t.bars())


@query("AGG21", with_("slw", body="""SELECT coalesce(symbol, 'ALL') AS symbol, level, n_trades, n_stopped, n_winners, n_stopped / n_trades * 100 AS pct_stopped, CASE WHEN n_stopped > 0 THEN n_winners / n_stopped * 100 ELSE 0 END AS false_positive_pct FROM slw"""),
       round={"level": 2, "pct_stopped": 6, "false_positive_pct": 6})
def agg21(t):
    both = excursions(t).select(F.explode(F.array(F.col("symbol"), F.lit("ALL"))).alias("symbol"), "mae_pct", "pnl")
    return X.stop_what_if(both, ["symbol"])


@query("AGG21_mae", with_("mae", body="SELECT symbol, " + ", ".join(f"quantile_cont(mae_pct, {p / 100}) AS q{p}" for p in (50, 25, 10, 5, 1)) + ", min(mae_pct) AS worst FROM mae GROUP BY symbol"),
       round={**{f"q{p}": 8 for p in (50, 25, 10, 5, 1)}, "worst": 8})
def agg21_mae(t):
    ex = excursions(t)
    q = percentiles(ex, ["symbol"], "mae_pct", {f"q{p}": p / 100 for p in (50, 25, 10, 5, 1)})
    return q.join(ex.groupBy("symbol").agg(F.min("mae_pct").alias("worst")), "symbol")


@query("AGG21_level", with_("slw", body="SELECT coalesce(symbol, 'ALL') AS symbol, max(level) FILTER (n_stopped / n_trades * 100 < 3 AND (n_stopped = 0 OR n_winners / n_stopped * 100 < 50)) AS recommended FROM slw GROUP BY ALL"), round={"recommended": 2})
def agg21_level(t):
    both = excursions(t).select(F.explode(F.array(F.col("symbol"), F.lit("ALL"))).alias("symbol"), "mae_pct", "pnl")
    return X.recommended_stop(X.stop_what_if(both, ["symbol"]), ["symbol"])


cte("reprice", """SELECT t.symbol, t.exit_reason, t.pnl, CASE WHEN n.open IS NULL THEN t.pnl ELSE (n.open - t.entry_price) * t.quantity - (1 + t.quantity * t.entry_price * 0.00025) - (1 + t.quantity * n.open * 0.00025) END AS new_pnl
  FROM strict_tr t LEFT JOIN bars n ON n.symbol = t.symbol AND n.bar_ix = t.exit_ix + 1 WHERE t.closed""", "strict_tr", "bars")


def repriced(t):
    tr = ledger(t.bars(), IBS, [IBS.params(cooldown_candles=2)], STRICT).filter("closed")
    return E.reprice_at_next_open(tr, t.bars(), "us_stocks_usd_account")


@query("AGG22", with_("reprice", body=f"""SELECT symbol, count(*) AS n_trades, {pf_sql('pnl')} AS pf_close, {pf_sql('new_pnl')} AS pf_open, count(*) FILTER (pnl > 0) / count(*) AS wr_close, count(*) FILTER (new_pnl > 0) / count(*) AS wr_open, sum(pnl) AS total_close, sum(new_pnl) AS total_open FROM reprice GROUP BY symbol"""),
       round={"pf_close": 6, "pf_open": 6, "wr_close": 6, "wr_open": 6, "total_close": 4, "total_open": 4})
def agg22(t):
    a, b = F.col("pnl"), F.col("new_pnl")
    return repriced(t).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_trades"), M.profit_factor(a).alias("pf_close"), M.profit_factor(b).alias("pf_open"),
                                             M.win_rate(a).alias("wr_close"), M.win_rate(b).alias("wr_open"), F.sum(a).alias("total_close"), F.sum(b).alias("total_open"))


@query("AGG22_reason", with_("reprice", body="SELECT exit_reason, count(*) AS n, avg(new_pnl - pnl) AS avg_delta, sum(new_pnl - pnl) AS total_delta FROM reprice GROUP BY exit_reason"), round={"avg_delta": 4, "total_delta": 4})
def agg22_reason(t):
    d = F.col("new_pnl") - F.col("pnl")
    return repriced(t).groupBy("exit_reason").agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("avg_delta"), F.sum(d).alias("total_delta"))


cte("two", f"""SELECT a.symbol, a.n_trades AS a_n_trades, a.win_rate AS a_win_rate, a.profit_factor AS a_profit_factor, a.sharpe AS a_sharpe, b.n_trades AS b_n_trades, b.win_rate AS b_win_rate, b.profit_factor AS b_profit_factor, b.sharpe AS b_sharpe,
   CASE WHEN a.n_trades > 0 THEN (a.n_trades - b.n_trades) / a.n_trades * 100 ELSE 0 END AS trade_reduction_pct, b.profit_factor - a.profit_factor AS pf_delta, b.win_rate - a.win_rate AS wr_delta, b.sharpe - a.sharpe AS sharpe_delta,
   CASE WHEN b.profit_factor - a.profit_factor > 0.1 THEN 'WINNER' WHEN b.profit_factor - a.profit_factor < -0.1 THEN 'LOSER' ELSE 'NEUTRAL' END AS category, b.n_trades >= 20 AS reliable
   FROM ({metrics_sql('tom_tr')}) a JOIN ({metrics_sql('itom_tr')}) b USING (symbol)""", "tom_tr", "itom_tr")


def pairwise(t):
    return X.compare_two(M.trade_metrics(ledger(t.bars(), TOM, account=ACCOUNT), ["symbol"]), M.trade_metrics(ledger(t.bars(), _ibs_tom(), [ITOM], ACCOUNT), ["symbol"]))


def _ibs_tom():
    from ..operators.rules import IBS_TOM

    return IBS_TOM


_TWO = {**{f"{s}_{c}": 6 for s in "ab" for c in ("win_rate", "profit_factor", "sharpe")}, "trade_reduction_pct": 6, "pf_delta": 6, "wr_delta": 6, "sharpe_delta": 6}


@query("AGG23", with_("two", body="SELECT * FROM two"), round=_TWO)
def agg23(t):
    return pairwise(t)


@query("AGG23_total", with_("two", body="""SELECT count(*) AS n_assets, count(*) FILTER (category = 'WINNER') AS n_winner, count(*) FILTER (category = 'LOSER') AS n_loser, count(*) FILTER (category = 'NEUTRAL') AS n_neutral, count(*) FILTER (reliable) AS n_reliable,
   CAST(sum(a_n_trades) AS BIGINT) AS a_trades, CAST(sum(b_n_trades) AS BIGINT) AS b_trades, sum(a_win_rate * a_n_trades) / sum(a_n_trades) AS a_wr, sum(a_profit_factor * a_n_trades) / sum(a_n_trades) AS a_pf, sum(b_win_rate * b_n_trades) / sum(b_n_trades) AS b_wr,
   sum(b_profit_factor * b_n_trades) / sum(b_n_trades) AS b_pf, avg(pf_delta) AS avg_pf_delta, list_sort(list(pf_delta))[CAST(count(*) // 2 AS INT) + 1] AS median_pf_delta, (sum(a_n_trades) - sum(b_n_trades)) / sum(a_n_trades) * 100 AS trade_reduction_pct FROM two"""),
       round={c: 6 for c in ("a_wr", "a_pf", "b_wr", "b_pf", "avg_pf_delta", "median_pf_delta", "trade_reduction_pct")})
def agg23_total(t):
    return X.compare_total(pairwise(t))


for _i, (_c, _w) in enumerate(((4600.0, True), (10000.0, True), (10000.0, False))):
    walk_cte(f"siz{_i}", "ibs_cand", _c, 0.2, 0.0003, _US, _w)
_SIZ = "UNION ALL".join(f" SELECT '{n}' AS scenario, s.symbol, s.n_skipped, s.final_capital, count(*) FILTER (t.closed) AS n_trades, coalesce(avg(t.pnl) FILTER (t.closed), 0) AS avg_pnl FROM siz{i}_state s LEFT JOIN siz{i} t USING (symbol) GROUP BY ALL " for i, n in enumerate(("4600/whole", "10000/whole", "10000/fraction")))


@query("AGG31", with_("siz0", "siz1", "siz2", "siz0_state", "siz1_state", "siz2_state", body=_SIZ), round={"final_capital": 4, "avg_pnl": 4})
def agg31(t):
    accts = [variant(STRICT, capital=c, whole_shares=w, name=n) for c, w, n in ((4600.0, True, "4600/whole"), (10000.0, True, "10000/whole"), (10000.0, False, "10000/fraction"))]
    base = F.create_map(*[F.lit(x) for a in accts for x in (a.name, a.capital)])
    g = ledger(t.bars(), IBS, account=STRICT, accounts=accts).groupBy("scenario", "symbol").agg(
        F.count_if(F.col("status") == "skipped").alias("n_skipped"), F.coalesce(F.sum("pnl"), F.lit(0.0)).alias("made"), F.count_if(F.col("closed")).alias("n_trades"),
        F.coalesce(F.avg(M.only_closed("pnl")), F.lit(0.0)).alias("avg_pnl"))
    return g.withColumn("final_capital", base[F.col("scenario")] + F.col("made")).drop("made")


for _k, _v in FEES.items():
    walk_cte(f"fee_{_k}", "ibs_cand", 10000.0, 0.2, 0.0003, _v, False)
_FEE = " UNION ALL ".join(f"SELECT '{k}' AS scenario, symbol, count(*) FILTER (closed) AS n_trades, {pf_sql(cond='closed')} AS profit_factor, sum(pnl) AS net FROM fee_{k} GROUP BY symbol" for k in FEES)


@query("AGG32", with_(*[f"fee_{k}" for k in FEES], body=_FEE), round={"profit_factor": 6, "net": 4})
def agg32(t):
    accts = [variant(STRICT, fees=k, whole_shares=False, name=k) for k in FEES]
    return ledger(t.bars(), IBS, account=STRICT, accounts=accts).groupBy("scenario", "symbol").agg(
        F.count_if(F.col("closed")).alias("n_trades"), M.profit_factor(M.only_closed("pnl")).alias("profit_factor"), F.sum("pnl").alias("net"))


@query("PRJ1", with_("validated", body="SELECT symbol, CASE verdict WHEN 'VALIDATED' THEN '[V]' WHEN 'CONDITIONAL' THEN '[C]' WHEN 'REJECTED' THEN '[R]' ELSE '?' END AS marker, CASE WHEN profit_factor < 100 THEN printf('%.2f', round(profit_factor, 2)) ELSE 'inf' END AS pf FROM validated"))
def prj1(t):
    from ..functions import scalars as S

    mark = F.create_map(*[F.lit(x) for x in ("VALIDATED", "[V]", "CONDITIONAL", "[C]", "REJECTED", "[R]")])
    pf = F.col("profit_factor")
    return validate(t.bars(), IBS, ACCOUNT, PER).select("symbol", F.coalesce(F.try_element_at(mark, F.col("verdict")), F.lit("?")).alias("marker"),
                                                        F.when(pf < 100, S.fixed(pf, 2)).otherwise("inf").alias("pf"))
