"""Queries on walk-forward search, overfitting checks and signals of the day."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import resampling as R, signals as G, walkforward as W
from ..operators.indicators import Needs, home_rows, indicator_frame
from ..operators.rules import IBS
from .base import ACCOUNT, BOOK, IBS_SQL, cte, query, sma_sql, with_
from .inputs import snapshot
from .trading import cdf_sql

# ---------------------------------------------------------------- grid runs in check SQL


def grid_trades(name: str, src: str, keys: str, combos: list[tuple], dep: str) -> str:
    """CTE chain: trades of the range-position rule for (combo_id, thr, xthr, sma) on any partition of bars."""
    periods = sorted({c[3] for c in combos})
    smas = ", ".join(f"{sma_sql(p, keys)} AS sma_{p}" for p in periods)
    lags = ", ".join(f"lag(sma_{p}) OVER s AS p_sma_{p}" for p in periods)
    pick = lambda pre: "CASE g.per " + " ".join(f"WHEN {p} THEN {pre}sma_{p}" for p in periods) + " END"
    cte(f"{name}_g", f"SELECT * FROM (VALUES {', '.join(str(c) for c in combos)}) v(combo_id, thr, xthr, per)")
    cte(f"{name}_i", f"SELECT *, lag(ibs) OVER s AS p_ibs, lag(close) OVER s AS p_close, lag(high) OVER s AS p_high, {lags} FROM (SELECT *, {IBS_SQL} AS ibs, {smas} FROM {src}) WINDOW s AS (PARTITION BY {keys} ORDER BY bar_ix)", dep)
    cte(f"{name}_x", f"""SELECT {keys}, bar_ix, xthr, per, min(CASE WHEN ibs > xthr OR close > p_high OR close < {pick('')} THEN bar_ix END) OVER (PARTITION BY {keys}, xthr, per ORDER BY bar_ix ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS xix
      FROM {name}_i, (SELECT DISTINCT xthr, per FROM {name}_g) g""", f"{name}_i", f"{name}_g")
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    ks = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    cte(f"{name}_e", f"SELECT {keys}, combo_id, bar_ix, open, xthr, per FROM {name}_i JOIN {name}_g g ON p_ibs < thr AND p_close > {pick('p_')} AND bar_ix >= per + 10", f"{name}_i", f"{name}_g")
    cte(f"{name}_p", f"SELECT {ks}, a.combo_id, b.xix AS exit_ix, min(a.bar_ix) AS entry_ix, arg_min(a.open, a.bar_ix) AS open FROM {name}_e a JOIN {name}_x b ON {on} AND a.bar_ix = b.bar_ix AND a.xthr = b.xthr AND a.per = b.per WHERE b.xix IS NOT NULL GROUP BY ALL", f"{name}_e", f"{name}_x")
    cte(f"{name}_r", f"SELECT a.*, (b.close - ep) / ep - 0.000075 - b.close / ep * 0.000075 AS r FROM (SELECT *, open * (1 + CAST(0.0003 AS DOUBLE)) AS ep FROM {name}_p) a JOIN {name}_i b ON {on} AND b.bar_ix = a.exit_ix", f"{name}_p", f"{name}_i")
    cte(name, f"SELECT *, 100000 * before * 0.2 * r AS pnl, 0.2 * r / (1 + 0.2 * r) AS ret2 FROM (SELECT *, coalesce(product(1 + 0.2 * r) OVER (PARTITION BY {keys}, combo_id ORDER BY entry_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS before FROM {name}_r)", f"{name}_r")
    cte(f"{name}_n", f"SELECT {keys}, count(*) * 365.0 / 252.0 AS days FROM {src} GROUP BY ALL", dep)
    cte(f"{name}_m", f"""SELECT {ks}, g.combo_id, round(CASE WHEN n >= 3 AND sd > 1e-10 THEN least(100.0, mu / sd * sqrt(n / greatest(a.days, 1.0) * 365)) ELSE 0 END, 9) AS sharpe, coalesce(ret, 0) AS net_return_pct, coalesce(pf, 0) AS profit_factor, coalesce(n, 0) AS n_trades, pf
      FROM {name}_n a CROSS JOIN {name}_g g LEFT JOIN (SELECT {keys}, combo_id, count(*) AS n, avg(ret2) AS mu, stddev_pop(ret2) AS sd, sum(pnl) / 100000 * 100 AS ret,
        CASE WHEN abs(coalesce(sum(pnl) FILTER (pnl <= 0), 0)) = 0 THEN CASE WHEN sum(pnl) > 0 THEN 'infinity'::DOUBLE ELSE 0 END ELSE coalesce(sum(pnl) FILTER (pnl > 0), 0) / abs(sum(pnl) FILTER (pnl <= 0)) END AS pf FROM {name} GROUP BY ALL) b ON {on} AND g.combo_id = b.combo_id""", name, f"{name}_n", f"{name}_g")
    return name


GRID = {"ibs_entry_threshold": [0.1, 0.15, 0.2, 0.25], "ibs_exit_threshold": [0.7, 0.8, 0.9], "sma_trend_period": [50, 100]}
COMBOS = IBS.combos(GRID)
PLAN, COARSE, TOP = W.Plan(), 12, 3
_GC = [(i, p["ibs_entry_threshold"], p["ibs_exit_threshold"], p["sma_trend_period"]) for i, p in enumerate(COMBOS)]
cte("wf_last", f"SELECT symbol, CAST(floor((count(*) - {PLAN.total}) / {PLAN.step}.0) AS BIGINT) AS last FROM bars GROUP BY symbol HAVING count(*) >= {PLAN.total}", "bars")
cte("wf_win", "SELECT symbol, unnest(range(0, last + 1)) AS window_ix FROM wf_last", "wf_last")
cte("wf_seg", f"""SELECT b.symbol, w.window_ix, 'is' AS segment, b.date, b.open, b.high, b.low, b.close, b.volume, b.bar_ix - w.window_ix * {PLAN.step} AS bar_ix FROM bars b JOIN wf_win w ON w.symbol = b.symbol AND b.bar_ix >= w.window_ix * {PLAN.step} AND b.bar_ix < w.window_ix * {PLAN.step} + {PLAN.is_bars}
  UNION ALL SELECT b.symbol, w.window_ix, 'oos', b.date, b.open, b.high, b.low, b.close, b.volume, b.bar_ix - w.window_ix * {PLAN.step} - {PLAN.oos_offset} FROM bars b JOIN wf_win w ON w.symbol = b.symbol AND b.bar_ix >= w.window_ix * {PLAN.step} + {PLAN.oos_offset} AND b.bar_ix < w.window_ix * {PLAN.step} + {PLAN.total}""", "bars", "wf_win")
grid_trades("wf", "wf_seg", "symbol, window_ix, segment", _GC, "wf_seg")
_IDS = ", ".join(map(str, W.coarse_ids(len(COMBOS), COARSE)))
_NB = ", ".join(f"({i}, {j})" for i, ids in enumerate(W.neighbours(COMBOS, GRID)) for j in ids)
cte("wf_rank", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, window_ix ORDER BY sharpe DESC, combo_id) AS rank FROM wf_m WHERE segment = 'is' AND combo_id IN ({_IDS})) WHERE rank <= {TOP}", "wf_m")
cte("wf_eval", f"SELECT symbol, window_ix, combo_id FROM wf_m WHERE segment = 'is' AND combo_id IN ({_IDS}) UNION SELECT r.symbol, r.window_ix, n.j FROM wf_rank r JOIN (VALUES {_NB}) n(i, j) ON n.i = r.combo_id", "wf_m", "wf_rank")
cte("wf_join", """SELECT e.symbol, e.window_ix, e.combo_id, i.sharpe AS is_sharpe, i.net_return_pct AS is_net_return_pct, i.profit_factor AS is_profit_factor, i.n_trades AS is_n_trades, o.sharpe AS oos_sharpe, o.net_return_pct AS oos_net_return_pct, o.profit_factor AS oos_profit_factor, o.n_trades AS oos_n_trades
  FROM wf_eval e JOIN (SELECT * FROM wf_m WHERE segment = 'is') i USING (symbol, window_ix, combo_id) LEFT JOIN (SELECT * FROM wf_m WHERE segment = 'oos') o USING (symbol, window_ix, combo_id)""", "wf_eval", "wf_m")
cte("wf_best", "SELECT * FROM wf_join QUALIFY row_number() OVER (PARTITION BY symbol, window_ix ORDER BY is_sharpe DESC, combo_id) = 1", "wf_join")
cte("wf_combo", """SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(score, 9) DESC, combo_id) = 1 AS is_best FROM (
  SELECT *, greatest(avg_oos_sharpe, 0) * (0.4 + 0.6 * consistency) * least(1.0, total_oos_trades / 100) * least(1.0, n_windows / w) AS score FROM (
   SELECT j.symbol, combo_id, avg(coalesce(oos_sharpe, 0)) AS avg_oos_sharpe, count(*) FILTER (oos_sharpe > 0) / count(*) AS consistency, CAST(sum(coalesce(oos_n_trades, 0)) AS BIGINT) AS total_oos_trades, count(*) AS n_windows, any_value(w) AS w
   FROM wf_join j JOIN (SELECT symbol, count(*) AS w FROM wf_best GROUP BY symbol) USING (symbol) GROUP BY ALL))""", "wf_join", "wf_best")
cte("wf_sum", """SELECT *, CASE WHEN avg_is_sharpe > 0 THEN avg_oos_sharpe / avg_is_sharpe ELSE 0 END AS oos_is_ratio, CASE WHEN pos <= 0 THEN 1 ELSE abs(bad) / pos END AS tail_ratio FROM (
  SELECT symbol, count(*) AS n_windows, avg(is_sharpe) AS avg_is_sharpe, avg(oos_sharpe) AS avg_oos_sharpe, count(*) FILTER (oos_sharpe > 0) / count(*) AS consistency, count(*) FILTER (oos_net_return_pct > 0) / count(*) AS win_rate_oos,
   coalesce(sum(oos_net_return_pct) FILTER (oos_net_return_pct > 0), 0) AS pos, coalesce(sum(oos_net_return_pct) FILTER (oos_net_return_pct < -20), 0) AS bad, CAST(sum(oos_n_trades) AS BIGINT) AS total_trades FROM wf_best GROUP BY symbol)""", "wf_best")


def wf_metrics(t):
    """Metrics of every (segment, combination); stored, as all reports read it."""
    return t._kept("walk-forward", lambda: W.segment_metrics(W.segments(t.bars(), PLAN), IBS, COMBOS, ACCOUNT))


def found(t):
    """The two-stage search; only what a stage looks at is run."""
    metrics = t._kept("two-stage", lambda: W.two_stage_metrics(W.segments(t.bars(), PLAN), IBS, COMBOS, GRID, ACCOUNT, COARSE, TOP))
    return W.search(metrics, COMBOS, GRID, COARSE, TOP)


@query("WFO1", with_("wf_seg", body="""SELECT symbol, window_ix, min(date) FILTER (segment = 'is') AS is_start, max(date) FILTER (segment = 'is') AS is_end, min(date) FILTER (segment = 'oos') AS oos_start, max(date) FILTER (segment = 'oos') AS oos_end FROM wf_seg GROUP BY ALL"""))
def wfo1(t):
    return W.windows(t.bars(), PLAN)


@query("WFO2", with_("bars", body="""SELECT b.symbol, thr.v AS entry_threshold, s.v AS sma_period, count(*) FILTER (bar_ix >= s.v + 10) AS n_usable FROM bars b
   JOIN (VALUES ('AFRICA', 0.3), ('*', 0.1), ('*', 0.2)) thr(k, v) ON thr.k = CASE WHEN b.symbol = 'AFRICA' THEN 'AFRICA' ELSE '*' END CROSS JOIN (VALUES (50), (100)) s(v) GROUP BY ALL"""), round={"entry_threshold": 2}, ints=("sma_period",))
def wfo2(t):
    default, override = {"ibs_entry_threshold": [0.1, 0.2], "sma_trend_period": [50, 100]}, {"AFRICA": {"ibs_entry_threshold": [0.3]}}
    n = t.bars().groupBy("symbol").agg(*[F.count_if(F.col("bar_ix") >= p + 10).alias(f"n{p}") for p in default["sma_trend_period"]])
    rows = lambda grid: F.array(*[F.struct(F.lit(c["ibs_entry_threshold"]).alias("entry_threshold"), F.lit(c["sma_trend_period"]).alias("sma_period"), F.col(f"n{c['sma_trend_period']}").alias("n_usable")) for c in IBS.combos(grid)])
    merged = rows(default)
    for sym, own in override.items():
        merged = F.when(F.col("symbol") == sym, rows({**default, **own})).otherwise(merged)
    return n.select("symbol", F.inline(merged))


@query("WFO3", with_("wf_last", body=f"""SELECT symbol, combo_id, last + 1 AS n_windows FROM wf_last, (SELECT i AS combo_id FROM range(648) r(i) ORDER BY substr(md5('42|' || i), 1, 13) LIMIT 200)"""))
def wfo3(t):
    ids = W.coarse_ids(648, 200)
    w = W.windows(t.bars(), PLAN).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_windows"))
    return w.select("symbol", F.explode(F.array(*[F.lit(i) for i in ids])).alias("combo_id"), "n_windows")


@query("WFO4", with_("wf_rank", body="SELECT symbol, window_ix, combo_id, sharpe, rank FROM wf_rank"), round={"sharpe": 6}, ints=("combo_id",))
def wfo4(t):
    return found(t).ranked.select("symbol", "window_ix", "combo_id", "sharpe", "rank")


@query("WFO5", with_("wf_eval", body="SELECT symbol, window_ix, combo_id FROM wf_eval"), ints=("combo_id",))
def wfo5(t):
    return found(t).evaluated


_BEST = "symbol, window_ix, combo_id, is_sharpe, oos_sharpe, oos_net_return_pct, oos_profit_factor, oos_n_trades"
_BD = {"is_sharpe": 6, "oos_sharpe": 6, "oos_net_return_pct": 6, "oos_profit_factor": 6}


@query("WFO6", with_("wf_best", body=f"SELECT {_BEST} FROM wf_best"), round=_BD, ints=("combo_id",))
def wfo6(t):
    return found(t).best.select(*[c.strip() for c in _BEST.split(",")])


@query("JON11", with_("wf_join", body=f"SELECT {_BEST} FROM wf_join"), round=_BD, ints=("combo_id",))
def jon11(t):
    return found(t).joined.select(*[c.strip() for c in _BEST.split(",")])


_CD = {"avg_oos_sharpe": 6, "consistency": 6, "score": 6}


@query("WFO7", with_("wf_combo", body="SELECT symbol, combo_id, avg_oos_sharpe, consistency, total_oos_trades, n_windows, score, is_best FROM wf_combo"), round=_CD, ints=("combo_id",))
def wfo7(t):
    return W.combo_table(found(t)).select("symbol", "combo_id", "avg_oos_sharpe", "consistency", "total_oos_trades", "n_windows", "score", "is_best")


@query("SCA12", with_("wf_combo", body="SELECT symbol, combo_id, score FROM wf_combo"), round={"score": 6}, ints=("combo_id",))
def sca12(t):
    return W.combo_table(found(t)).select("symbol", "combo_id", "score")


_VALS = {"thr": GRID["ibs_entry_threshold"], "xthr": GRID["ibs_exit_threshold"], "per": GRID["sma_trend_period"]}
_NEAR = " ".join(f"WHEN '{k}' THEN list_min(list_transform([{', '.join(f'CAST({v} AS DOUBLE)' for v in vs)}], lambda v: {{'d': abs(v - median), 'v': v}})).v" for k, vs in _VALS.items())
cte("wf_rec", f"""SELECT symbol, param, median, CASE param {_NEAR} END AS recommended FROM (SELECT symbol, param, quantile_cont(value, 0.5) AS median FROM (
  SELECT b.symbol, unnest([{{'param': 'thr', 'value': CAST(thr AS DOUBLE)}}, {{'param': 'xthr', 'value': CAST(xthr AS DOUBLE)}}, {{'param': 'per', 'value': CAST(per AS DOUBLE)}}], recursive := true) FROM wf_best b JOIN wf_g g USING (combo_id)) GROUP BY ALL)""", "wf_best", "wf_g")
_PN = {"ibs_entry_threshold": "thr", "ibs_exit_threshold": "xthr", "sma_trend_period": "per"}


def best_params(t):
    name = F.create_map(*[F.lit(x) for kv in _PN.items() for x in kv])
    return W.recommended(found(t).best, COMBOS, GRID).withColumn("param", name[F.col("param")])


@query("WFO8", with_("wf_rec", body="SELECT symbol, param, median, recommended FROM wf_rec"), round={"median": 6, "recommended": 6})
def wfo8(t):
    return best_params(t)


@query("WFO8_mode", with_("wf_best", "wf_g", body="""SELECT symbol, value, n FROM (SELECT symbol, CASE WHEN per = 50 THEN 'short' ELSE 'long' END AS value, count(*) AS n, min(window_ix) AS f FROM wf_best JOIN wf_g USING (combo_id) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY n DESC, f) = 1"""))
def wfo8_mode(t):
    per = F.array(*[F.lit(p["sma_trend_period"]) for p in COMBOS])[F.col("combo_id")]
    return W.most_common(found(t).best, F.when(per == 50, "short").otherwise("long"))


_SD = {"avg_is_sharpe": 6, "avg_oos_sharpe": 6, "consistency": 6, "win_rate_oos": 6, "oos_is_ratio": 6, "tail_ratio": 6}


@query("WFO9", with_("wf_sum", body="SELECT symbol, n_windows, avg_is_sharpe, avg_oos_sharpe, oos_is_ratio, consistency FROM wf_sum"), round={k: 6 for k in ("avg_is_sharpe", "avg_oos_sharpe", "oos_is_ratio", "consistency")})
def wfo9(t):
    return W.window_summary(found(t).best).select("symbol", "n_windows", "avg_is_sharpe", "avg_oos_sharpe", "oos_is_ratio", "consistency")


@query("WFO10", with_("wf_sum", body="SELECT symbol, win_rate_oos, tail_ratio FROM wf_sum"), round={"win_rate_oos": 6, "tail_ratio": 6})
def wfo10(t):
    return W.window_summary(found(t).best).select("symbol", "win_rate_oos", "tail_ratio")


def grade_sql(sharpe: str) -> str:
    score = f"least(20.0, {sharpe} * 3.5) + win_rate_oos * 20 + greatest(0, 15 * (1 - tail_ratio * 1.5)) + least(1.0, greatest(0.0, avg_oos_sharpe / 2)) * 15 + 0.7 * 15 + consistency * 10 + 5 - greatest(0, (24 - n_windows) * 0.8)"
    return f"""SELECT symbol, total_trades, score, greatest(CASE WHEN score >= 85 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 55 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END, CASE WHEN total_trades > 0 AND total_trades < 30 THEN 'C' WHEN total_trades > 0 AND total_trades < 50 THEN 'B' ELSE 'A' END) AS grade FROM (SELECT *, {score} AS score FROM wf_sum)"""


@query("SCA13", with_("wf_sum", body=grade_sql("avg_oos_sharpe")), round={"score": 6})
def sca13(t):
    return W.graded(W.window_summary(found(t).best)).select("symbol", "total_trades", "score", "grade")


@query("SCA14", with_("wf_sum", body=grade_sql("greatest(0, avg_oos_sharpe - 0.15)")), round={"score": 6})
def sca14(t):
    return W.graded(W.window_summary(found(t).best), cut=0.15).select("symbol", "total_trades", "score", "grade")


@query("WFO11", with_("wf_sum", "wf_rec", body=f"""SELECT symbol, g.grade, g.score, s.n_windows, s.avg_oos_sharpe, r.per AS recommended_period FROM ({grade_sql('greatest(0, avg_oos_sharpe - 0.15)')}) g JOIN wf_sum s USING (symbol) JOIN (SELECT symbol, max(recommended) FILTER (param = 'per') AS per FROM wf_rec GROUP BY symbol) r USING (symbol)"""),
       round={"score": 6, "avg_oos_sharpe": 6, "recommended_period": 2})
def wfo11(t):
    f = found(t)
    rec = W.recommended(f.best, COMBOS, GRID).filter("param = 'sma_trend_period'").select("symbol", F.col("recommended").alias("recommended_period"))
    return W.graded(W.window_summary(f.best), cut=0.15).join(rec, "symbol").select("symbol", "grade", "score", "n_windows", "avg_oos_sharpe", "recommended_period")


# ---------------------------------------------------------------- overfitting checks

cte("bt_blocks", "SELECT symbol, CAST((rn - 1) // 10 AS BIGINT) AS block, return_pct AS r FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY entry_ix) AS rn FROM trc)", "trc")
cte("bt_shape", "SELECT symbol, max(block) + 1 AS nb, count(*) AS n, round(least(100.0, avg(r) / stddev_pop(r)), 9) AS real_sharpe FROM bt_blocks GROUP BY symbol", "bt_blocks")
cte("bt_dist", """SELECT d.symbol, d.sim, round(least(100.0, avg(b.r) / stddev_pop(b.r)), 9) AS sharpe FROM (
   SELECT symbol, sim, CAST(floor(CAST('0x' || substr(md5('42|' || symbol || '|' || sim || '|' || slot), 1, 13) AS BIGINT) / 4503599627370496.0 * nb) AS BIGINT) AS block
     FROM (SELECT *, unnest(range(nb)) AS slot FROM bt_shape WHERE n >= 30) s, range(1000) x(sim)) d
  JOIN bt_blocks b ON b.symbol = d.symbol AND b.block = d.block GROUP BY ALL""", "bt_blocks", "bt_shape")
cte("boot", """SELECT s.symbol, s.n AS n_trades, s.real_sharpe, CASE WHEN s.n < 5 THEN 1.0 WHEN s.n < 30 THEN 0.5 ELSE d.p END AS p_value, d.ci_low, d.ci_high, s.n < 30 AS underpowered FROM bt_shape s LEFT JOIN (
   SELECT symbol, avg(CASE WHEN d.sharpe >= x.real_sharpe THEN 1.0 ELSE 0.0 END) AS p, quantile_cont(d.sharpe, 0.05) AS ci_low, quantile_cont(d.sharpe, 0.95) AS ci_high FROM bt_dist d JOIN bt_shape x USING (symbol) GROUP BY symbol) d USING (symbol)""", "bt_shape", "bt_dist")


def closed(t):
    return t.ibs_trades().filter("closed")


@query("STA1", with_("boot", body="SELECT * FROM boot"), round={"real_sharpe": 6, "p_value": 6, "ci_low": 6, "ci_high": 6})
def sta1(t):
    return R.block_bootstrap(closed(t), ["symbol"])


cte("mom", """SELECT symbol, count(*) AS n_trades, least(100.0, avg(return_pct) / stddev_pop(return_pct)) AS sharpe, sum(pow(return_pct - m, 3)) / count(*) / pow(stddev_pop(return_pct), 3) AS skewness,
  sum(pow(return_pct - m, 4)) / count(*) / pow(stddev_pop(return_pct), 4) AS kurtosis FROM (SELECT *, avg(return_pct) OVER (PARTITION BY symbol) AS m FROM trc) GROUP BY symbol""", "trc")


@query("STA2", with_("mom", body="SELECT * FROM mom"), round={"sharpe": 6, "skewness": 6, "kurtosis": 6})
def sta2(t):
    return R.moments(closed(t), ["symbol"])


def dsr_cte(name: str, k: str) -> None:
    cte(name, f"""SELECT symbol, n_trades, sharpe, top AS max_expected_sharpe, z, CASE WHEN n_trades < 5 THEN 0 ELSE {cdf_sql('z')} END AS dsr FROM (SELECT *, (sharpe - top) * sqrt(n_trades - 1) / sqrt(CASE WHEN d <= 0 THEN 1e-6 ELSE d END) AS z FROM (
       SELECT *, sqrt(2 * ln(24)) - (ln(pi()) + 0.5772156649) / (2 * sqrt(2 * ln(24))) AS top, 1 - skewness * sharpe + ({k}) / 4 * sharpe * sharpe AS d FROM mom))""", "mom")


dsr_cte("dsr", "kurtosis - 4")
dsr_cte("dsr_pub", "kurtosis - 1")
_DSR = {"sharpe": 6, "max_expected_sharpe": 6, "z": 6, "dsr": 8}
_DC = ["symbol", "n_trades", "sharpe", "max_expected_sharpe", "z", "dsr"]


@query("STA3", with_("dsr", body="SELECT * FROM dsr"), round=_DSR)
def sta3(t):
    return R.deflated_sharpe(R.moments(closed(t), ["symbol"]), 24).select(*_DC)


@query("STA3_published", with_("dsr_pub", body="SELECT * FROM dsr_pub"), round=_DSR)
def sta3_published(t):
    return R.deflated_sharpe(R.moments(closed(t), ["symbol"]), 24, published=True).select(*_DC)


_NAMES = ["ibs_entry_threshold", "ibs_exit_threshold", "sma_trend_period"]
TRIES = R.perturbations(IBS.params(), _NAMES)
_TC = [(i, p["ibs_entry_threshold"], p["ibs_exit_threshold"], p["sma_trend_period"]) for i, (_, p) in enumerate(TRIES)]
grid_trades("pt", "bars", "symbol", _TC, "bars")
_LB = ", ".join(f"({i}, '{n}')" for i, (n, _) in enumerate(TRIES) if n)
cte("stab", f"""SELECT symbol, param, greatest(0, least(1, 1 - max(greatest(0, (ref - sharpe) / greatest(abs(ref), 0.1))))) AS stability FROM (SELECT m.symbol, l.param, m.sharpe, b.sharpe AS ref FROM pt_m m JOIN (VALUES {_LB}) l(combo_id, param) USING (combo_id) JOIN (SELECT * FROM pt_m WHERE combo_id = 0) b ON b.symbol = m.symbol) GROUP BY ALL""", "pt_m")


def stability(t):
    combos = [p for _, p in TRIES]
    bars = t.bars().withColumns({"window_ix": F.lit(0), "segment": F.lit("all")})
    m = W.segment_metrics(bars, IBS, combos, ACCOUNT).withColumn("sharpe", F.round("sharpe", 9))
    return R.parameter_stability(m, TRIES, _NAMES)


@query("STA4", with_("stab", body="SELECT symbol, param, stability, stability < 0.5 AS cliff FROM stab"), round={"stability": 6})
def sta4(t):
    return stability(t)


cte("conv", """SELECT param, CASE WHEN count(*) < 2 THEN 1 WHEN avg(recommended) = 0 THEN CASE WHEN stddev_pop(recommended) = 0 THEN 1 ELSE 0 END ELSE greatest(0, least(1, 1 - stddev_pop(recommended) / abs(avg(recommended)))) END AS score FROM wf_rec GROUP BY param""", "wf_rec")


@query("STA5", with_("conv", body="SELECT param, score, score < 0.5 AS divergent FROM conv"), round={"score": 6})
def sta5(t):
    return R.convergence(best_params(t).withColumn("value", F.col("recommended")))


@query("STA6", with_("boot", "dsr", "stab", "conv", body="""SELECT b.symbol, b.p_value, d.dsr, s.overall AS stability, (SELECT avg(score) FROM conv) AS convergence FROM boot b JOIN dsr d USING (symbol) JOIN (SELECT symbol, avg(stability) AS overall FROM stab GROUP BY symbol) s USING (symbol)"""),
       round={"p_value": 6, "dsr": 8, "stability": 6, "convergence": 6})
def sta6(t):
    tr = closed(t)
    b = R.block_bootstrap(tr, ["symbol"]).select("symbol", "p_value")
    d = R.deflated_sharpe(R.moments(tr, ["symbol"]), 24).select("symbol", "dsr")
    s = stability(t).groupBy("symbol").agg(F.avg("stability").alias("stability"))
    c = R.convergence(best_params(t).withColumn("value", F.col("recommended"))).agg(F.avg("score").alias("convergence"), F.lit(1).alias("_one"))
    return b.join(d, "symbol").join(s, "symbol").withColumn("_one", F.lit(1)).join(F.broadcast(c), "_one").drop("_one")


# ---------------------------------------------------------------- signals of the day

cte("sig_in", """SELECT i.*, r.rsi_2, CASE WHEN i.bar_ix % 4 = 0 THEN 'open' WHEN i.bar_ix % 4 = 1 THEN 'pending' ELSE 'none' END AS status, i.bar_ix % 7 = 0 AS watch FROM ind i LEFT JOIN rsi2 r USING (symbol, bar_ix)
   WHERE i.sma_200 IS NOT NULL AND r.rsi_2 IS NOT NULL""", "ind", "rsi2")


def every_bar(t):
    """All bars with what the daily rules read, and a position state that cycles through the cases."""
    f = home_rows(indicator_frame(t.bars(), Needs(sma={5, 200}, rsi={2}))).filter("sma_200 IS NOT NULL AND rsi_2 IS NOT NULL")
    k = F.col("bar_ix") % 4
    return f.withColumns({
        "status": F.when(k == 0, "open").when(k == 1, "pending").otherwise("none"), "watch": F.col("bar_ix") % 7 == 0})


_RSI_OK, _TREND = "rsi_2 < 10", "close > sma_200 * CAST(1.01 AS DOUBLE)"


@query("SIG1", with_("sig_in", body=f"""SELECT symbol, bar_ix, CASE WHEN status = 'pending' THEN CASE WHEN {_RSI_OK} AND {_TREND} THEN 'PENDING_VALID' ELSE 'PENDING_EXPIRED' END
   WHEN status = 'open' THEN CASE WHEN close > sma_5 THEN 'SELL' WHEN close < sma_200 THEN 'SAFETY_EXIT' ELSE 'HOLD' END WHEN watch THEN 'WATCH' WHEN {_RSI_OK} AND {_TREND} THEN 'BUY' ELSE 'NO_SIGNAL' END AS signal,
   CASE WHEN status = 'pending' THEN CASE WHEN {_RSI_OK} AND {_TREND} THEN 'Pending BUY still valid (RSI=' || printf('%.1f', round(rsi_2, 1)) || ')' ELSE 'Pending expired: ' || concat_ws(', ', CASE WHEN NOT ({_RSI_OK}) THEN 'RSI(2)=' || printf('%.1f', round(rsi_2, 1)) || ' >= 10.0' END, CASE WHEN NOT ({_TREND}) THEN 'Close < SMA200*1.01' END) END
    WHEN status = 'open' THEN CASE WHEN close > sma_5 THEN 'Close (' || printf('%.2f', round(close, 2)) || ') > SMA5 (' || printf('%.2f', round(sma_5, 2)) || ') -- sell at next open' WHEN close < sma_200 THEN 'Close (' || printf('%.2f', round(close, 2)) || ') < SMA200 (' || printf('%.2f', round(sma_200, 2)) || ') -- safety exit at next open' ELSE 'No exit condition met' END
    WHEN {_RSI_OK} AND {_TREND} THEN CASE WHEN watch THEN 'Would trigger BUY (RSI=' || printf('%.1f', round(rsi_2, 1)) || ' < 10.0, trend OK) -- watchlist only' ELSE 'RSI(2)=' || printf('%.1f', round(rsi_2, 1)) || ' < 10.0, trend OK -- buy at next open' END ELSE 'No entry conditions met' END AS notes FROM sig_in"""))
def sig1(t):
    st, w = F.col("status"), F.col("watch")
    return every_bar(t).select("symbol", "bar_ix", G.rsi_signal(st, w).alias("signal"), G.rsi_notes(st, w).alias("notes"))


@query("SIG2", with_("sig_in", body="""SELECT symbol, bar_ix, CASE WHEN status = 'open' THEN CASE WHEN ibs0 > 0.8 THEN 'SELL' WHEN close > p_high THEN 'SELL' WHEN close < sma_200 THEN 'SAFETY_EXIT' ELSE 'HOLD' END
   WHEN watch THEN 'WATCH' WHEN ibs0 < 0.2 AND close > sma_200 THEN 'BUY' ELSE 'NO_SIGNAL' END AS signal FROM (SELECT *, coalesce(ibs, 0.5) AS ibs0 FROM sig_in)"""))
def sig2(t):
    f = every_bar(t).withColumn("ibs", F.coalesce("ibs", F.lit(0.5)))
    return f.select("symbol", "bar_ix", G.ibs_signal(F.col("status"), F.col("watch")).alias("signal"))


@query("SIG3", with_("sig_in", body="""SELECT symbol, bar_ix, CASE WHEN status = 'open' THEN CASE WHEN date_trunc('month', date - 12) <> date_trunc('month', date) AND dom >= 3 THEN 'SELL' ELSE 'HOLD' END WHEN watch THEN 'WATCH' WHEN days_left <= 5 THEN 'BUY' ELSE 'NO_SIGNAL' END AS signal FROM sig_in"""))
def sig3(t):
    f = every_bar(t)
    return f.select("symbol", "bar_ix", G.tom_signal(F.col("status"), F.col("watch"), F.date_sub("date", 12)).alias("signal"))


MEMBERS = [(s, sym, watch, i) for s in ("rsi2", "ibs", "tom") for i, (sym, watch) in enumerate(
    [("MIDDLE EAST", False), ("AFRICA", False), ("EUROPE", False), ("EURUSD=X", False), ("ASIA", False), ("AMERICA", True)])]
_MV = ", ".join(f"('{s}', '{y}', {str(w).lower()}, {i})" for s, y, w, i in MEMBERS)
cte("members", f"SELECT * FROM (VALUES {_MV}) v(strategy, symbol, is_watch, ord)")
cte("held", "SELECT strategy, symbol, min(entry_date) AS entry_date FROM (SELECT CASE strategy WHEN 'ibs_loose' THEN 'tom' ELSE strategy END AS strategy, symbol, entry_date FROM desk WHERE status = 'open') GROUP BY ALL", "desk")


def members(t):
    return t.spark.createDataFrame(MEMBERS, "strategy string, symbol string, is_watch boolean, ord int")


def held(t):
    kind = F.when(F.col("strategy") == "ibs_loose", "tom").otherwise(F.col("strategy"))
    return t.desk().filter("status = 'open'").withColumn("strategy", kind)


@query("SIG4", with_("members", "bars", body="SELECT symbol, string_agg(DISTINCT strategy, ',' ORDER BY strategy) AS strategies, (SELECT count(*) FROM bars b WHERE b.symbol = m.symbol) AS n_bars FROM members m WHERE strategy <> 'rsi2' OR symbol = 'ASIA' GROUP BY symbol"))
def sig4(t):
    m = members(t)
    enabled = m.filter("strategy <> 'rsi2'").select("strategy", "symbol").union(m.filter("strategy = 'rsi2' AND symbol = 'ASIA'").select("strategy", "symbol"))
    n = t.bars().groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bars"))
    g = enabled.groupBy("symbol").agg(F.array_join(F.array_sort(F.collect_set("strategy")), ",").alias("strategies"))
    return g.join(n, "symbol", "left").fillna(0, ["n_bars"])


cte("snap_book", f"""SELECT i.symbol, i.bar_ix, i.date, i.close, i.p_high AS prev_high, r.rsi_2, i.sma_5, i.sma_200, coalesce(i.ibs, 0.5) AS ibs, i.dom, 1 AS days_left FROM ind i LEFT JOIN rsi2 r USING (symbol, bar_ix)
   WHERE i.date <= DATE '{BOOK}' QUALIFY row_number() OVER (PARTITION BY i.symbol ORDER BY i.bar_ix DESC) = 1""", "ind", "rsi2")
cte("evald", f"""SELECT m.*, s.date, s.close, s.rsi_2, s.ibs, s.sma_200, s.days_left, CASE WHEN s.close IS NULL THEN 'NO_SIGNAL'
   WHEN m.strategy = 'rsi2' THEN CASE WHEN h.symbol IS NOT NULL THEN CASE WHEN close > sma_5 THEN 'SELL' WHEN close < sma_200 THEN 'SAFETY_EXIT' ELSE 'HOLD' END WHEN is_watch THEN 'WATCH' WHEN {_RSI_OK} AND {_TREND} THEN 'BUY' ELSE 'NO_SIGNAL' END
   WHEN m.strategy = 'ibs' THEN CASE WHEN h.symbol IS NOT NULL THEN CASE WHEN ibs > 0.8 OR close > prev_high THEN 'SELL' WHEN close < sma_200 THEN 'SAFETY_EXIT' ELSE 'HOLD' END WHEN is_watch THEN 'WATCH' WHEN ibs < 0.2 AND close > sma_200 THEN 'BUY' ELSE 'NO_SIGNAL' END
   ELSE CASE WHEN h.symbol IS NOT NULL THEN CASE WHEN date_trunc('month', h.entry_date) <> date_trunc('month', s.date) AND dom >= 3 THEN 'SELL' ELSE 'HOLD' END WHEN is_watch THEN 'WATCH' WHEN days_left <= 5 THEN 'BUY' ELSE 'NO_SIGNAL' END END AS raw_signal,
   CASE WHEN s.close IS NULL THEN 'ERROR: no data' ELSE '' END AS notes FROM members m LEFT JOIN snap_book s USING (symbol) LEFT JOIN held h ON h.strategy = m.strategy AND h.symbol = m.symbol""", "members", "snap_book", "held")


def evaluated(t):
    return G.evaluate(members(t), snapshot(t, BOOK), held(t))


@query("SIG5", with_("evald", body="SELECT strategy, symbol, raw_signal, notes FROM evald"))
def sig5(t):
    return evaluated(t).select("strategy", "symbol", "raw_signal", "notes")


# slots are few, so the first BUYs in list order win and later ones are skipped; sells free a slot
cte("slots", """WITH RECURSIVE l AS (SELECT e.*, row_number() OVER (PARTITION BY e.strategy ORDER BY ord) AS k, coalesce(n.n, 0) AS n0, CASE WHEN floor(5000 / close) >= 1 THEN floor(5000 / close) ELSE 0 END AS sh FROM evald e LEFT JOIN (SELECT strategy, count(*) AS n FROM held GROUP BY ALL) n USING (strategy)),
   w AS (SELECT strategy, 0 AS k, max(n0) AS n, CAST(NULL AS VARCHAR) AS symbol, CAST(NULL AS VARCHAR) AS signal, CAST(NULL AS DOUBLE) AS shares FROM l GROUP BY strategy
     UNION ALL SELECT l.strategy, CAST(l.k AS INT), w.n + CASE WHEN l.raw_signal = 'BUY' AND NOT l.is_watch AND w.n < 2 AND l.sh > 0 THEN 1 WHEN l.raw_signal IN ('SELL', 'SAFETY_EXIT') THEN -1 ELSE 0 END, l.symbol,
       CASE WHEN l.raw_signal = 'BUY' AND NOT l.is_watch AND w.n >= 2 THEN 'SKIP' ELSE l.raw_signal END, CASE WHEN l.raw_signal = 'BUY' AND (l.is_watch OR w.n < 2) THEN l.sh END FROM w JOIN l ON l.strategy = w.strategy AND l.k = w.k + 1)
   SELECT strategy, symbol, signal, shares FROM w WHERE k > 0""", "evald", "held")


def guarded(t, as_of=BOOK):
    counts = held(t).groupBy("strategy").agg(F.countDistinct("symbol").alias("n_open"))
    return G.guard(evaluated(t), counts, {"rsi2": 2, "ibs": 2, "tom": 2}, 5000.0, 1.0, F.lit(as_of).cast("date"))


@query("SIG6", with_("slots", body="SELECT strategy, symbol, signal FROM slots"))
def sig6(t):
    return guarded(t).select("strategy", "symbol", "signal")


@query("SIG7", with_("evald", body="SELECT strategy, symbol, CASE WHEN raw_signal = 'BUY' THEN 'SKIP' ELSE raw_signal END AS signal FROM evald"))
def sig7(t):
    return guarded(t, "2000-03-27").select("strategy", "symbol", "signal")


@query("SIG8", with_("slots", "snap_book", body="""SELECT strategy, symbol, CASE WHEN signal = 'BUY' THEN 'open' ELSE 'close' END AS action, s.date, s.close AS price, CASE WHEN signal = 'BUY' THEN shares END AS shares FROM slots JOIN snap_book s USING (symbol)
   WHERE (signal = 'BUY' AND shares > 0) OR signal IN ('SELL', 'SAFETY_EXIT')"""), round={"shares": 0})
def sig8(t):
    snap = snapshot(t, BOOK).select("symbol", "date", F.col("close").alias("price"))
    act = F.when(F.col("signal") == "BUY", "open").otherwise("close")
    return guarded(t).filter("(signal = 'BUY' AND shares > 0) OR signal IN ('SELL', 'SAFETY_EXIT')").join(snap, "symbol").select("strategy", "symbol", act.alias("action"), "date", "price", "shares")


@query("SIG9", with_("sig_in", body="""SELECT symbol, bar_ix, 'rsi2' AS strategy, 'RSI=' || printf('%.1f', round(rsi_2, 1)) || '/10' AS label, round_even((20 - rsi_2) / 10 * 100, 1) AS pct FROM sig_in WHERE rsi_2 > 10 AND rsi_2 < 20 AND close > sma_200 * CAST(1.01 AS DOUBLE)
   UNION ALL SELECT symbol, bar_ix, 'ibs', 'IBS=' || printf('%.3f', round(ibs, 3)) || '/0.2', round_even((0.4 - ibs) / (0.4 - 0.2) * 100, 1) FROM sig_in WHERE ibs > 0.2 AND ibs < 0.4 AND close > sma_200"""), round={"pct": 1})
def sig9(t):
    f = every_bar(t).withColumn("raw_signal", F.lit("NO_SIGNAL")).withColumn("strategy", F.explode(F.array(F.lit("rsi2"), F.lit("ibs"))))
    f = f.select(F.struct("symbol", "bar_ix").alias("symbol"), "strategy", "raw_signal", "rsi_2", "ibs", "close", "sma_200")
    return G.approaching(f).select("symbol.symbol", "symbol.bar_ix", "strategy", "label", "pct")


cte("desk_marks", """SELECT CASE strategy WHEN 'ibs_loose' THEN 'tom' ELSE strategy END AS strategy, count(*) AS n_open, coalesce(round_even(sum((s.close - entry_price) * shares), 2), 0) AS unrealized_pnl,
   coalesce(string_agg(symbol || ' ' || CAST(CAST(shares AS BIGINT) AS VARCHAR), ', ' ORDER BY symbol, shares), '') AS positions FROM desk LEFT JOIN snap_book s USING (symbol) WHERE status = 'open' GROUP BY 1""", "desk", "snap_book")


@query("SIG10", with_("slots", "desk_marks", body="""SELECT s.strategy, count(*) FILTER (signal = 'BUY') AS n_buy, count(*) FILTER (signal IN ('SELL', 'SAFETY_EXIT')) AS n_sell, count(*) FILTER (signal = 'HOLD') AS n_hold, count(*) FILTER (signal = 'SKIP') AS n_skip,
   coalesce(max(n_open), 0) AS n_open, coalesce(max(unrealized_pnl), 0.0) AS unrealized_pnl, coalesce(max(positions), '') AS positions,
   upper(s.strategy) || ': ' || count(*) FILTER (signal = 'BUY') || ' BUY, ' || count(*) FILTER (signal IN ('SELL', 'SAFETY_EXIT')) || ' SELL' AS line FROM slots s LEFT JOIN desk_marks m ON m.strategy = s.strategy GROUP BY s.strategy"""), round={"unrealized_pnl": 2})
def sig10(t):
    g = guarded(t).withColumn("kind", F.when(F.col("signal") == "SAFETY_EXIT", "SELL").otherwise(F.col("signal")))
    return G.summary(g, held(t), snapshot(t, BOOK).select("symbol", F.col("close").alias("current_price")))


@query("SIG10_alerts", with_("sig_in", body="""SELECT symbol, bar_ix, pct FROM (SELECT symbol, bar_ix, round_even((0.4 - ibs) / (0.4 - 0.2) * 100, 1) AS pct FROM sig_in WHERE ibs > 0.2 AND ibs < 0.4 AND close > sma_200) ORDER BY pct DESC, symbol, bar_ix LIMIT 5"""), round={"pct": 1})
def sig10_alerts(t):
    f = every_bar(t).withColumns({"raw_signal": F.lit("NO_SIGNAL"), "strategy": F.lit("ibs")})
    f = f.select(F.struct("symbol", "bar_ix").alias("symbol"), "strategy", "raw_signal", "rsi_2", "ibs", "close", "sma_200")
    return G.approaching(f).select("symbol.symbol", "symbol.bar_ix", "pct").orderBy(F.col("pct").desc(), "symbol", "bar_ix").limit(5)
