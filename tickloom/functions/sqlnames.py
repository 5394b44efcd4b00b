"""Trade metrics under names that SQL text can use: temporary functions with SQL bodies, no Python at run time.

Arguments are computed before a body chooses its branch, so every call is defined for all values and bounded. The scalar functions take aggregates (sums, means, counts), so a query keeps its map-side partial aggregates; the table
function ``trade_metrics()`` reads the temporary view ``trades`` (``symbol, pnl, return_pct, entry_ix, exit_ix, closed``) that the session has then.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

SCALARS = {
    "profit_factor(gain DOUBLE, loss DOUBLE) RETURNS DOUBLE": "CASE WHEN loss = 0 THEN CASE WHEN gain > 0 THEN DOUBLE('Infinity') ELSE 0D END ELSE try_divide(gain, loss) END",
    "annual_sharpe(mean DOUBLE, deviation DOUBLE, n BIGINT, bars BIGINT) RETURNS DOUBLE": "CASE WHEN n >= 2 AND deviation > 0 THEN try_divide(mean, deviation) * sqrt(n / (greatest(bars, 1) / 252.0D)) ELSE 0D END",
    "t_statistic(mean DOUBLE, deviation DOUBLE, n BIGINT) RETURNS DOUBLE": "CASE WHEN n >= 2 AND deviation > 0 THEN try_divide(mean, deviation / sqrt(n)) ELSE 0D END",
    # the finite sum up to 400 degrees of freedom; the angle and its sine and cosine are one array
    "student_tail_sum(t DOUBLE, nu BIGINT) RETURNS DOUBLE": """aggregate(array(named_struct('a', atan(t / sqrt(nu)), 'odd', nu % 2 = 1)), 0D, (z, w) -> 0.5D - CASE
        WHEN nu = 1 THEN w.a / pi()
        WHEN w.odd THEN (w.a + sin(w.a) * aggregate(sequence(1, cast((nu - 1) / 2 AS INT)), named_struct('term', cos(w.a), 'total', 0D),
          (s, k) -> named_struct('term', s.term * cos(w.a) * cos(w.a) * (2D * k) / (2D * k + 1), 'total', s.total + s.term), s -> s.total)) / pi()
        ELSE sin(w.a) * aggregate(sequence(1, cast(nu / 2 AS INT)), named_struct('term', 1D, 'total', 0D),
          (s, k) -> named_struct('term', s.term * cos(w.a) * cos(w.a) * (2D * k - 1) / (2D * k), 'total', s.total + s.term), s -> s.total) / 2 END)""",
    "normal_tail(x DOUBLE) RETURNS DOUBLE": """CASE WHEN x > 8 THEN 0D WHEN x < -8 THEN 1D ELSE 0.5D - exp(-x * x / 2) / sqrt(2 * pi())
        * aggregate(sequence(1, 120), named_struct('term', x, 'total', x), (s, k) -> named_struct('term', s.term * x * x / (2 * k + 1), 'total', s.total + s.term * x * x / (2 * k + 1)), s -> s.total) END""",
    # the normal quantile with the same tail, for more degrees of freedom
    "student_normal(t DOUBLE, nu BIGINT) RETURNS DOUBLE": """aggregate(array(named_struct('a', nu - 0.5D, 'z2', (nu - 0.5D) * log1p(t * t / nu))), 0D, (z, w) ->
        sqrt(w.z2) + sqrt(w.z2) * (w.z2 + 3) / (48 * w.a * w.a) - sqrt(w.z2) * (((4 * w.z2 + 33) * w.z2 + 240) * w.z2 + 855) / (10 * 48 * w.a * w.a * (48 * w.a * w.a + 0.8D * w.z2 * w.z2 + 100)))""",
    "one_sided_p(t DOUBLE, n BIGINT) RETURNS DOUBLE": "CASE WHEN t > 0 THEN CASE WHEN n <= 401 THEN student_tail_sum(t, least(greatest(n, 2), 401) - 1) ELSE normal_tail(student_normal(t, greatest(n, 2) - 1)) END ELSE 1D END",
}

TABLE = """trade_metrics() RETURNS TABLE (symbol STRING, n_trades BIGINT, win_rate DOUBLE, profit_factor DOUBLE, sharpe DOUBLE, t_stat DOUBLE, p_value DOUBLE)
RETURN SELECT symbol, n, wins / n, profit_factor(gain, loss), annual_sharpe(mean, dev, n, bars), t_statistic(mean, sample_dev, n), one_sided_p(t_statistic(mean, sample_dev, n), n) FROM (
  SELECT symbol, count(*) AS n, count_if(pnl > 0) AS wins, coalesce(sum(CASE WHEN pnl > 0 THEN pnl END), 0D) AS gain, abs(coalesce(sum(CASE WHEN pnl <= 0 THEN pnl END), 0D)) AS loss,
    avg(return_pct) AS mean, stddev_pop(return_pct) AS dev, stddev_samp(return_pct) AS sample_dev, CAST(max(exit_ix) - min(entry_ix) AS BIGINT) AS bars
  FROM trades WHERE closed GROUP BY symbol)"""


def register(spark: SparkSession) -> None:
    """Make the functions known to the session; registering again replaces them."""
    for head, body in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")


def register_table(spark: SparkSession, trades) -> None:
    """Name the trades and the table function over them."""
    register(spark)
    trades.createOrReplaceTempView("trades")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {TABLE}")
