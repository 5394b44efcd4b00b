import hashlib
import math

import pytest
from pyspark.sql import functions as F

from tickloom.functions import scalars as S
from tickloom.operators import metrics as M, resampling as R, walkforward as W
from tickloom.operators.rules import DONCHIAN, IBS, RSI2, TOM
from tickloom.presets import FEES


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def t_tail(t, nu, n=20000):
    h = t / n
    f = lambda x: (1 + x * x / nu) ** (-(nu + 1) / 2)
    area = sum((1 if i in (0, n) else 4 if i % 2 else 2) * f(i * h) for i in range(n + 1)) * h / 3
    return 0.5 - area * math.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2)) / math.sqrt(nu * math.pi)


@pytest.mark.parametrize("x", [-9.0, -7.5, -3.0, -0.5, 0.0, 1.0, 2.5, 6.0, 7.9, 8.5])
def test_normal_cdf(spark, x):
    got = one(spark, S.normal_cdf(F.lit(x)))[0]
    assert got == pytest.approx(0.5 * (1 + math.erf(x / math.sqrt(2))), abs=1e-13)


@pytest.mark.parametrize("t,nu", [(0.3, 1), (1.2, 2), (2.0, 3), (2.0, 10), (2.0, 100), (2.9, 3389)])
def test_student_tail(spark, t, nu):
    assert one(spark, S.student_tail(F.lit(t), F.lit(nu)))[0] == pytest.approx(t_tail(t, nu), abs=1e-10)


@pytest.mark.parametrize("t", [0.01, 0.7, 1.96, 3.5, 7.0])
def test_student_tail_with_many_degrees_of_freedom(spark, t):
    """Beyond the finite sum: equal to it just there, next to the normal tail far out."""
    both = one(spark, S.student_tail(F.lit(t), F.lit(401)), S._student_sum(F.lit(t), F.lit(401)), S.student_tail(F.lit(t), F.lit(100_000_000)))
    assert both[0] == pytest.approx(both[1], abs=1e-12)
    assert both[2] == pytest.approx(0.5 * math.erfc(t / math.sqrt(2)), abs=1e-8)


def test_published_p_value(spark):
    assert round(one(spark, S.student_tail(F.lit(2.90), F.lit(3389)))[0], 4) == 0.0019


@pytest.mark.parametrize("name", list(FEES))
def test_fees(spark, name):
    com, pct, spread, fx, tax, night = FEES[name]
    fee = S.fee_literals(name)
    a, b, c = one(spark, S.entry_cost(F.lit(10_000.0), fee), S.exit_cost(F.lit(10_000.0), fee), S.overnight_cost(F.lit(10_000.0), F.lit(3), fee))
    assert a == pytest.approx(com + 10_000 * (pct + spread / 2 + fx + tax))
    assert b == pytest.approx(com + 10_000 * (pct + spread / 2 + fx))
    assert c == pytest.approx(10_000 * night * 3)


def trades(spark, pnls, returns=None, exits=None):
    n = len(pnls)
    rows = [(float(p), float(returns[i] if returns else p), i * 10, exits[i] if exits else i * 10 + 5, True, "closed") for i, p in enumerate(pnls)]
    return spark.createDataFrame(rows, "pnl double, return_pct double, entry_ix int, exit_ix int, closed boolean, status string").withColumn("k", F.lit(1))


def test_profit_factor_cases(spark):
    pf = lambda x: M.trade_metrics(trades(spark, x), ["k"]).first()["profit_factor"]
    assert pf([100, -50, 80, 0]) == pytest.approx(3.6)
    assert pf([10, 20]) == math.inf
    assert pf([0.0]) == 0.0
    assert pf([-5]) == 0.0


def test_sharpe_needs_two_trades_and_spread(spark):
    sh = lambda x: M.trade_metrics(trades(spark, x), ["k"]).first()["sharpe"]
    assert sh([5]) == 0.0 and sh([5, 5]) == 0.0
    r = [0.02, -0.01, 0.03]
    m = sum(r) / 3
    sd = math.sqrt(sum((x - m) ** 2 for x in r) / 3)
    assert sh(r) == pytest.approx(m / sd * math.sqrt(3 / (25 / 252)))


def test_t_test_short_series(spark):
    row = M.t_test(trades(spark, [0.5]), ["k"]).first()
    assert (row.p_value, row.significant, row.label) == (1.0, False, "NON")


def test_verdicts(spark):
    v = lambda *x: one(spark, S.verdict(*[F.lit(b) for b in x]))[0]
    assert v(True, True, True) == "VALIDATED"
    assert v(True, False, True) == v(True, True, False) == "CONDITIONAL"
    assert v(False, True, True) == v(True, False, False) == "REJECTED"


def test_grades(spark):
    g = lambda s, n: one(spark, S.grade_letter(F.lit(s), F.lit(n)))[0]
    assert [g(x, 0) for x in (85.0, 84.9, 69.9, 54.9, 39.9)] == ["A", "B", "C", "D", "F"]
    assert g(90.0, 29) == "C" and g(90.0, 49) == "B" and g(90.0, 50) == "A" and g(30.0, 29) == "F"


def test_warmups_and_grids():
    assert RSI2.warmup(RSI2.params()) == 210 and TOM.warmup(TOM.params()) == 30 and DONCHIAN.warmup(DONCHIAN.params()) == 52
    assert DONCHIAN.warmup(DONCHIAN.params(entry_mode="ema_cross")) == 52
    assert [len(r.combos()) for r in (RSI2, IBS, TOM, DONCHIAN)] == [48, 36, 12, 54]
    with pytest.raises(ValueError):
        IBS.combos({"ibs_entry_threshold": list(range(200)), "ibs_exit_threshold": list(range(200))})


def test_neighbours_move_one_dimension():
    grid = {"ibs_entry_threshold": [0.1, 0.2, 0.3], "sma_trend_period": [50, 100]}
    near = W.neighbours(IBS.combos(grid), grid)
    assert near[0] == [0, 1, 2] and near[3] == [1, 2, 3, 5]
    assert W.coarse_ids(10, 200) == list(range(10)) and len(set(W.coarse_ids(648))) == 200


def test_perturbations_round_whole_numbers():
    tries = R.perturbations({"a": 5, "b": 0.5, "c": 0, "d": "x"}, ["a", "b", "c", "d"])
    assert [p["a"] for n, p in tries if n == "a"] == [4, 6, 4, 6] and len(tries) == 9


def test_text_helpers(spark):
    row = one(spark, S.display_name(F.lit("EURUSD=X")), S.display_name(F.lit("ABC")), S.logo_link(F.lit("EURUSD=X")),
              S.site_domain(F.lit("https://www.example.org/a/b")), S.escape_html(F.lit("a<b & c>d")))
    assert tuple(row) == ("EUR/USD", "ABC", None, "example.org", "a&lt;b &amp; c&gt;d")


def drawn(key, sim, slot, n):
    """The block a slot draws: a uniform number from the leading 52 bits of an md5, scaled."""
    return int(int(hashlib.md5(f"42|{key}|{sim}|{slot}".encode()).hexdigest()[:13], 16) / 2**52 * n)


def test_bootstrap_matches_direct_resampling(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    r = rng.normal(0.002, 0.02, 57).round(6).tolist()
    got = R.block_bootstrap(trades(spark, r), ["k"], sims=200).first()
    blocks = [r[i : i + 10] for i in range(0, 57, 10)]
    sharpe = lambda x: round(float(np.mean(x) / np.std(x)), 9)
    dist = [sharpe(sum((blocks[drawn(got.k, s, k, len(blocks))] for k in range(len(blocks))), [])) for s in range(200)]
    assert got.real_sharpe == pytest.approx(sharpe(r), abs=1e-9)
    assert got.p_value == pytest.approx(sum(d >= sharpe(r) for d in dist) / 200)
    assert got.ci_low == pytest.approx(np.percentile(dist, 5), abs=1e-8)


@pytest.mark.parametrize("n", [8, 16])
def test_blocks_are_drawn_with_replacement(spark, n):
    """Distinct blocks per simulation and the spread of the number of draws of a block are those of uniform draws."""
    draws = spark.range(1000).selectExpr("id AS sim", f"explode(sequence(0, {n - 1})) AS slot")
    draws = draws.withColumn("b", F.floor(R.uniform(F.lit("a"), F.col("sim"), F.col("slot")) * n))
    assert {tuple(r) for r in draws.limit(50).collect()} == {(s, k, drawn("a", s, k, n)) for s, k, _ in draws.limit(50).collect()}
    distinct = draws.groupBy("sim").agg(F.count_distinct("b").alias("d")).agg(F.avg("d")).first()[0]
    assert distinct / n == pytest.approx(1 - (1 - 1 / n) ** n, abs=0.015)
    hits = draws.groupBy("sim").agg(F.count_if(F.col("b") == 0).alias("h")).agg(F.avg("h"), F.var_samp("h")).first()
    assert hits[0] == pytest.approx(1, abs=0.12) and hits[1] == pytest.approx(1 - 1 / n, abs=0.17)
