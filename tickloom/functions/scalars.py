"""Scalar column functions: costs, sizing, probabilities, scores and labels."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from ..presets import FEE_FIELDS, FEES


def fee_literals(name: str) -> dict[str, Column]:
    return {k: F.lit(v) for k, v in zip(FEE_FIELDS, FEES[name])}


def fee_columns() -> dict[str, Column]:
    return {k: F.col(k) for k in FEE_FIELDS}


def entry_cost(notional: Column, fee: dict[str, Column]) -> Column:
    return (
        fee["commission_per_trade"]
        + notional * fee["commission_pct"]
        + notional * fee["spread_pct"] / 2
        + notional * fee["fx_conversion_pct"]
        + notional * fee["tax_pct"]
    )


def exit_cost(notional: Column, fee: dict[str, Column]) -> Column:
    return (
        fee["commission_per_trade"]
        + notional * fee["commission_pct"]
        + notional * fee["spread_pct"] / 2
        + notional * fee["fx_conversion_pct"]
    )


def overnight_cost(notional: Column, days: Column, fee: dict[str, Column]) -> Column:
    return notional * fee["overnight_daily_pct"] * days


def net_pnl(direction: Column, entry: Column, exit_: Column, qty: Column, days: Column, fee: dict[str, Column]) -> Column:
    """Profit after both fees and overnight cost."""
    gross = direction * (exit_ - entry) * qty
    return gross - entry_cost(entry * qty, fee) - exit_cost(exit_ * qty, fee) - overnight_cost(entry * qty, days, fee)


def entry_fill(open_: Column, direction: Column, slip: float) -> Column:
    return open_ * (1 + direction * F.lit(slip))


def exit_fill(price: Column, direction: Column, slip: float) -> Column:
    return price * (1 - direction * F.lit(slip))


def whole_quantity(cash: Column, price: Column) -> Column:
    """Whole shares for the cash; NULL when not even one fits."""
    q = F.floor(F.try_divide(cash, price))
    return F.when(q >= 1, q.cast("double"))


def cagr(first: Column, last: Column, years: Column) -> Column:
    ok = (first > 0) & (last > 0) & (years > 0)
    return F.when(ok, (F.pow(F.try_divide(last, first), F.try_divide(F.lit(1.0), years)) - 1) * 100).otherwise(F.lit(0.0))


def normal_cdf(x: Column) -> Column:
    """Series around zero, exact to the last digits for |x| <= 8 and 0/1 beyond."""
    phi = F.exp(-x * x / 2) / F.lit(math.sqrt(2 * math.pi))
    start = F.struct(x.alias("term"), x.alias("total"))

    def grow(acc, k):
        term = acc["term"] * x * x / (2 * k + 1)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(120)), start, grow, lambda acc: acc["total"])
    return F.when(x > 8, F.lit(1.0)).when(x < -8, F.lit(0.0)).otherwise(0.5 + phi * series)


FINITE_SUM_NU = 400


def student_tail(t: Column, nu: Column) -> Column:
    """P(T > t) for t > 0, in at most 200 steps whatever the degrees of freedom.

    Up to 400 degrees of freedom the finite trigonometric sum (Abramowitz & Stegun 26.7.3-4); beyond, the normal
    tail of the transformed t (Hill 1970), which agrees with the sum to better than 1e-12 there.
    """
    few = F.least(nu, F.lit(FINITE_SUM_NU))
    return F.when(nu <= FINITE_SUM_NU, _student_sum(t, few)).otherwise(1 - normal_cdf(_student_normal(t, nu)))


def _student_normal(t: Column, nu: Column) -> Column:
    """The normal quantile with the tail of ``t``, for many degrees of freedom."""
    a = nu - 0.5
    b = 48 * a * a
    z2 = a * F.log1p(t * t / nu)
    z = F.sqrt(z2)
    return z + z * (z2 + 3) / b - z * (((4 * z2 + 33) * z2 + 240) * z2 + 855) / (10 * b * (b + 0.8 * z2 * z2 + 100))


def _student_sum(t: Column, nu: Column) -> Column:
    theta = F.atan(F.try_divide(t, F.sqrt(nu)))
    c, s = F.cos(theta), F.sin(theta)
    odd = (nu % 2) == 1
    first = F.when(odd, c).otherwise(F.lit(1.0))
    terms = F.when(odd, (nu - 3) / 2).otherwise((nu - 2) / 2).cast("int")
    start = F.struct(first.alias("term"), first.alias("total"))

    def grow(acc, k):
        num = F.when(odd, 2.0 * k).otherwise(2.0 * k - 1)
        den = F.when(odd, 2.0 * k + 1).otherwise(2.0 * k)
        term = acc["term"] * c * c * num / den
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    steps = F.when(terms >= 1, F.sequence(F.lit(1), F.greatest(terms, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(steps, start, grow, lambda acc: acc["total"])
    odd_body = F.when(nu == 1, F.lit(0.0)).otherwise(s * total)
    inside = F.when(odd, 2 / F.lit(math.pi) * (theta + odd_body)).otherwise(s * total)
    return (1 - inside) / 2


def expected_max_sharpe(trials: Column) -> Column:
    root = F.sqrt(2 * F.ln(trials))
    value = root - F.lit(math.log(math.pi) + 0.5772156649) / (2 * root)
    return F.when(trials <= 1, F.lit(0.0)).otherwise(value)


def significance_label(p: Column) -> Column:
    return F.when(p < 0.05, F.lit("OUI (p<0.05)")).when(p < 0.10, F.lit("MARGINAL (p<0.10)")).otherwise(F.lit("NON"))


def verdict(robust: Column, stable: Column, significant: Column) -> Column:
    return (
        F.when(robust & stable & significant, F.lit("VALIDATED"))
        .when(robust & (stable | significant), F.lit("CONDITIONAL"))
        .otherwise(F.lit("REJECTED"))
    )


def combo_score(sharpe: Column, consistency: Column, trades: Column, windows: Column, max_windows: Column) -> Column:
    share = F.when(max_windows > 0, F.least(F.lit(1.0), F.try_divide(windows, max_windows))).otherwise(F.lit(1.0))
    return F.greatest(sharpe, F.lit(0.0)) * (0.4 + 0.6 * consistency) * F.least(F.lit(1.0), trades / 100) * share


def grade_score(sharpe, win_rate, tail_ratio, dsr, stability, consistency, n_windows) -> Column:
    """0-100 points, less 0.8 per window short of 24."""
    raw = (
        F.least(F.lit(20.0), sharpe * 3.5)
        + win_rate * 20
        + F.greatest(F.lit(0.0), 15 * (1 - tail_ratio * 1.5))
        + dsr * 15
        + stability * 15
        + consistency * 10
        + 5
    )
    return raw - F.greatest(F.lit(0.0), (24 - n_windows) * 0.8)


def grade_letter(score: Column, trades: Column) -> Column:
    """Letter from the score; few trades cap it at C (<30) or B (<50)."""
    letter = (
        F.when(score >= 85, F.lit("A")).when(score >= 70, F.lit("B")).when(score >= 55, F.lit("C"))
        .when(score >= 40, F.lit("D")).otherwise(F.lit("F"))
    )
    cap = F.when((trades > 0) & (trades < 30), F.lit("C")).when((trades > 0) & (trades < 50), F.lit("B")).otherwise(F.lit("A"))
    return F.greatest(letter, cap)


def haircut(sharpe: Column, amount: float = 0.15) -> Column:
    return F.greatest(F.lit(0.0), sharpe - F.lit(amount))


def perturbed(value: Column, pct: Column, whole: bool) -> Column:
    """A parameter moved by ``pct``; whole numbers are rounded half-even with floor 1."""
    moved = value * (1 + pct)
    return F.greatest(F.lit(1.0), F.rint(moved)) if whole else F.greatest(F.lit(0.01), moved)


def proximity_pct(value: Column, threshold: Column, zone: Column) -> Column:
    between = F.try_divide(zone - value, zone - threshold) * 100
    return F.bround(F.when(value <= threshold, F.lit(100.0)).when(value >= zone, F.lit(0.0)).otherwise(between), 1)


def proximity_near(value: Column, threshold: Column, zone: Column, trend_ok: Column | None = None) -> Column:
    near = (value < zone) & (value > threshold)
    return near if trend_ok is None else near & F.coalesce(trend_ok, F.lit(True))


def stale(last: Column, as_of: Column, max_days: int = 2) -> Column:
    return F.date_diff(as_of, last) > max_days


def escape_html(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    return F.replace(out, F.lit(">"), F.lit("&gt;"))


def fixed(value: Column, digits: int) -> Column:
    """Number as text with a fixed count of decimals."""
    return F.format_string(f"%.{digits}f", F.round(value, digits))


def is_fx(symbol: Column) -> Column:
    return symbol.contains("=X")


def logo_link(symbol: Column) -> Column:
    return F.when(~is_fx(symbol), F.concat(F.lit("/api/market/asset/"), symbol, F.lit("/logo")))


def display_name(symbol: Column) -> Column:
    """``ABCDEF=X`` reads ``ABC/DEF``; other symbols stay."""
    base = F.replace(symbol, F.lit("=X"), F.lit(""))
    pair = F.concat(F.substring(base, 1, 3), F.lit("/"), F.substring(base, 4, 3))
    return F.when(is_fx(symbol) & (F.length(base) == 6), pair).otherwise(symbol)


def site_domain(url: Column) -> Column:
    """Host of a web address without scheme, ``www.`` and path."""
    bare = F.regexp_replace(url, "^https?://", "")
    return F.split_part(F.regexp_replace(bare, "^www\\.", ""), F.lit("/"), F.lit(1))


def finite(x: Column) -> Column:
    return F.when(F.abs(x) < float("inf"), x)
