"""Technical and calendar indicators as columns on a bar table."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialise
from .spans import Affine, affine_scan, span_order, spread

FIXED_POINT = 1_000_000.0  # prices are summed as whole millionths: exact and order-free


@dataclass
class Needs:
    """Which indicator columns a set of rules reads."""

    sma: set[int] = field(default_factory=set)
    ema: set[int] = field(default_factory=set)
    rsi: set[int] = field(default_factory=set)
    atr: set[int] = field(default_factory=set)
    adx: set[int] = field(default_factory=set)
    high: set[int] = field(default_factory=set)
    low: set[int] = field(default_factory=set)
    lags: dict[str, set[int]] = field(default_factory=dict)
    ahead: int = 0

    def lag(self, name: str, n: int = 1) -> Needs:
        self.lags.setdefault(name, set()).add(n)
        return self

    def merge(self, other: Needs) -> Needs:
        for f in ("sma", "ema", "rsi", "atr", "adx", "high", "low"):
            getattr(self, f).update(getattr(other, f))
        for name, ns in other.lags.items():
            self.lags.setdefault(name, set()).update(ns)
        self.ahead = max(self.ahead, other.ahead)
        return self

    @property
    def reach(self) -> int:
        lag = max((n for ns in self.lags.values() for n in ns), default=0)
        return max([1, *self.sma, *self.high, *self.low]) + lag

    @property
    def recursive(self) -> bool:
        return bool(self.ema or self.rsi or self.atr or self.adx)


def lag_name(name: str, n: int = 1) -> str:
    return f"{name}_lag{n}"


def ibs() -> Column:
    """Position of the close inside the bar's range; NULL without a range."""
    rng = F.col("high") - F.col("low")
    return F.when(rng > 0, (F.col("close") - F.col("low")) / rng)


def true_range(prev_close: Column) -> Column:
    hl = F.col("high") - F.col("low")
    wide = F.greatest(hl, F.abs(F.col("high") - prev_close), F.abs(F.col("low") - prev_close))
    return F.when(prev_close.isNull(), hl).otherwise(wide)


def _seeded(x: Column, first: int, seed_at: int, decay: float, weight: float, tail: float) -> Column:
    """Steps of a recurrence whose value at ``seed_at`` is ``weight * sum(x[first..seed_at])``."""
    ix = F.col("bar_ix")
    head = x * F.lit(weight) * F.pow(F.lit(1.0 / decay if decay > 0 else 1.0), F.lit(seed_at) - ix)
    return F.when(ix < first, F.lit(0.0)).when(ix <= seed_at, head).otherwise(x * F.lit(tail))


def _ema(p: int) -> Affine:
    a = (p - 1) / (p + 1)
    return Affine(f"ema_{p}", _seeded(F.col("close"), 0, p - 1, a, 1 / p, 2 / (p + 1)), a)


def _wilder_mean(out: str, x: Column, p: int, first: int = 1) -> Affine:
    a = (p - 1) / p
    return Affine(out, _seeded(x, first, first + p - 1, a, 1 / p, 1 / p), a)


def _wilder_sum(out: str, x: Column, p: int) -> Affine:
    a = (p - 1) / p
    return Affine(out, _seeded(x, 1, p, a, 1.0, 1.0), a)


def _since(ix: int, value: Column) -> Column:
    return F.when(F.col("bar_ix") >= ix, value)


def indicator_frame(bars: DataFrame, needs: Needs, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Bars with every column in ``needs``; rows are partitioned by ``(keys, span)``.

    Recurrences come first, by blocks; rolling columns and look-backs then share one
    exchange and one sort.
    """
    keys = list(keys)
    if needs.recursive:
        bars = _recurrences(with_previous(bars, keys), needs, keys)
    f = spread(bars, before=needs.reach, after=needs.ahead)
    w = span_order(keys)
    first = {"ibs": ibs()}
    if needs.sma:
        fixed = F.round(F.col("close") * FIXED_POINT).cast("long")
        first["_cum"] = F.sum(fixed).over(w.rowsBetween(Window.unboundedPreceding, 0))
    f = f.withColumns(first)
    cols: dict[str, Column] = {}
    for p in sorted(needs.sma):
        total = F.col("_cum") - F.coalesce(F.lag("_cum", p).over(w), F.lit(0))
        cols[f"sma_{p}"] = _since(p - 1, total.cast("double") / F.lit(float(p)) / F.lit(FIXED_POINT))
    for p in sorted(needs.high):
        cols[f"high_{p}"] = _since(p, F.max("high").over(w.rowsBetween(-p, -1)))
    for p in sorted(needs.low):
        cols[f"low_{p}"] = _since(p, F.min("low").over(w.rowsBetween(-p, -1)))
    if cols:
        f = f.withColumns(cols).drop("_cum")
    lags = {lag_name(c, n): F.lag(c, n).over(w) for c, ns in needs.lags.items() for n in sorted(ns)}
    return f.withColumns(lags) if lags else f


def with_previous(bars: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Yesterday's close, high and low; taken as they are when the bar table has them."""
    if "prev_close" in bars.columns:
        return bars
    w = span_order(list(keys))
    f = spread(bars, before=1).withColumns({f"prev_{c}": F.lag(c).over(w) for c in ("close", "high", "low")})
    return f.filter("home").drop("span", "home")


def home_rows(frame: DataFrame) -> DataFrame:
    return frame.filter("home").drop("home") if "home" in frame.columns else frame


def _recurrences(f: DataFrame, needs: Needs, keys: list[str]) -> DataFrame:
    pc, ph, pl = F.col("prev_close"), F.col("prev_high"), F.col("prev_low")
    specs = [_ema(p) for p in sorted(needs.ema)]
    delta = F.coalesce(F.col("close") - pc, F.lit(0.0)) if needs.rsi else None
    for p in sorted(needs.rsi):
        specs.append(_wilder_mean(f"_gain_{p}", F.greatest(delta, F.lit(0.0)), p))
        specs.append(_wilder_mean(f"_loss_{p}", F.greatest(-delta, F.lit(0.0)), p))
    if needs.atr or needs.adx:
        f = f.withColumn("tr", true_range(pc))
    for p in sorted(needs.atr):
        specs.append(_wilder_mean(f"atr_{p}", F.col("tr"), p))
    if needs.adx:
        up, down = F.col("high") - ph, pl - F.col("low")
        f = f.withColumn("_up", F.when((up > down) & (up > 0), up).otherwise(F.lit(0.0)))
        f = f.withColumn("_dn", F.when((down > up) & (down > 0), down).otherwise(F.lit(0.0)))
    for p in sorted(needs.adx):
        specs += [_wilder_sum(f"_{n}_{p}", F.col(c), p) for n, c in (("str", "tr"), ("sup", "_up"), ("sdn", "_dn"))]
    f = affine_scan(f, specs, keys)
    done = {f"ema_{p}": _since(p - 1, F.col(f"ema_{p}")) for p in needs.ema}
    done |= {f"atr_{p}": _since(p, F.col(f"atr_{p}")) for p in needs.atr}
    for p in needs.rsi:
        g, l = F.col(f"_gain_{p}"), F.col(f"_loss_{p}")
        done[f"rsi_{p}"] = _since(p, F.when(l == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + F.try_divide(g, l))))
    for p in needs.adx:
        tr = F.col(f"_str_{p}")
        for out, num in (("di_plus", f"_sup_{p}"), ("di_minus", f"_sdn_{p}")):
            done[f"{out}_{p}"] = F.when(tr > 0, 100 * F.try_divide(F.col(num), tr)).otherwise(F.lit(0.0))
    f = f.withColumns(done) if done else f
    if needs.adx:
        f = materialise(f, "directional")  # read by both halves of the next scan
        second = []
        for p in sorted(needs.adx):
            a, b = F.col(f"di_plus_{p}"), F.col(f"di_minus_{p}")
            dx = F.when(a + b > 0, F.abs(a - b) / F.when(a + b > 0, a + b) * 100).otherwise(F.lit(0.0))
            second.append(_wilder_mean(f"adx_{p}", dx, p, first=p))
        f = affine_scan(f, second, keys)
        enough = {}
        n = f.groupBy(*keys).agg((F.max("bar_ix") + 1).alias("_n"))
        f = f.join(n, keys)
        for p in needs.adx:
            ok = F.col("_n") >= 2 * p + 1
            enough[f"adx_{p}"] = F.when(ok, _since(2 * p - 1, F.col(f"adx_{p}")))
            enough[f"di_plus_{p}"] = F.when(ok, _since(p, F.col(f"di_plus_{p}")))
            enough[f"di_minus_{p}"] = F.when(ok, _since(p, F.col(f"di_minus_{p}")))
        f = f.withColumns(enough).drop("_n")
    return f.drop(*[c for c in f.columns if c.startswith("_")])


def periods_of(params: Iterable[dict]) -> set[int]:
    """All distinct ``*period*`` values in a list of parameter sets."""
    return {int(v) for p in params for k, v in p.items() if "period" in k and isinstance(v, (int, float))}
