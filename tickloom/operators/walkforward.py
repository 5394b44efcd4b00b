"""Walk-forward search: rolling in-sample/out-of-sample segments, ranking and grading."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scalars as S
from ..presets import WALK_FORWARD
from ..session import materialise
from . import metrics as M
from .ledger import Account, ledger
from .rules import RuleSpec

SEGMENT = ("symbol", "window_ix", "segment")


@dataclass(frozen=True)
class Plan:
    """Window sizes in bars."""

    is_bars: int = WALK_FORWARD["is_days"]
    embargo: int = WALK_FORWARD["embargo_days"]
    oos_bars: int = WALK_FORWARD["oos_days"]
    step: int = WALK_FORWARD["step_days"]

    @property
    def total(self) -> int:
        return self.is_bars + self.embargo + self.oos_bars

    @property
    def oos_offset(self) -> int:
        return self.is_bars + self.embargo


def _last_window(bars: DataFrame, plan: Plan) -> DataFrame:
    n = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"))
    return n.select("symbol", F.floor((F.col("_n") - plan.total) / F.lit(plan.step)).cast("int").alias("_last")).filter("_last >= 0")


def windows(bars: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """First and last date of every in-sample and out-of-sample segment."""
    seg = segments(bars, plan)
    g = seg.groupBy("symbol", "window_ix").agg(*[
        agg(F.when(F.col("segment") == s, F.col("date"))).alias(f"{s}_{n}") for s in ("is", "oos") for n, agg in (("start", F.min), ("end", F.max))])
    return g


def segments(bars: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """Each bar once per segment it belongs to, ``bar_ix`` counted from the segment's start.

    The windows of a bar follow from its index by arithmetic, so no range join is needed.
    """
    ix, step = F.col("bar_ix"), plan.step
    last = _last_window(bars, plan)

    def part(name: str, offset: int, length: int) -> Column:
        j = ix - offset
        lo = F.greatest(F.lit(0), F.ceil((j - (length - 1)) / F.lit(step)).cast("int"))
        hi = F.least(F.col("_last"), F.floor(j / F.lit(step)).cast("int"))
        ws = F.when((j >= 0) & (lo <= hi), F.sequence(lo, F.greatest(lo, hi))).otherwise(F.array().cast("array<int>"))
        return F.transform(ws, lambda w: F.struct(w.alias("window_ix"), F.lit(name).alias("segment"), (j - w * step).alias("_ix")))

    every = F.concat(part("is", 0, plan.is_bars), part("oos", plan.oos_offset, plan.oos_bars))
    out = bars.join(last, "symbol").select(*bars.columns, F.inline(every))
    fresh = {c: F.when(F.col("_ix") > 0, F.col(c)) for c in out.columns if c.startswith("prev_")}
    return out.withColumns({"bar_ix": F.col("_ix"), **fresh}).drop("_ix")


def segment_metrics(seg: DataFrame, rule: RuleSpec, combos: Sequence[dict], account: Account, wanted: DataFrame | None = None) -> DataFrame:
    """Older metric set per (segment, combination); combinations without trades are rows of zeros.

    ``wanted`` lists the (segment, combination) pairs to run, all if it is None. Returns are measured on the capital after the trade and annualised by calendar length.
    The result is stored: every step of a search reads it.
    """
    tr = ledger(seg, rule, combos, account, keys=SEGMENT, wanted=wanted).filter("closed").withColumn("_r", F.col("pnl") / F.col("capital_after"))
    pnl = F.col("pnl")
    m = tr.groupBy(*SEGMENT, "combo_id").agg(
        F.count(F.lit(1)).alias("n"), (F.sum(pnl) / account.capital * 100).alias("ret"), M.profit_factor(pnl).alias("pf"),
        F.avg("_r").alias("_m"), F.stddev_pop("_r").alias("_s"))
    sizes = seg.groupBy(*SEGMENT).agg((F.count(F.lit(1)) * 365.0 / 252.0).alias("_days"))
    grid = sizes.withColumn("combo_id", F.explode(F.sequence(F.lit(0), F.lit(len(combos) - 1)))) if wanted is None else sizes.join(wanted.select(*SEGMENT, "combo_id"), list(SEGMENT))
    j = grid.join(m, [*SEGMENT, "combo_id"], "left")
    sh = F.least(F.lit(100.0), F.try_divide(F.col("_m"), F.col("_s")) * F.sqrt(F.col("n") / F.greatest(F.col("_days"), F.lit(1.0)) * 365))
    ok = (F.col("n") >= 3) & (F.col("_s") > 1e-10)
    return materialise(j.select(
        *SEGMENT, "combo_id", F.coalesce(F.when(ok, sh), F.lit(0.0)).alias("sharpe"), F.coalesce("ret", F.lit(0.0)).alias("net_return_pct"),
        F.coalesce("pf", F.lit(0.0)).alias("profit_factor"), F.coalesce("n", F.lit(0)).alias("n_trades")), "segment-metrics")


def sample_key(i: int, seed: int = 42) -> str:
    """Deterministic random order of a grid: the leading 52 bits of an md5."""
    return hashlib.md5(f"{seed}|{i}".encode()).hexdigest()[:13]


def coarse_ids(n: int, limit: int = 200, seed: int = 42) -> list[int]:
    """At most ``limit`` combinations drawn without replacement, in grid order."""
    return sorted(sorted(range(n), key=lambda i: sample_key(i, seed))[:limit])


def neighbours(combos: Sequence[dict], grid: dict) -> list[list[int]]:
    """For each combination the ids one grid step away in one dimension, and itself."""
    at = {tuple(p[k] for k in grid): i for i, p in enumerate(combos)}
    out = []
    for p in combos:
        ids = set()
        for k, values in grid.items():
            j = values.index(p[k])
            for q in values[max(0, j - 1) : j + 2]:
                ids.add(at[tuple(q if x == k else p[x] for x in grid)])
        out.append(sorted(ids))
    return out


def two_stage_metrics(seg: DataFrame, rule: RuleSpec, combos: Sequence[dict], grid: dict, account: Account, coarse_max: int = 200, top: int = 20) -> DataFrame:
    """Metrics of what a two-stage search looks at, and of nothing else: the coarse combinations in sample, the neighbours of
    the best of them in sample, and all of these out of sample. Each stage's (segment, combination) table limits the candidates of its run."""
    by = ["symbol", "window_ix"]
    part = lambda s: seg.filter(F.col("segment") == s)
    at = {s: part(s).select(*SEGMENT).distinct() for s in ("is", "oos")}
    coarse = at["is"].withColumn("combo_id", F.explode(F.array(*[F.lit(i) for i in coarse_ids(len(combos), coarse_max)])))
    first = segment_metrics(part("is"), rule, combos, account, coarse)
    fine = _neighbourhood(_ranked(first.withColumn("sharpe", F.round("sharpe", 9)), top), combos, grid)
    more = materialise(fine.distinct().join(coarse, [*by, "combo_id"], "left_anti").withColumn("segment", F.lit("is")), "fine-set")
    second = segment_metrics(part("is"), rule, combos, account, more)
    seen = coarse.select(*by, "combo_id").unionByName(more.select(*by, "combo_id")).join(at["oos"], by)
    return first.unionByName(second).unionByName(segment_metrics(part("oos"), rule, combos, account, seen))


def _ranked(coarse: DataFrame, top: int) -> DataFrame:
    w = Window.partitionBy("symbol", "window_ix").orderBy(F.col("sharpe").desc(), "combo_id")
    return coarse.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def _neighbourhood(ranked: DataFrame, combos: Sequence[dict], grid: dict) -> DataFrame:
    near = F.array(*[F.array(*[F.lit(j) for j in ids]) for ids in neighbours(combos, grid)])
    return ranked.select("symbol", "window_ix", F.explode(near[F.col("combo_id")]).alias("combo_id"))


@dataclass
class Search:
    """Result tables of a walk-forward search."""

    ranked: DataFrame
    evaluated: DataFrame
    best: DataFrame
    joined: DataFrame


def search(metrics: DataFrame, combos: Sequence[dict], grid: dict, coarse_max: int = 200, top: int = 20) -> Search:
    """Coarse pass, best ``top``, their neighbours, best of all, and its out-of-sample result.

    ``metrics`` holds all combinations, or those of ``two_stage_metrics`` with the same settings.
    """
    by = ["symbol", "window_ix"]
    s = metrics.withColumn("sharpe", F.round("sharpe", 9))
    ins, oos = s.filter("segment = 'is'").drop("segment"), s.filter("segment = 'oos'").drop("segment")
    coarse = ins.filter(F.col("combo_id").isin(coarse_ids(len(combos), coarse_max)))
    ranked = _ranked(coarse, top)
    fine = _neighbourhood(ranked, combos, grid)
    evaluated = coarse.select(*by, "combo_id").unionByName(fine).distinct()
    cols = ["sharpe", "net_return_pct", "profit_factor", "n_trades"]
    rename = lambda df, p: df.select(*by, "combo_id", *[F.col(c).alias(f"{p}_{c}") for c in cols])
    joined = evaluated.join(rename(ins, "is"), [*by, "combo_id"]).join(rename(oos, "oos"), [*by, "combo_id"], "left")
    best = joined.groupBy(*by).agg(F.max_by(F.struct(*[c for c in joined.columns if c not in by]), F.struct("is_sharpe", -F.col("combo_id"))).alias("_b")).select(*by, "_b.*")
    return Search(ranked, evaluated, best, joined)


def combo_table(found: Search) -> DataFrame:
    """Per symbol and combination: mean out-of-sample Sharpe, consistency, trades, score, best flag."""
    total = found.best.groupBy("symbol").agg(F.count(F.lit(1)).alias("_w"))
    oos = F.coalesce("oos_sharpe", F.lit(0.0))
    g = found.joined.groupBy("symbol", "combo_id").agg(
        F.avg(oos).alias("avg_oos_sharpe"), (F.count_if(oos > 0) / F.count(F.lit(1))).alias("consistency"),
        F.sum(F.coalesce("oos_n_trades", F.lit(0))).alias("total_oos_trades"), F.count(F.lit(1)).alias("n_windows")).join(total, "symbol")
    score = S.combo_score(F.col("avg_oos_sharpe"), F.col("consistency"), F.col("total_oos_trades"), F.col("n_windows"), F.col("_w"))
    g = g.withColumn("score", score)
    w = Window.partitionBy("symbol").orderBy(F.round("score", 9).desc(), "combo_id")
    return g.withColumn("is_best", F.row_number().over(w) == 1).drop("_w")


def recommended(best: DataFrame, combos: Sequence[dict], grid: dict) -> DataFrame:
    """Median of the windows' best values per parameter, moved to the nearest grid value."""
    names = [k for k, v in grid.items() if all(isinstance(x, (int, float)) for x in v)]
    table = F.array(*[F.struct(*[F.lit(float(p[k])).alias(k) for k in names]) for p in combos])
    b = best.select("symbol", *[table[F.col("combo_id")][k].alias(k) for k in names])
    long = b.unpivot(["symbol"], names, "param", "value").groupBy("symbol", "param").agg(F.percentile("value", F.lit(0.5)).alias("median"))
    values = F.create_map(*[x for k in names for x in (F.lit(k), F.array(*[F.lit(float(v)) for v in sorted(grid[k])]))])
    near = F.array_min(F.transform(values[F.col("param")], lambda v: F.struct(F.abs(v - F.col("median")).alias("d"), v.alias("v"))))["v"]
    return long.withColumn("recommended", near)


def most_common(best: DataFrame, label: Column) -> DataFrame:
    """Most frequent value per symbol, the one seen first on a tie (for parameters that are not numbers)."""
    c = best.groupBy("symbol", label.alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min("window_ix").alias("first"))
    return c.groupBy("symbol").agg(F.max_by("value", F.struct("n", -F.col("first"))).alias("value"), F.max("n").alias("n"))


def window_summary(best: DataFrame) -> DataFrame:
    """Means over windows, their ratio, consistency, window win rate and tail ratio."""
    r = F.col("oos_net_return_pct")
    g = best.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_windows"), F.avg("is_sharpe").alias("avg_is_sharpe"), F.avg("oos_sharpe").alias("avg_oos_sharpe"),
        (F.count_if(F.col("oos_sharpe") > 0) / F.count(F.lit(1))).alias("consistency"), (F.count_if(r > 0) / F.count(F.lit(1))).alias("win_rate_oos"),
        F.coalesce(F.sum(F.when(r > 0, r)), F.lit(0.0)).alias("_pos"), F.coalesce(F.sum(F.when(r < -20, r)), F.lit(0.0)).alias("_bad"), F.sum("oos_n_trades").alias("total_trades"))
    ratio = F.when(F.col("avg_is_sharpe") > 0, F.try_divide("avg_oos_sharpe", "avg_is_sharpe")).otherwise(F.lit(0.0))
    tail = F.when(F.col("_pos") <= 0, F.lit(1.0)).otherwise(F.try_divide(F.abs("_bad"), F.col("_pos")))
    return g.withColumns({"oos_is_ratio": ratio, "tail_ratio": tail}).drop("_pos", "_bad")


def graded(summary: DataFrame, dsr: Column | None = None, stability: Column | None = None, cut: float = 0.0) -> DataFrame:
    """Score and letter per symbol; without real inputs the customary placeholders are used."""
    dsr = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("avg_oos_sharpe") / 2)) if dsr is None else dsr
    stability = F.lit(0.7) if stability is None else stability
    sharpe = S.haircut(F.col("avg_oos_sharpe"), cut) if cut else F.col("avg_oos_sharpe")
    score = S.grade_score(sharpe, F.col("win_rate_oos"), F.col("tail_ratio"), dsr, stability, F.col("consistency"), F.col("n_windows"))
    out = summary.withColumn("score", score)
    return out.withColumn("grade", S.grade_letter(F.col("score"), F.col("total_trades")))
