"""Signals to trades: candidates, their exits, and the ordered walk over an account."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scalars as S
from ..presets import FEES
from ..session import materialise
from .blocks import bar_blocks, first_reach
from .indicators import Needs, home_rows, indicator_frame
from .rules import LONG, SHORT, Exit, RuleSpec, ema_cross, lag
from .overlap import without_overlap
from .spans import next_hit, span_order

EXIT = "struct<bar_ix:int,prio:int,date:date,price:double,reason:string,slip:boolean>"


@dataclass(frozen=True)
class Account:
    """How trades are sized and charged."""

    capital: float = 100_000.0
    fraction: float | None = None
    slippage: float = 0.0003
    fees: str = "forex_saxo"
    whole_shares: bool = False
    max_drawdown_pct: float = 80.0
    name: str = "base"

    @property
    def closed_form(self) -> bool:
        """Without rounding and fixed charges a trade's return does not depend on capital."""
        return not self.whole_shares and FEES[self.fees][0] == 0.0


def needs_of(rule: RuleSpec, combos: Sequence[dict]) -> Needs:
    return reduce(lambda a, b: a.merge(b), [rule.needs(p) for p in combos], Needs())


def frame_for(bars: DataFrame, rule: RuleSpec, combos: Sequence[dict], keys: Sequence[str] = ("symbol",), store: bool | None = None) -> DataFrame:
    """Indicators for a rule. Stored as a table when they are costly, since pairing reads them twice."""
    needs = needs_of(rule, combos)
    frame = indicator_frame(bars, needs, keys)
    keep = (needs.recursive and not rule.ahead_exits) if store is None else store
    return materialise(home_rows(frame), f"indicators-{rule.key}") if keep else frame


def _exit_struct(e: Exit, ix, date, prio: int = 3) -> Column:
    return F.struct(
        ix.cast("int").alias("bar_ix"), F.lit(prio).alias("prio"), date.cast("date").alias("date"),
        e.price.cast("double").alias("price"), F.lit(e.reason).alias("reason"), F.lit(e.slip).alias("slip"),
    )


def first_of(exits: Sequence[Exit], ix: Column, date: Column) -> Column:
    """The first exit of the list that holds on this bar, as a struct; NULL when none does."""
    col = F.lit(None).cast(EXIT)
    for e in reversed(exits):
        col = F.when(e.when, _exit_struct(e, ix, date)).otherwise(col)
    return col


def _bounds(start: Column | None, end: Column | None) -> Column:
    ok = F.lit(True)
    if start is not None:
        ok = ok & start
    return ok if end is None else ok & end


def candidates(
    frame: DataFrame,
    rule: RuleSpec,
    combos: Sequence[dict],
    keys: Sequence[str] = ("symbol",),
    start: Column | None = None,
    end: Column | None = None,
    sides: Sequence[int] = (LONG,),
    wanted: DataFrame | None = None,
) -> DataFrame:
    """Every (bar, combination) whose entry rule holds, with the exit the bars alone decide.

    Exits are resolved once per distinct exit setting on the bar table. Combinations are
    generated only for bars with an entry, so the grid multiplies signals and not bars.
    ``start``/``end`` are conditions on a bar; bars outside them are not seen. ``wanted`` lists the
    (keys, combo_id) to generate: bars of other keys go before, and a bar generates its key's combinations only.
    """
    keys = list(keys)
    ix, date = F.col("bar_ix"), F.col("date")
    inside = _bounds(start, end)
    entry_cols, exit_cols, items = {}, {}, []
    entry_name, exit_name = {}, {}
    for cid, p in enumerate(combos):
        for side in sides:
            ekey, xkey = (*rule.entry_key(p), side), (*rule.exit_key(p), side)
            if ekey not in entry_name:
                name = entry_name[ekey] = f"_e{len(entry_name)}"
                hit = rule.entry(p, side) & (ix >= rule.warmup(p)) & inside
                entry_cols[name] = F.coalesce(hit, F.lit(False))
            exit_ref = f"CAST(NULL AS {EXIT})"
            if rule.exits:
                if xkey not in exit_name:
                    name = exit_name[xkey] = f"_x{len(exit_name)}"
                    exit_cols[name] = F.when(inside, first_of(rule.exits(p, side), ix, date))
                exit_ref = exit_name[xkey]
            item = f"named_struct('combo_id', {cid}, 'direction', {side}, 'exit', {exit_ref})"
            items.append(f"CASE WHEN {entry_name[ekey]}{'' if wanted is None else f' AND array_contains(_wanted, {cid})'} THEN {item} END")
    if rule.ahead_exits:
        frame = _with_ahead(frame, rule, combos, keys, inside)
    f = home_rows(frame).withColumns(entry_cols)
    if exit_cols:
        f = next_hit(f, exit_cols, keys)
    any_entry = reduce(lambda a, b: a | b, [F.col(n) for n in entry_cols])
    picked = F.inline(F.expr(f"filter(array({', '.join(items)}), x -> x IS NOT NULL)"))
    extra = ["month", "_ahead"] if rule.ahead_exits else []
    if wanted is not None:
        f = f.join(wanted.groupBy(*keys).agg(F.collect_set(F.col("combo_id").cast("int")).alias("_wanted")), keys)
    out = f.filter(any_entry).select(*keys, "bar_ix", "date", "open", *extra, *_carried(frame), picked)
    if rule.ahead_exits:
        out = _resolve_ahead(out, rule, combos)
    return out.withColumnsRenamed({"bar_ix": "entry_ix", "date": "entry_date", "open": "entry_open"})


def _carried(frame: DataFrame) -> list[str]:
    return [c for c in frame.columns if c.startswith("atr_") and c.endswith("_lag1")]


def _with_ahead(frame, rule, combos, keys, inside) -> DataFrame:
    """Each bar with the bars of the next ``horizon`` days; the horizon bounds the array."""
    reach = max(rule.horizon(p) for p in combos)
    fields = [c for c in ("bar_ix", "date", "close", "month", "dom", "ibs") if c in frame.columns]
    look = span_order(keys).rowsBetween(0, reach)
    return frame.withColumn("_ahead", F.collect_list(F.when(inside, F.struct(*fields))).over(look))


def _resolve_ahead(cands: DataFrame, rule: RuleSpec, combos: Sequence[dict]) -> DataFrame:
    """First bar ahead on which an entry-dependent exit holds, per combination."""
    by_exit: dict[tuple, tuple[Column, list[int]]] = {}
    for cid, p in enumerate(combos):
        key = rule.exit_key(p)
        if key not in by_exit:
            hits = F.transform("_ahead", _probe(rule, p))
            by_exit[key] = (F.try_element_at(F.filter(hits, lambda x: x.isNotNull()), F.lit(1)), [])
        by_exit[key][1].append(cid)
    col = F.lit(None).cast(EXIT)
    for first, ids in by_exit.values():
        col = F.when(F.col("combo_id").isin(ids), first).otherwise(col)
    return cands.withColumn("exit", col).drop("_ahead", "month")


def _probe(rule: RuleSpec, p: dict):
    return lambda b: first_of(rule.ahead_exits(p, b), b["bar_ix"], b["date"])


def pair(cands: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """One trade per exit bar: its earliest candidate.

    Valid when exits depend on the bar alone, one side is traded, and nothing but an open
    trade blocks an entry. Candidates without an exit form the one open trade.
    """
    first = F.min_by(F.struct("entry_date", "entry_open", "direction", "exit"), "entry_ix").alias("_f")
    g = cands.groupBy(*keys, "combo_id", F.col("exit.bar_ix").alias("_xix")).agg(F.min("entry_ix").alias("entry_ix"), first)
    return g.select(*keys, "combo_id", "entry_ix", "_f.*")


def with_mark(cands: DataFrame, bars: DataFrame, keys: Sequence[str] = ("symbol",), end: Column | None = None) -> DataFrame:
    """Add the last bar in range, which values a trade that is still open."""
    seen = bars if end is None else bars.filter(end)
    last = seen.groupBy(*keys).agg(F.max("bar_ix").alias("mark_ix"), F.max_by("close", "bar_ix").alias("mark_price"))
    return cands.join(last, list(keys), "left")


SETTLE_SPAN = 4096


def settle(trades: DataFrame, account: Account, fraction: float | Column, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Closed form of the account: capital is a running product of ``1 + fraction * return``.

    The trades are stored, then the product is taken in two steps: inside a span of bars,
    times the products of the spans before it. The drawdown stop is the first trade that
    leaves too little, one number per account.
    """
    keys = list(keys)
    group = [*keys, "combo_id"]
    fee = S.fee_literals(account.fees)
    d, closed = F.col("direction"), F.col("exit").isNotNull()
    slip = F.when(F.col("exit.slip"), F.lit(account.slippage)).otherwise(F.lit(0.0))
    t = trades.withColumns({
        "closed": closed,
        "entry_price": S.entry_fill(F.col("entry_open"), d, account.slippage),
        "exit_price": F.when(closed, F.col("exit.price") * (1 - d * slip)).otherwise(F.col("mark_price")),
        "exit_ix": F.col("exit.bar_ix"),
        "exit_date": F.col("exit.date"),
        "exit_reason": F.col("exit.reason"),
        "holding_days": F.coalesce(F.col("exit.bar_ix"), F.col("mark_ix")) - F.col("entry_ix"),
    })
    one = F.lit(1.0) / F.col("entry_price")
    r = S.net_pnl(d, F.col("entry_price"), F.col("exit_price"), one, F.col("holding_days"), fee)
    t = t.withColumns({"return_pct": r, "_part": F.floor(F.col("entry_ix") / F.lit(SETTLE_SPAN))})
    t = materialise(t.drop("exit", "mark_ix", "mark_price", "entry_open"), "trades")
    f = fraction if isinstance(fraction, Column) else F.lit(fraction)
    grow = 1 + f * F.col("return_pct")
    inside = Window.partitionBy(*group, "_part").orderBy("entry_ix")
    parts = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    local = t.withColumns({
        "_rel": F.coalesce(F.product(grow).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0)), "_grow": grow})
    local = local.withColumn("_top", F.max(F.col("_rel") * F.col("_grow")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    totals = local.groupBy(*group, "_part").agg(F.product("_grow").alias("_all"), F.max("_top").alias("_high"))
    totals = totals.withColumn("_start", F.coalesce(F.product("_all").over(parts), F.lit(1.0)) * account.capital)
    totals = totals.withColumn("_peak", F.coalesce(F.max(F.col("_start") * F.col("_high")).over(parts), F.lit(account.capital)))
    t = local.join(totals.select(*group, "_part", "_start", "_peak"), [*group, "_part"])
    t = t.withColumn("_before", F.col("_start") * F.col("_rel")).withColumns({
        "capital_after": F.col("_before") * F.col("_grow"),
        "quantity": F.col("_before") * f / F.col("entry_price"),
        "pnl": F.col("_before") * f * F.col("return_pct"),
    })
    floor = F.lit(1 - account.max_drawdown_pct / 100)
    peak = F.greatest(F.lit(account.capital), "_peak", F.col("_start") * F.col("_top"))
    broke = F.when(F.col("capital_after") < peak * floor, F.col("entry_ix"))
    halted = t.groupBy(*group).agg(F.min(broke).alias("_halt")).filter("_halt IS NOT NULL")
    t = t.join(halted, group, "left").filter("_halt IS NULL OR entry_ix <= _halt")
    qty = F.col("quantity")
    return t.withColumns({
        "entry_fee": S.entry_cost(F.col("entry_price") * qty, fee),
        "exit_fee": S.exit_cost(F.col("exit_price") * qty, fee),
        "status": F.when(F.col("closed"), F.lit("closed")).otherwise(F.lit("open")),
    }).select(*keys, "combo_id", *LEDGER)


LEDGER = [
    "direction", "entry_ix", "entry_date", "exit_ix", "exit_date", "entry_price", "exit_price", "quantity", "pnl",
    "return_pct", "holding_days", "exit_reason", "entry_fee", "exit_fee", "capital_after", "closed", "status",
]
_LEDGER_TYPES = (
    "direction int, entry_ix int, entry_date date, exit_ix int, exit_date date, entry_price double, exit_price double, "
    "quantity double, pnl double, return_pct double, holding_days int, exit_reason string, entry_fee double, "
    "exit_fee double, capital_after double, closed boolean, status string"
)


def with_accounts(cands: DataFrame, accounts: Sequence[Account]) -> DataFrame:
    """One copy of the candidates per account scenario, settings as columns."""
    def one(a: Account) -> Column:
        fee = [c.alias(k) for k, c in S.fee_literals(a.fees).items()]
        return F.struct(
            F.lit(a.name).alias("scenario"), F.lit(float(a.capital)).alias("capital"),
            F.lit(a.fraction).cast("double").alias("_fraction"), F.lit(a.slippage).alias("slippage"),
            F.lit(a.whole_shares).alias("whole_shares"), F.lit(a.max_drawdown_pct).alias("max_drawdown_pct"), *fee,
        )
    return cands.select("*", F.inline(F.array(*[one(a) for a in accounts])))


def ordered_walk(
    cands: DataFrame, combos: Sequence[dict], accounts: Sequence[Account], keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    """Walk candidates of each (key, combination, scenario) in bar order against one account.

    Needed where a trade depends on the capital left by the one before: whole shares, fixed
    commissions, cooldown, entry-dependent exits. Rows arrive sorted and are streamed batch
    by batch with a few numbers of state, so a group of any length fits. Output: one row
    per trade plus one per candidate skipped for want of a whole share.
    """
    frac = F.create_map(*[F.lit(x) for i, p in enumerate(combos) for x in (i, float(p.get("position_fraction", 1.0)))])
    cool = F.create_map(*[F.lit(x) for i, p in enumerate(combos) for x in (i, int(p.get("cooldown_candles", 0)))])
    c = with_accounts(cands, accounts)
    c = c.withColumns({
        "fraction": F.coalesce(F.col("_fraction"), frac[F.col("combo_id")]),
        "cooldown": cool[F.col("combo_id")],
        "exit_ix": F.col("exit.bar_ix"), "exit_date": F.col("exit.date"), "exit_raw": F.col("exit.price"),
        "exit_reason": F.col("exit.reason"), "exit_slip": F.coalesce(F.col("exit.slip"), F.lit(False)),
    }).drop("exit", "_fraction")
    group = [*keys, "combo_id", "scenario"]
    names = [f.name for f in cands.select(*keys).schema.fields]
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cands.select(*keys).schema.fields)
    schema = f"{head}, combo_id int, scenario string, {_LEDGER_TYPES}"
    tidy = c.select(*group, *_WALK_IN).repartition(*group).sortWithinPartitions(*group, "entry_ix", F.col("direction").desc())
    return tidy.mapInPandas(_walker(names), schema)


_WALK_IN = [
    "direction", "entry_ix", "entry_date", "entry_open", "exit_ix", "exit_date", "exit_raw", "exit_reason", "exit_slip",
    "mark_ix", "mark_price", "capital", "fraction", "slippage", "whole_shares", "max_drawdown_pct", "cooldown",
    "commission_per_trade", "commission_pct", "spread_pct", "fx_conversion_pct", "tax_pct", "overnight_daily_pct",
]


def _walker(keys: list[str]):
    group = [*keys, "combo_id", "scenario"]
    out_cols = [*group, *LEDGER]

    def walk(batches):
        import math

        import pandas as pd

        current, cap, peak, free, halted = None, 0.0, 0.0, 0, False
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                who = tuple(getattr(r, k) for k in group)
                if who != current:
                    current, cap, peak, free, halted = who, r.capital, r.capital, -1, False
                if halted or r.entry_ix < free:
                    continue
                if cap < peak * (1 - r.max_drawdown_pct / 100):
                    halted = True
                    continue
                price = r.entry_open * (1 + r.direction * r.slippage)
                qty = cap * r.fraction / price
                if r.whole_shares:
                    qty = float(math.floor(qty))
                    if qty < 1:
                        rows.append((*who, r.direction, r.entry_ix, r.entry_date, None, None, price, None, 0.0, None,
                                     None, None, None, None, None, cap, False, "skipped"))
                        continue
                notional = qty * price
                rate = r.commission_pct + r.spread_pct / 2 + r.fx_conversion_pct
                fee_in = r.commission_per_trade + notional * (rate + r.tax_pct)
                is_open = pd.isna(r.exit_ix)
                last_ix = r.mark_ix if is_open else r.exit_ix
                out = r.mark_price if is_open else r.exit_raw
                if not is_open and r.exit_slip:
                    out *= 1 - r.direction * r.slippage
                held = int(last_ix - r.entry_ix)
                fee_out = r.commission_per_trade + out * qty * rate
                pnl = r.direction * (out - price) * qty - fee_in - fee_out - notional * r.overnight_daily_pct * held
                cap += pnl
                if is_open:
                    halted, status = True, "open"
                else:
                    status = "closed" if cap > 0 else "ruined"
                    peak = max(peak, cap)
                    free = int(r.exit_ix) + 1 + r.cooldown
                rows.append((*who, r.direction, r.entry_ix, r.entry_date, None if is_open else int(r.exit_ix),
                             None if is_open else r.exit_date, price, out, qty, pnl,
                             pnl / notional if notional > 0 else 0.0, held, None if is_open else r.exit_reason,
                             fee_in, fee_out, cap, status == "closed", status))
            yield pd.DataFrame(rows, columns=out_cols)

    return walk


def stop_exits(cands: DataFrame, bars: DataFrame, stop_pct: float | Column, slippage: float, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Replace a candidate's exit by an earlier fixed stop; a stop of 0 % is none.

    The first bar that reaches the stop is found by blocks of bars: a candidate reads a few rows, however far its stop is.
    """
    keys = list(keys)
    d, long = F.col("direction"), F.col("direction") == LONG
    pct = stop_pct if isinstance(stop_pct, Column) else F.lit(float(stop_pct))
    c = materialise(cands.withColumn("_stop", F.when(pct > 0, S.entry_fill(F.col("entry_open"), d, slippage) * (1 - d * pct / 100))), "stop-candidates")
    ident = ["combo_id", "entry_ix"]
    asked = c.where("_stop IS NOT NULL").select(
        *keys, *ident, "direction", F.col("_stop").alias("level"), F.col("entry_ix").alias("first"), F.coalesce(F.col("exit.bar_ix"), F.col("mark_ix")).alias("last"))
    hits = first_reach(asked, bar_blocks(bars, keys), keys, [*ident, "direction"])
    b = F.col("hit")
    gap = (b["bar_ix"] > F.col("entry_ix")) & F.when(long, b["open"] <= F.col("_stop")).otherwise(b["open"] >= F.col("_stop"))
    stopped = F.when(gap, _exit_struct(Exit(gap, b["open"], "gap_sl"), b["bar_ix"], b["date"], 1)).otherwise(
        _exit_struct(Exit(gap, F.col("_stop"), "intraday_sl", True), b["bar_ix"], b["date"], 2))
    out = c.join(hits, [*keys, *ident, "direction"], "left").withColumn("exit", F.when(b.isNotNull(), stopped).otherwise(F.col("exit")))
    return out.select(*cands.columns)


WALK_SPAN = 512


def trend_exits(
    cands: DataFrame, frame: DataFrame, combos: Sequence[dict], slippage: float,
    keys: Sequence[str] = ("symbol",), legacy: bool = False, end: Column | None = None,
) -> DataFrame:
    """Exits that follow the price: fixed stop, ATR trailing stop, opposite channel, reverse cross.

    The state of a candidate (high-water mark and level) is carried from span to span. Each
    pass joins the open candidates with one array of at most ``WALK_SPAN`` bars and folds
    it; passes go on until every candidate has an exit or has run out of bars.
    """
    keys = list(keys)
    bars = home_rows(frame)
    if end is not None:
        bars = bars.filter(end)
    atrs = sorted({int(p["atr_period"]) for p in combos})
    chans = sorted({int(p["donchian_exit_period"]) for p in combos if _mode(p) == "channel"})
    fields = [F.col(x) for x in ("bar_ix", "date", "open", "high", "low", "close")] + [F.col(f"atr_{q}_lag1").alias(f"atr_{q}") for q in atrs]
    fields += [x for q in chans for x in (lag(f"low_{q}").alias(f"lo_{q}"), lag(f"high_{q}").alias(f"hi_{q}"))]
    pairs = {(p["ema_fast"], p["ema_slow"]): p for p in combos if _mode(p) == "signal"}
    crosses = list(pairs)
    for k, pair in enumerate(crosses):
        fields += [F.coalesce(ema_cross(pairs[pair], side), F.lit(False)).alias(f"{name}_{k}") for name, side in (("bear", SHORT), ("bull", LONG))]
    arrays = (
        bars.withColumn("_sp", F.floor(F.col("bar_ix") / F.lit(WALK_SPAN)))
        .groupBy(*keys, "_sp").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("_bars"))
    )
    arrays = materialise(arrays, "bar-arrays")
    settings = lambda pick: F.create_map(*[F.lit(x) for i, p in enumerate(combos) for x in (i, pick(p))])[F.col("combo_id")]
    d = F.col("direction")
    price = S.entry_fill(F.col("entry_open"), d, slippage)
    mode = settings(_mode)
    trailing = mode == "trailing" if legacy else mode.isin("trailing", "channel")
    mult = settings(lambda p: float(p["trailing_atr_mult"]))
    period = settings(lambda p: int(p["atr_period"]))
    atr0 = F.coalesce(*[F.when(period == q, F.col(f"atr_{q}_lag1")) for q in atrs], F.lit(0.0))
    stop_pct = settings(lambda p: float(p["sl_percent"]))
    start = cands.drop("exit").withColumns({
        "_mode": mode, "_mult": mult, "_chan": settings(lambda p: int(p["donchian_exit_period"])),
        "_atr": period, "_cross": settings(lambda p: crosses.index((p["ema_fast"], p["ema_slow"])) if _mode(p) == "signal" else -1),
        "_trail": trailing,
        "_stop": F.when(stop_pct > 0, d * price * (1 - d * stop_pct / 100)),
        "_state": F.struct(
            (d * price).alias("hwm"),
            F.when(trailing & (atr0 > 0), d * price - atr0 * mult).alias("level"),
            F.lit(None).cast(EXIT).alias("exit"),
        ),
        "_sp": F.floor(F.col("entry_ix") / F.lit(WALK_SPAN)),
    })
    keep = [c for c in cands.columns if c != "exit"]
    step = _trail_step(chans, atrs, len(crosses), slippage, legacy)
    work, done = start, []
    while True:
        met = work.join(arrays, [*keys, "_sp"], "left")
        folded = F.aggregate(F.coalesce("_bars", F.array()), F.col("_state"), step)
        met = met.withColumn("_state", folded).withColumn("_ended", F.col("_bars").isNull()).drop("_bars")
        met = materialise(met, "trail-pass")
        over = F.col("_state.exit").isNotNull() | F.col("_ended")
        done.append(met.filter(over).select(*keep, F.col("_state.exit").alias("exit")))
        work = met.filter(~over).withColumn("_sp", F.col("_sp") + 1).drop("_ended")
        if work.isEmpty():
            break
    return reduce(DataFrame.unionByName, done)


def _mode(p: dict) -> str:
    return "trailing" if p["exit_mode"] == "channel" and p["entry_mode"] != "donchian" else p["exit_mode"]


def _trail_step(chans: list[int], atrs: list[int], crosses: int, slippage: float, legacy: bool):
    """One bar of the trend exits on prices mirrored for short trades."""

    def step(acc, b):
        d, e = F.col("direction"), F.col("entry_ix")
        up = d == LONG
        op, cl = d * b["open"], d * b["close"]
        hi, lo = F.when(up, b["high"]).otherwise(-b["low"]), F.when(up, b["low"]).otherwise(-b["high"])
        later, stop = b["bar_ix"] > e, F.col("_stop")

        def live(level):
            return level.isNotNull() & (~up | (level > 0))

        level = acc["level"]
        atr = F.coalesce(*[F.when(F.col("_atr") == q, b[f"atr_{q}"]) for q in atrs], F.lit(0.0))
        fresh = F.col("_trail") & (atr > 0) & later & (hi > acc["hwm"])
        hwm = F.when(fresh, hi).otherwise(acc["hwm"])
        moved = F.when(fresh, hi - atr * F.col("_mult")).otherwise(level)

        def out(price, reason, slip):
            return _exit_struct(Exit(F.lit(True), price, reason, slip), b["bar_ix"], b["date"])

        gap_sl = (stop.isNotNull() & (op <= stop) & (F.lit(True) if legacy else later), out(b["open"], "gap_sl", False))
        hard = (stop.isNotNull() & (lo <= stop), out(d * stop, "intraday_sl", True))
        gap_tr = (live(level) & (op <= level), out(b["open"], "gap_trailing", False))
        soft = (later & live(moved) & (lo <= moved), out(d * moved, "trailing", True))
        order = [gap_sl, gap_tr, hard, soft] if legacy else [gap_sl, hard, gap_tr, soft]
        for q in chans:
            far = F.when(up, b[f"lo_{q}"]).otherwise(-b[f"hi_{q}"])
            hit = (F.col("_mode") == "channel") & (F.col("_chan") == q) & later & (cl < far)
            order.append((hit, out(b["close"], "channel", False)))
        for k in range(crosses):
            back = F.when(up, b[f"bear_{k}"]).otherwise(b[f"bull_{k}"])
            order.append(((F.col("_cross") == k) & back, out(b["open"], "signal_reverse", True)))
        exit_ = F.lit(None).cast(EXIT)
        for cond, val in reversed(order):
            exit_ = F.when(cond, val).otherwise(exit_)
        skip = acc["exit"].isNotNull() | (b["bar_ix"] < e)
        nxt = F.struct(hwm.alias("hwm"), moved.alias("level"), exit_.alias("exit"))
        return F.when(skip, acc).otherwise(nxt)

    return step


def ledger(
    bars: DataFrame, rule: RuleSpec, combos: Sequence[dict] | None = None, account: Account = Account(),
    keys: Sequence[str] = ("symbol",), start: Column | None = None, end: Column | None = None,
    sides: Sequence[int] = (LONG,), frame: DataFrame | None = None, accounts: Sequence[Account] | None = None,
    legacy: bool = False, only: Column | None = None, wanted: DataFrame | None = None,
) -> DataFrame:
    """Bars to settled trades; picks the closed form wherever it is exact.

    ``only`` limits the (key, combination) pairs that are run; ``wanted`` lists them as a table of (keys, combo_id).
    """
    combos = [rule.params()] if combos is None else list(combos)
    frame = frame_for(bars, rule, combos, keys) if frame is None else frame
    found = candidates(frame, rule, combos, keys, start, end, sides, wanted)
    if only is not None:
        found = found.filter(only)
    stops = [float(p.get("sl_percent", 0.0)) for p in combos]
    plain = rule.exits is not None and len(sides) == 1 and not any(stops) and not any(p.get("cooldown_candles") for p in combos)
    if plain and account.closed_form and accounts is None:
        return settle(with_mark(pair(found, keys), bars, keys, end), account, _fraction(account, combos), keys)
    cands = with_mark(found, bars, keys, end)
    if rule.key == "donchian":
        cands = trend_exits(cands, frame, combos, account.slippage, keys, legacy, end)
    elif any(stops):
        cands = stop_exits(cands, bars if end is None else bars.filter(end), _by_combo(stops), account.slippage, keys)
    if account.closed_form and accounts is None:
        wanted = cands.select(*keys, "combo_id", "direction", "entry_ix", "entry_date", "entry_open", "exit", "mark_ix", "mark_price")
        taken = without_overlap(wanted, [*keys, "combo_id"], _by_combo([int(p.get("cooldown_candles", 0)) for p in combos]))
        return settle(taken, account, _fraction(account, combos), keys)
    out = ordered_walk(cands, combos, accounts or [account], keys)
    return out if accounts else out.drop("scenario")


def _by_combo(values: Sequence) -> Column:
    """A setting per combination; one literal if all are equal."""
    if len(set(values)) == 1:
        return F.lit(values[0])
    return F.array(*[F.lit(v) for v in values])[F.col("combo_id")]


def _fraction(account: Account, combos: Sequence[dict]) -> Column:
    return _by_combo([float(account.fraction or p.get("position_fraction", 1.0)) for p in combos])


def variant(account: Account, **changes) -> Account:
    return replace(account, **changes)
