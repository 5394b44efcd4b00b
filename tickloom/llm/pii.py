"""Personal data by candidate gradient boosting, in DataFrame operations only.

Generators propose overlapping spans: every raw match of the four base formats, telephone numbers without a
plus sign, spelled-out addresses and other long digit runs. The base spans (formats that pass their check)
are always kept. The rest is decided by boosted trees over format and context features of the span. Their
labels are the checks themselves (Luhn, octets, digit counts), which the features do not see. All
features are small integers, so the training set is a table of counts by feature vector (made by one
aggregation over all candidates of all documents; its size is bounded by the product of the features'
ranges), and the trees are fitted to those counts and returned as SQL expressions. The threshold is the
lowest score at which the selected candidates of the calibration fifth reach ``precision``.

Positions are code points. Null and empty texts have no spans. Rows are handled one by one: repeated rows
give repeated results, an empty table gives none. Texts are searched whole, however long; columns beyond ``doc_id`` and ``text``
are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import crc_text, store

KINDS = ["email", "ip", "card", "phone"]
#: Equal to the plain formats; possessive, so that long digit runs need neither backtracking nor stack.
LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Any run that can hold an ip, card or phone number, taken whole and once (possessive); seven characters are the least (1.1.1.1).
RUN = r"[0-9+\x20().-]{7,}+"
BARE_PHONE = r"\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}"
SPELLED = r"(?i)[a-z0-9._%+-]{1,64}(?:\x20|\x20?[(\[])at(?:\x20|[)\]]\x20?)[a-z0-9-]{1,63}(?:\x20|\x20?[(\[])dot(?:\x20|[)\]]\x20?)[a-z]{2,24}"
#: Cue words before a span: fixed values.
CUES = {1: "phone|tel|call|fax|mobile|mail|contact|reach", 2: "card|visa|master|amex|credit|pay", 3: "ip|server|host|address|login", 4: "isbn|order|invoice|ref|id|no|version|date|page"}
FEATURES = ["digits", "letters", "seps", "plus", "at", "even", "before", "after", "cue"]
SPAN = "array<struct<start:int,end:int,s:string>>"


def spans(text: Column, pattern: str, offset: Column) -> Column:
    """Leftmost non-overlapping matches as (start, end, s): lengths of gaps and matches, added up."""
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    none = F.struct(offset.cast("int").alias("pos"), F.array().cast(SPAN).alias("out"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["g"])
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        one = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("s"))
        return F.struct(end.alias("pos"), F.when(x["m"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(one))).alias("out"))

    return F.aggregate(pairs, none, add, lambda acc: acc["out"])


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    twice = lambda v: F.when(v > 4, 2 * v - 9).otherwise(2 * v)
    each = F.transform(F.split(F.reverse(d), ""), lambda c, i: F.when(i % 2 == 1, twice(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, v: a + F.coalesce(v, F.lit(0))) % 10 == 0


def passes(kind: str, s: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        # without leading zeros, at most 255
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(s, r"\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))
    n = F.length(_digits(s))
    if kind == "card":
        return F.when((n >= 12) & (n <= 19), _luhn(_digits(s))).otherwise(F.lit(False))
    return (n >= 9) & (n <= 15)


def _kind(found: Column, kind: str, label, base: bool) -> Column:
    """Spans with their kind and label (1 or 0, -1: unknown); ``base``: those labelled 1 are kept in any case."""

    def one(x: Column) -> Column:
        y = label(x).cast("int")
        return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["s"].alias("s"), y.alias("label"), ((y == 1) & base).alias("base"))

    return F.transform(found, one)


def _features(c: Column, text: Column) -> list[Column]:
    """The features of a candidate, as small integers."""
    s, n = c["s"], F.length(_digits(c["s"]))
    bound = lambda v, steps: sum(((v >= k).cast("int") for k in steps), F.lit(0))
    has = lambda ch: F.contains(s, F.lit(ch)).cast("int")
    side = lambda ch: F.when(ch == "", 0).when(ch.rlike(r"\s"), 1).when(ch.rlike("[0-9]"), 2).when(ch.rlike(r"\p{L}"), 3).otherwise(4)
    begin = F.greatest(F.lit(0), c["start"] - 24)
    ahead = F.lower(F.substr(text, begin + 1, c["start"] - begin))
    cue = F.coalesce(*[F.when(ahead.rlike(rf"\b(?:{p})\w*\W*$"), F.lit(k)) for k, p in CUES.items()], F.lit(0))
    even = s.rlike(r"^[0-9]{4}(?:([\x20-])[0-9]{4})(?:\1[0-9]{4}){2}$|^[0-9]{16}$").cast("int")
    before = F.when(c["start"] == 0, F.lit("")).otherwise(F.substr(text, c["start"], F.lit(1)))
    after = F.substr(text, c["end"] + 1, F.lit(1))
    return [
        bound(n, (1, 7, 9, 10, 12, 15, 16, 17, 20)).alias("digits"), bound(F.length(F.regexp_replace(s, "[^A-Za-z]", "")), (1, 4, 16)).alias("letters"),
        (has(" ") + 2 * has("-") + 4 * has(".") + 8 * has("(")).alias("seps"), F.startswith(s, F.lit("+")).cast("int").alias("plus"), has("@").alias("at"),
        even.alias("even"), side(before).alias("before"), side(after).alias("after"), cue.alias("cue"),
    ]


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, fold (a fifth calibrates) and every candidate with label and features; one pass over the texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast(SPAN)
    rows = docs.select("doc_id", (crc_text(F.col("doc_id")) % 5).cast("int").alias("fold"), text.alias("text"))
    zero = F.lit(0)
    rows = rows.withColumn("mail", F.when(F.contains("text", F.lit("@")), spans(F.col("text"), EMAIL, zero)).otherwise(none))
    rows = rows.withColumn("runs", F.when(F.col("text").rlike(RUN), spans(F.col("text"), RUN, zero)).otherwise(none))
    spelled = F.when(F.col("text").rlike(SPELLED), spans(F.col("text"), SPELLED, zero)).otherwise(none)
    inside = lambda p: F.flatten(F.transform("runs", lambda r: spans(r["s"], p, r["start"])))
    raw = {"email": F.col("mail"), "ip": inside(IP), "card": inside(CARD), "phone": inside(PHONE)}
    rows = rows.select("*", *[_kind(col, k, lambda x, k=k: passes(k, x["s"]), True).alias(k) for k, col in raw.items()])
    # a card-like run too short for a card says nothing either way
    number = lambda c: F.struct(*[(F.when(c["base"] | (F.length(_digits(c["s"])) >= 12), c["label"]).otherwise(-1) if f == "label" else c[f]).alias(f) for f in ("kind", "start", "end", "s", "label", "base")])
    rows = rows.withColumn("card", F.transform(F.filter("card", lambda x: F.length(x["s"]) >= 7), number))
    within = lambda x, of, ok: F.exists(of, lambda c: (c["start"] <= x["start"]) & (x["end"] <= c["end"]) & ok(c))
    # the national part of a telephone number is an example of its format, a part of another number a counterexample
    part = lambda x: F.when(within(x, "phone", lambda c: c["base"]), 1).when(within(x, "phone", lambda c: ~c["base"]) | within(x, "card", lambda c: c["label"] >= 0) | within(x, "ip", lambda c: c["label"] >= 0), 0).otherwise(-1)
    rows = rows.withColumn("bare", _kind(inside(BARE_PHONE), "phone", part, False)).withColumn("spelled", _kind(spelled, "email", lambda x: F.lit(-1), False))
    rows = rows.withColumn("found", F.concat("email", "ip", "card", "phone", "bare", "spelled"))
    full = F.transform("found", lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["label"].alias("label"), c["base"].alias("base"), *_features(c, F.col("text"))))
    return rows.select("doc_id", "fold", full.alias("found"))


def fit(counts: list[dict], rounds: int = 30, rate: float = 0.4, least: float = 4.0) -> list[tuple]:
    """Boosted depth-2 trees on rows of (features, pos, neg); a split asks ``feature <= v`` or ``feature = v``."""
    score = [0.0] * len(counts)
    trees = []
    values = {f: sorted({r[f] for r in counts}) for f in FEATURES}
    tests = [(f, op, v) for f in FEATURES for v in values[f] for op in ("<=", "=") if len(values[f]) > 1]
    holds = {t: [r[t[0]] <= t[2] if t[1] == "<=" else r[t[0]] == t[2] for r in counts] for t in tests}

    def best(rows: list[int], g: list[float], h: list[float]) -> tuple | None:
        gs, hs = sum(g[i] for i in rows), sum(h[i] for i in rows)
        top = None
        for t in tests:
            yes = holds[t]
            a, b = sum(g[i] for i in rows if yes[i]), sum(h[i] for i in rows if yes[i])
            if b < 1e-9 or hs - b < 1e-9:
                continue
            gain = a * a / (b + least) + (gs - a) ** 2 / (hs - b + least) - gs * gs / (hs + least)
            if gain > 1e-6 and (top is None or gain > top[0]):
                top = (gain, t)
        return top and top[1]

    leaf = lambda rows, g, h: rate * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + least)
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-s)) for s in score]
        g = [r["pos"] - (r["pos"] + r["neg"]) * q for r, q in zip(counts, p)]
        h = [(r["pos"] + r["neg"]) * q * (1 - q) for r, q in zip(counts, p)]
        every = list(range(len(counts)))
        root = best(every, g, h)
        parts = [every] if root is None else [[i for i in every if holds[root][i]], [i for i in every if not holds[root][i]]]
        tree = []
        for rows in parts:
            split = best(rows, g, h) if root else None
            ends = [rows] if split is None else [[i for i in rows if holds[split][i]], [i for i in rows if not holds[split][i]]]
            vals = [leaf(e, g, h) for e in ends]
            for e, v in zip(ends, vals):
                for i in e:
                    score[i] += v
            tree.append((split, vals))
        trees.append((root, tree))
    return trees


def tree_score(trees: list[tuple], get) -> Column:
    """The sum of the trees as an expression; ``get`` gives a feature's column."""

    def ask(t):
        return get(t[0]) <= t[2] if t[1] == "<=" else get(t[0]) == t[2]

    def branch(split, vals):
        return F.lit(vals[0]) if split is None else F.when(ask(split), F.lit(vals[0])).otherwise(F.lit(vals[1]))

    parts = [branch(*tree[0]) if root is None else F.when(ask(root), branch(*tree[0])).otherwise(branch(*tree[1])) for root, tree in trees]
    return sum(parts, F.lit(0.0))


def score_of(trees: list[tuple], row: dict) -> float:
    ask = lambda t: row[t[0]] <= t[2] if t[1] == "<=" else row[t[0]] == t[2]
    total = 0.0
    for root, tree in trees:
        split, vals = tree[0] if root is None or ask(root) else tree[1]
        total += vals[0] if split is None or ask(split) else vals[1]
    return total


def calibrate(trees: list[tuple], counts: list[dict], precision: float) -> float:
    """The lowest score at which what is selected has the precision; infinite if there is none."""
    ranked = sorted(((score_of(trees, r), r["pos"], r["neg"]) for r in counts), reverse=True)
    pos = neg = 0
    limit = math.inf
    for k, (s, p, n) in enumerate(ranked):
        pos, neg = pos + p, neg + n
        last = k + 1 == len(ranked) or ranked[k + 1][0] < s
        if last and pos > 0 and pos >= precision * (pos + neg):
            limit = s
    return limit


def detect(docs: DataFrame, precision: float = 0.95) -> DataFrame:
    """doc_id, base and all spans (arrays of start, order, kind, end, in order) of every row."""
    rows = store(candidates(docs), "pii-candidates")
    each = rows.select((F.col("fold") == 0).alias("calibrate"), F.explode("found").alias("c")).where("c.label >= 0")
    each = each.groupBy("calibrate", *[f"c.{f}" for f in FEATURES]).agg(F.sum("c.label").alias("pos"), F.sum(1 - F.col("c.label")).alias("neg"))
    counts = sorted((r.asDict() for r in each.collect()), key=lambda r: [r["calibrate"], *(r[f] for f in FEATURES)])
    trees = fit([r for r in counts if not r["calibrate"]])
    limit = calibrate(trees, [r for r in counts if r["calibrate"]], precision)
    order = lambda k: F.array_position(F.array(*map(F.lit, KINDS)), k).cast("int")
    plain = lambda c: F.struct(c["start"].alias("start"), order(c["kind"]).alias("order"), c["kind"].alias("kind"), c["end"].alias("end"))
    rows = rows.withColumn("base", F.filter("found", lambda c: c["base"]))
    apart = lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    if math.isfinite(limit):
        scored = F.transform(F.filter("found", lambda c: ~c["base"] & apart(c)), lambda c: F.struct(tree_score(trees, lambda f: c[f]).alias("score"), (-c["start"]).alias("early"), c["end"].alias("end"), c["kind"].alias("kind"), c["start"].alias("start")))
        rows = rows.withColumn("scored", F.array_distinct(F.filter(scored, lambda c: c["score"] >= limit - 1e-9)))
        better = lambda c: F.exists("scored", lambda d: (d["start"] < c["end"]) & (c["start"] < d["end"]) & (d > c))
        rows = rows.withColumn("more", F.transform(F.filter("scored", lambda c: ~better(c)), plain))
    else:
        rows = rows.withColumn("more", F.array().cast("array<struct<start:int,order:int,kind:string,end:int>>"))
    rows = rows.withColumn("base", F.array_sort(F.transform("base", plain)))
    return rows.select("doc_id", "base", F.array_sort(F.concat("base", "more")).alias("spans"))


def redact(docs: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents with every span replaced by its kind in brackets; ``key`` must be unique in both."""
    both = docs.join(found.select(F.col(key).alias("_key"), "spans"), F.col(key).eqNullSafe(F.col("_key")), "left")
    none = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def cut(acc: Column, x: Column) -> Column:
        begin = F.greatest(acc["pos"], x["start"])
        out = F.when(x["end"] <= acc["pos"], acc["out"]).otherwise(F.concat(acc["out"], F.substr("text", acc["pos"] + 1, begin - acc["pos"]), F.lit("["), x["kind"], F.lit("]")))
        return F.struct(F.greatest(acc["pos"], x["end"]).alias("pos"), out.alias("out"))

    text = F.aggregate("spans", none, cut, lambda acc: F.concat(acc["out"], F.substr("text", acc["pos"] + 1, F.length("text"))))
    return both.withColumn("text", F.when(F.size("spans") > 0, text).otherwise(F.col("text"))).select(docs.columns)


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
