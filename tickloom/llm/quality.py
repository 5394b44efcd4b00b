"""Quality rules with thresholds from quantile sketches per language and source.

The sketch is a histogram over logarithmic buckets (relative error 1 %): sketches merge by adding counts, in
any order and with the same result, so they are built by map-side aggregation and no group is gathered.
The sketch a (language, source) pair is judged by is its own plus the language's, scaled down to
``prior_rows`` rows; that steadies small pairs and does not matter for large ones. A limit is the median
plus ``reach`` times the distance to the tenth percentile (at least ``least`` of the rule), so it follows
what is usual for the pair and is not moved by less than half of the rows being junk. The limits are then
joined to the rows.

Null and empty texts have no words and fail the base rule. Null languages and sources are groups of their own. Texts of any length
are measured whole. Repeated rows are judged one by one and count in the sketches each; equal values share a bucket, so ties
need no order. Columns beyond ``doc_id``, ``text``, ``lang`` and ``source`` are not read. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import BLANKS, store

SYMBOLS = "#*$%&|<>"
GAMMA = 1.02
ROWS = 512  # texts read at a time


@dataclass(frozen=True)
class Rule:
    """A value per row, which side is bad, and the least distance of a limit from the median."""

    name: str
    value: str
    low: bool
    high: bool
    least: float


#: Rows without words are left to the base rule.
RULES = [
    Rule("mean_word", "word_chars / n_words", True, True, 0.45),
    Rule("symbols", "n_symbols / n_words", False, True, 0.01),
    Rule("repeats", "n_repeat_words / n_words", False, True, 0.03),
    Rule("dup_lines", "n_dup_lines / n_lines", False, True, 0.06),
    Rule("capitals", "n_capital_words / n_words", False, True, 0.02),
    Rule("marks", "n_marks / n_words", False, True, 0.02),
]


def measures(text: str) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capital_words, n_marks.

    Bytes split at the ASCII blanks only.
    """
    raw = text.encode()
    ws = raw.split()
    n = len(ws)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = 0
    if n >= 5:
        windows = list(zip(ws, ws[1:], ws[2:], ws[3:], ws[4:]))
        if len(set(windows)) < len(windows):
            seen, covered = Counter(windows), 0
            for i, w in enumerate(windows):
                if seen[w] > 1:
                    repeated += i + 5 - max(covered, i)
                    covered = i + 5
    capitals = sum(map(bytes.isupper, ws))
    return n, len(text) - sum(map(text.count, " " + BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines), capitals, text.count("!") + text.count("?")


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capital_words", "n_marks"]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every row's whole text."""

    kind = pa.struct([(c, pa.int64()) for c in COUNTS])

    @F.arrow_udf("struct<" + ",".join(f"{c}:long" for c in COUNTS) + ">")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            rows = zip(*[measures(t or "") for lo in range(0, len(b), ROWS) for t in b.slice(lo, ROWS).to_pylist()])
            yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in rows], fields=list(kind)) if len(b) else pa.array([], kind)

    return docs.select("doc_id", "lang", "source", count("text").alias("c")).select("doc_id", "lang", "source", "c.*")


def bucket(x: Column) -> Column:
    """The sketch's bucket of a value from 0 on; bucket -500 is zero (below 5e-5)."""
    return F.when(x < 5e-5, F.lit(-500)).otherwise(F.ceil(F.log(x) / F.lit(math.log(GAMMA)))).cast("int")


def thresholds(counted: DataFrame, reach: float = 6.0, prior_rows: float = 50.0) -> DataFrame:
    """(lang, source, limits map of rule to (low, high)) from the merged sketches."""
    each = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), bucket(F.expr(r.value)).alias("b")) for r in RULES]))
    own = counted.where("n_words > 0").select("lang", "source", each.alias("x")).groupBy("lang", "source", "x.rule", "x.b").agg(F.count("*").cast("double").alias("n"))
    own = store(own, "sketches")
    whole = own.groupBy("lang", "rule", "b").agg(F.sum("n").alias("n"))
    of_lang = Window.partitionBy("lang", "rule")
    whole = whole.select("lang", "rule", "b", (F.lit(prior_rows) * F.col("n") / F.sum("n").over(of_lang)).alias("n"))
    pairs = own.select(F.col("lang").alias("l"), "source").distinct()
    prior = whole.join(pairs, whole.lang.eqNullSafe(pairs.l)).select("lang", "source", "rule", "b", "n")
    merged = own.unionByName(prior).groupBy("lang", "source", "rule", "b").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("lang", "source", "rule")
    cum = merged.withColumn("c", F.sum("n").over(w.orderBy("b"))).withColumn("t", F.sum("n").over(w))
    value = F.when(F.col("b") <= -500, F.lit(0.0)).otherwise(F.pow(F.lit(GAMMA), F.col("b")) * F.lit(2 / (1 + GAMMA)))
    at = lambda q: F.min(F.when(F.col("c") >= F.col("t") * q, value))
    quant = cum.groupBy("lang", "source", "rule").agg(at(0.1).alias("q10"), at(0.5).alias("q50"), at(0.9).alias("q90"))
    pick = lambda f: F.coalesce(*[F.when(F.col("rule") == r.name, F.lit(f(r))) for r in RULES])
    below = F.greatest(F.col("q50") - F.col("q10"), pick(lambda r: r.least)) * reach
    limit = F.struct(F.when(pick(lambda r: r.low), F.col("q50") - below).otherwise(float("-inf")).alias("low"), F.when(pick(lambda r: r.high), F.col("q50") + below).otherwise(float("inf")).alias("high"))
    return quant.groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("rule", limit))).alias("limits"))


def judge(docs: DataFrame, reach: float = 6.0, prior_rows: float = 50.0) -> DataFrame:
    """Counts, base_failed, the rules each row broke and the verdict ``kept``."""
    counted = store(measured(docs), "measures")
    lim = thresholds(counted, reach, prior_rows)
    lim = lim.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), "limits")
    both = counted.join(lim, counted.lang.eqNullSafe(F.col("_l")) & counted.source.eqNullSafe(F.col("_s")), "left")
    outside = lambda r: (F.expr(r.value) > F.col("limits")[r.name]["high"]) | (F.expr(r.value) < F.col("limits")[r.name]["low"])
    broken = F.array_compact(F.array(*[F.when((F.col("n_words") > 0) & outside(r), F.lit(r.name)) for r in RULES]))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return both.select("doc_id", "lang", "source", *COUNTS, failed.alias("base_failed"), broken.alias("broken_rules")).withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0))
