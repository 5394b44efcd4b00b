"""Toxicity by a counterfactually regularised classifier.

A text's features are its distinct lower-case words, their first four to seven letters (so that inflected and
new forms of a learned stem count), and whether two or three distinct words share such a beginning. Features are chosen by how unevenly they fall on
the two classes; a logistic regression is fitted to them. In each labelled text the terms that name a group of
people are swapped for another group's; the penalty is the squared change of the score, so that the
model gives such terms no weight of their own and neutral mentions stay below the threshold.

The fit uses every labelled row outside the fold that is kept out. Its texts become packed feature numbers, stored once; each step adds up their
slopes in tasks, or on the driver while the numbers are few (``here``), and the driver moves the weights, of which there are at most ``features``. Scoring
covers every row and its whole text, row by row. With labels of one class only, every score is next to that
class; without labels it is next to 0. Null and empty texts have no features and get the intercept's score. Rows of documents with equal
ids are scored one by one; repeated labels of an id count once (the largest). An empty table gives no rows. Columns beyond ``doc_id``,
``text`` and the kept ones are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Container, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batched, crc_text, release, store, stored

#: Terms that name groups of people, by kind: fixed values. A term is swapped for another of its kind.
IDENTITY = {
    "gender": "woman women female man men male transgender trans nonbinary mujer mujeres hombre hombres femme femmes homme hommes frau frauen mann männer".split(),
    "religion": "muslim muslims islamic jewish jew jews christian christians catholic hindu hindus buddhist sikh atheist musulmán judío cristiano musulman juif chrétien moslem jude christ".split(),
    "origin": "black white asian african american mexican arab latino hispanic indian chinese european immigrant immigrants refugee refugees negro blanco noir blanc schwarz weiß".split(),
    "orientation": "gay gays lesbian lesbians straight heterosexual homosexual homosexuals bisexual queer lgbt".split(),
    "ability": "disabled deaf blind autistic paralyzed elderly old young teenage".split(),
}
SWAP = {t: (g, i) for g, ts in IDENTITY.items() for i, t in enumerate(ts)}
ROWS = 512  # texts decoded at a time: bounds what a task holds
TEXT_ROWS, PACKED_ROWS, COUNTED = 1024, 16, 200_000  # texts, packed rows a Python function gets at a time, features it counts before it sends them on
IN_TASK = 5_000_000  # numbers that a task of a step adds up: fewer would cost less than the task's start
TERM = re.compile(r"\w[\w'’-]*")


def swapped(text: str) -> str:
    """The text with every identity term replaced by the next of its kind (half around, so classes mix)."""

    def other(m: re.Match) -> str:
        at = SWAP.get(m[0].lower())
        return m[0] if at is None else IDENTITY[at[0]][(at[1] + len(IDENTITY[at[0]]) // 2) % len(IDENTITY[at[0]])]

    return TERM.sub(other, text)


def counted(text: str | None, known: Container[str] | None = None) -> Counter:
    """By how many distinct words of the text each feature is held (only those of ``known``, where given)."""
    own = (lambda fs: fs) if known is None else (lambda fs: filter(known.__contains__, fs))
    ws = [w.strip(".,;:!?\"'()[]{}*_-#$%&|<>") for w in set((text or "").lower().split())]
    n = Counter(own(ws))
    n.pop("", None)
    for k in (4, 5, 6, 7):
        ws = [w for w in ws if len(w) >= k]
        n.update(own([w[:k] + "~" for w in ws]))
    return n


def bases(features: Iterable[str]) -> set[str]:
    """Features that words must hold for any of these to count."""
    return {g for f in features for g in (f, f[:-1] if f[-1:] in ("2", "3") else f)}


def text_features(n: Counter) -> set[str]:
    return {*n, *(f"{f}2" for f, k in n.items() if k >= 2), *(f"{f}3" for f, k in n.items() if k >= 3)}


@dataclass
class Model:
    intercept: float
    weights: dict[str, float] = field(default_factory=dict)

    def table(self) -> dict[str, tuple[float, float, float]]:
        """The weights of a feature that one, two, three words hold."""
        get = self.weights.get
        return {f: (get(f, 0.0), get(f + "2", 0.0), get(f + "3", 0.0)) for f in bases(self.weights)}

    def scores(self, texts, table: dict[str, tuple[float, float, float]] | None = None) -> list[float]:
        """``table`` saves making it in each of several calls."""
        table = self.table() if table is None else table
        out = []
        for t in texts:
            z, n = self.intercept, counted(t, table)
            for f in sorted(n):
                one, two, three = table[f]
                z += one + (n[f] >= 2) * two + (n[f] >= 3) * three
            out.append(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))
        return out


PACKED = pa.schema([("y", pa.binary()), ("size", pa.binary()), ("own", pa.binary()), ("moved", pa.binary()), ("at", pa.binary()), ("sign", pa.binary())])


def pack(y: list[int], own: list[list[int]], twins: list[tuple[list[int], list[int]]]) -> dict[str, list[bytes]]:
    """Texts as one row of arrays: classes, numbers of features, features; of texts with a twin the numbers of features lost or gained, these, 1 or -1."""
    lost, gained = [sorted({*a} - {*b}) for a, b in twins], [sorted({*b} - {*a}) for a, b in twins]
    moved = [[(f, 1) for f in x] + [(f, -1) for f in z] for x, z in zip(lost, gained)]
    parts = (y, [*map(len, own)], [f for x in own for f in x], [*map(len, moved)], [f for x in moved for f, _ in x], [d for x in moved for _, d in x])
    return {n: [np.array(x, dtype="<i4").tobytes()] for n, x in zip(PACKED.names, parts)}


def slopes(rows: Iterable[dict[str, bytes]], w: np.ndarray, b: float) -> np.ndarray:
    """Sums over packed texts: slopes of the loss by weight, by intercept, then half the slopes of the squared changes of the logit from texts to twins by weight."""
    k = len(w)
    out = np.zeros(2 * k + 1)
    for r in rows:
        y, size, own, moved, at, sign = (np.frombuffer(r[c], dtype="<i4") for c in PACKED.names)
        z, some = np.full(len(y), b), np.flatnonzero(size)
        z[some] += np.add.reduceat(w[own], (np.cumsum(size) - size)[some]) if len(some) else 0.0
        off = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        out[:k] += np.bincount(own, np.repeat(off, size), k)
        out[k] += off.sum()
        row = np.repeat(np.arange(len(moved)), moved)
        change = np.bincount(row, sign * w[at], len(moved))
        out[k + 1 :] += np.bincount(at, sign * change[row], k)
    return out


def fit(added: Callable[[np.ndarray, float], np.ndarray], n: int, pos: int, twins: int, features: list[str], penalty: float = 5.0, l2: float = 1e-4, steps: int = 200) -> Model:
    """Logistic loss + l2 |w|^2 / 2 + penalty * mean squared change of the logit from a text to its twin, by Adam; ``added`` gives the ``slopes`` of all texts."""
    k = len(features)
    w, b = np.zeros(k), float(np.log(pos / (n - pos)))
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, steps + 1):
        s = added(w, b)
        g = s[: k + 1] / n
        g[:-1] += l2 * w + 2 * penalty / max(1, twins) * s[k + 1 :]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model(float(b), {f: float(w[i]) for i, f in enumerate(features) if abs(w[i]) > 1e-3})


def spread(rows: DataFrame, w: np.ndarray, b: float) -> np.ndarray:
    """The ``slopes`` of packed texts added up by tasks: one vector each goes to the driver."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = slopes((r for x in batches for r in x.to_pylist()), w, b)
        yield pa.RecordBatch.from_pydict({"v": pa.array([total.tobytes()], pa.binary())})

    with batched(rows.sparkSession, PACKED_ROWS):
        got = rows.mapInArrow(part, "v binary").collect()
    return np.sum([np.frombuffer(r.v) for r in got], axis=0) if got else np.zeros(2 * len(w) + 1)


def train(docs: DataFrame, labels: DataFrame, fold: int = 5, features: int = 8192, here: int = 2_000_000, sent_rows: int = 1_000_000, **options) -> Model:
    """The model of all labelled rows outside fold 0 (by crc32 of the id).

    Features are counted and chosen by Spark; the driver gets at most ``features`` of them, no texts, and the numbers
    in the rows only if they are ``here`` at most, else sums of them by task. What is stored on the way is deleted.
    """
    mark = stored()
    try:
        return _trained(docs, labels, fold, features, here, sent_rows, options)
    finally:
        release(docs.sparkSession, mark)


def _trained(docs: DataFrame, labels: DataFrame, fold: int, features: int, here: int, sent_rows: int, options: dict) -> Model:
    outside = crc_text(F.col("doc_id")) % fold != 0
    known = labels.where(F.col("toxic").isNotNull() & outside).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("y"))
    ids = store(known, "toxic-ids")
    # 12 bytes a row: sent to the tasks while it is small
    few = F.broadcast(ids) if ids.count() <= sent_rows else ids
    rows = docs.select("doc_id", "text").where(outside).join(few, "doc_id")
    texts = store(rows.repartition("doc_id", "text").sortWithinPartitions("doc_id", "text"), "toxic-texts").select("text", "y")
    n, pos = texts.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < pos < n:
        return Model(30.0 if pos else -30.0)
    neg = n - pos

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        hit: Counter = Counter()

        def sums() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"f": pa.array(seen, pa.string()), "n": pa.array(seen.values(), pa.int64()), "hit": pa.array([hit[f] for f in seen], pa.int64())})

        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                for t, y in zip(*(c.to_pylist() for c in b.slice(lo, ROWS).columns)):
                    fs = text_features(counted(t))
                    seen.update(fs)
                    if y:
                        hit.update(fs)
                    if len(seen) > COUNTED:
                        yield sums()
                        seen.clear()
                        hit.clear()
        yield sums()

    per = texts.mapInArrow(count, "f string, n long, hit long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("hit").alias("hit")).where("n >= 3")
    share = F.col("n") / n
    z = F.abs(F.col("hit") / pos - (F.col("n") - F.col("hit")) / neg) / F.sqrt(share * (1 - share) * (1 / pos + 1 / neg) + 1e-12)
    best = store(per.where(z > 3).select("f", z.alias("z")).orderBy(F.desc("z"), "f").limit(features), "toxic-features", TEXT_ROWS).collect()
    chosen = [r.f for r in sorted(best, key=lambda r: (-r.z, r.f))]
    chosen += [t for t in sorted(SWAP) if t not in set(chosen)]
    sent = docs.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(chosen)})

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = sent.value
        known = bases(at)
        ids = lambda t: sorted(at[f] for f in text_features(counted(t, known)) if f in at)
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                text, y = (c.to_pylist() for c in b.slice(lo, ROWS).columns)
                own = [ids(t) for t in text]
                twins = [(x, ids(swapped(t))) for t, x in zip(text, own) if not SWAP.keys().isdisjoint(map(str.lower, TERM.findall(t or "")))]
                yield pa.RecordBatch.from_pydict({"numbers": [sum(map(len, own))], "twins": [len(twins)], **pack(y, own, twins)}, schema=pa.schema([("numbers", pa.int64()), ("twins", pa.int64()), *PACKED]))

    packed = store(texts.mapInArrow(number, "numbers long, twins long, " + ", ".join(f"{c} binary" for c in PACKED.names)), "toxic-numbers", TEXT_ROWS)
    numbers, twins = packed.agg(F.sum("numbers"), F.sum("twins")).first()
    packed = packed.select(*PACKED.names)
    if numbers > here:
        packed = packed.coalesce(-(-numbers // IN_TASK))
        return fit(lambda w, b: spread(packed, w, b), n, pos, twins, chosen, **options)
    held = [r.asDict() for r in packed.collect()]
    return fit(lambda w, b: slopes(held, w, b), n, pos, twins, chosen, **options)


def score(docs: DataFrame, model: Model, keep: list[str], column: str = "score") -> DataFrame:
    """The kept columns and the score of every row."""
    known = docs.sparkSession.sparkContext.broadcast((model.intercept, model.weights))  # at most ``features`` weights

    @F.arrow_udf("double")
    def probability(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Model(*known.value)
        table = own.table()
        for b in batches:
            yield pa.array([s for lo in range(0, len(b), ROWS) for s in own.scores(b.slice(lo, ROWS).to_pylist(), table)], pa.float64())

    return docs.select(*keep, probability("text").alias(column))
