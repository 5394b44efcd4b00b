"""Brown class-based bigram language model.

Every training word has a class of its own choice. The ``head_words`` most frequent words and, for all others, their last two
letters (the most frequent endings; one unit for the rest) are the units that exchange clustering moves between classes on the driver until
the likelihood of the class bigrams no longer grows. Then Spark counts the classes around every word that is no head, and
each moves to the class where the likelihood gains most by its occurrences, to first order and all at once, as distributed exchange does. Only
words that training never saw keep the class of their ending. A word's probability is that of its class after the class before, times its
share of its class; both are smoothed and sum to one, so a document's probability is its perplexity to the power of its tokens.

Word counts are those of all training texts and stay in Spark: at most ``known_words`` of the most frequent are
sent to the tasks with their classes, counts and classes of the others are joined by word. The matrix of unit pairs is counted over all training
texts by Spark and has at most units squared entries, whatever the corpus; the classes' bigrams are counted over all training texts again when
every word has its class.

Null and empty texts are one end token. Rows with equal ids are scored one by one. Without training rows every
count is 0. An empty table gives no rows. Texts are read whole, however long; columns beyond ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .common import crc_text, store

END = b""
ROWS = 512  # texts read at a time: bounds what a task holds
BATCH_ROWS = 2048  # rows a Python function gets at a time
SEEN = np.dtype([("k", "<u2"), ("n", "<u4")])  # a context and how often a word has it


def tokens(text: str | None) -> list[bytes]:
    """Lower-case words as bytes, which lower and split at ASCII letters and blanks only; without the end token."""
    return text.encode().lower().split() if text else []


def vocabulary(texts: DataFrame) -> DataFrame:
    """(word, c) over all texts, the end token included."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n: Counter = Counter()
            for t in b.text:
                n.update(tokens(t))
            n[END] += len(b)
            yield pd.DataFrame({"word": [w.decode() for w in n], "n": list(n.values())})

    return texts.select("text").mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


def exchange(pairs: np.ndarray, classes: int, sweeps: int = 8) -> np.ndarray:
    """The class of each unit; the last unit (end of text) keeps class 0 for itself."""
    units = len(pairs)
    if units == 1:
        return np.zeros(1, dtype=int)
    freq = pairs.sum(0)
    order = [u for u in np.argsort(-freq, kind="stable") if u != units - 1]
    of = np.zeros(units, dtype=int)
    for k, u in enumerate(order):
        of[u] = 1 + k % (classes - 1)
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    hot = np.zeros((units, classes))
    hot[np.arange(units), of] = 1
    n = hot.T @ pairs @ hot
    own = np.arange(classes)
    for _ in range(sweeps):
        moved = 0
        for u in order:
            k, s = of[u], pairs[u, u]
            right, left = np.bincount(of, pairs[u], classes), np.bincount(of, pairs[:, u], classes)
            right[k] -= s
            left[k] -= s
            n[k] -= right
            n[:, k] -= left
            n[k, k] -= s
            rows, cols = n.sum(1), n.sum(0)
            a = f(n + right[None, :]) - f(n)
            b = f(n + left[:, None]) - f(n)
            gain = a.sum(1) - a[own, own] + b.sum(0) - b[own, own] + f(n[own, own] + right + left + s) - f(n[own, own])
            # wherever u goes, the classes before it get left and those after it get right back
            rows, cols = rows + left, cols + right
            gain -= f(rows + right.sum() + s) - f(rows) + f(cols + left.sum() + s) - f(cols)
            gain[0] = -np.inf
            best = int(np.argmax(gain))
            if gain[best] <= gain[k] + 1e-9:
                best = k
            moved += best != k
            of[u] = best
            n[best] += right
            n[:, best] += left
            n[best, best] += s
        if not moved:
            break
    return of


class Units:
    """Words to units: what tasks need to read texts."""

    def __init__(self, known: list[str], heads: int, endings: list[str]):
        self.heads, self.endings = heads, {e: heads + k for k, e in enumerate(endings)}
        self.other, self.end = heads + len(endings), heads + len(endings) + 1
        self.count = self.end + 1
        self.at = {w.encode(): i for i, w in enumerate(known)} | {END: len(known)}
        self.unit_of = np.array([i if i < heads else self.of_ending(w) for i, w in enumerate(known)] + [self.end, 0], dtype=np.int64)

    def of_ending(self, word: str) -> int:
        return self.endings.get(word[-2:], self.other)

    def read(self, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """The texts one after another, each closed by the end token: tokens per text, number among the known
        words (-1: another), unit, places of the other words, the other words."""
        line: list[bytes] = []
        sizes = []
        for t in texts:
            line += tokens(t)
            line.append(END)
            sizes.append(len(line))
        at = np.fromiter(map(self.at.get, line, repeat(-1)), dtype=np.int64, count=len(line))
        unit = self.unit_of[at]
        cold = np.flatnonzero(at < 0)
        others = [line[i].decode() for i in cold.tolist()]
        unit[cold] = [self.of_ending(w) for w in others]
        return np.diff(sizes, prepend=0), at, unit, cold, others


def unit_pairs(texts: DataFrame, parts: tuple, units: int) -> np.ndarray:
    """Counts of neighbouring units over all texts; the end token also stands before the first word."""
    sent = texts.sparkSession.sparkContext.broadcast(parts)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        u = Units(*sent.value)
        for b in batches:
            counts = np.zeros(u.count * u.count, dtype=np.int64)
            for lo in range(0, len(b), ROWS):
                unit = u.read(b.text.iloc[lo : lo + ROWS])[2]
                counts += np.bincount(np.append(u.end, unit[:-1]) * u.count + unit, minlength=len(counts))
            pair = np.flatnonzero(counts)
            yield pd.DataFrame({"pair": pair, "n": counts[pair]})

    got = texts.select("text").mapInPandas(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(units * units)
    out[got.pair.to_numpy(dtype=np.int64)] = got.n.to_numpy(dtype=float)
    return out.reshape(units, units)


def contexts(texts: DataFrame, parts: tuple, of: np.ndarray, classes: int, held: int = 1 << 21) -> DataFrame:
    """(id among the known words or -1, word if it is none of them, seen) of words that are no heads, equal words next to each other in
    their partition: ``seen`` packs pairs (k, n), n times after class k, or before class k - ``classes``.

    A task adds up about ``held`` contexts at a time, so what is exchanged are a word's sums and not its occurrences.
    """
    sent = texts.sparkSession.sparkContext.broadcast((parts, of))
    span = 2 * classes

    def added(keys: list[np.ndarray], others: list[str], first: int) -> pa.RecordBatch:
        number, names = pd.factorize(np.array(others, dtype=object))
        word, k = np.divmod(np.concatenate(keys), span)
        other = word >= first
        word[other] = first + number[word[other] - first]
        key, n = np.unique(word * span + k, return_counts=True)
        word, k = np.divmod(key, span)
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        seen = np.empty(len(key), dtype=SEEN)
        seen["k"], seen["n"] = k, n
        ends = (np.append(starts, len(key)) * SEEN.itemsize).astype(np.int32)
        word = word[starts]
        other = word >= first
        name = np.full(len(word), "", dtype=object)
        name[other] = names[word[other] - first]
        seen = pa.Array.from_buffers(pa.binary(), len(word), [None, pa.py_buffer(ends), pa.py_buffer(seen.tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(np.where(other, -1, word), pa.int64()), pa.array(name, pa.string()), seen], ["id", "word", "seen"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, of = sent.value
        u = Units(*parts)
        first = len(u.at)
        keys: list[np.ndarray] = []
        names: list[str] = []
        for b in batches:
            for lo in range(0, len(b), ROWS):
                _, word, unit, cold, others = u.read(b.column(0).slice(lo, ROWS).to_pylist())
                word[cold] = first + len(names) + np.arange(len(cold))
                names += others
                tail = np.flatnonzero((unit >= u.heads) & (unit < u.end))  # never the last: an end token is
                line = word[tail] * span
                keys += [line + np.append(of[u.end], of[unit[:-1]])[tail], line + classes + of[unit[tail + 1]]]
                if sum(map(len, keys)) >= held:
                    yield added(keys, names, first)
                    keys, names = [], []
        if any(map(len, keys)):
            yield added(keys, names, first)

    found = texts.select("text").mapInArrow(count, "id long, word string, seen binary")
    return found.repartition("id", "word").sortWithinPartitions(F.xxhash64("id", "word"), "id", "word")


def chosen(seen: DataFrame, n: np.ndarray, used: np.ndarray) -> DataFrame:
    """(id, word, c, class): the class in which an occurrence of the word adds most to the likelihood of the class bigrams ``n``, summed over its occurrences."""
    classes = len(n)
    after, before = n.sum(1), n.sum(0)  # a class as the first and as the second of a bigram
    left = np.log(n + 0.5) - np.log(before + 0.5 * classes)[None, :]
    right = np.log(n.T + 0.5) - np.log(after + 0.5 * classes)[None, :]
    gain = np.round(np.vstack([left, right]) * (1 << 16))  # whole numbers: sums do not depend on their order
    open_ = used.copy()
    open_[0] = False  # the end's own
    places = np.flatnonzero(open_)
    gain = gain[:, places]

    def rows(ids: np.ndarray, words: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(ids, pa.int64()), words, pa.array(counts[:, :classes].sum(1), pa.int64()), pa.array(places[np.argmax(counts @ gain, axis=1)], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["id", "word", "c", "class"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # a batch's last word may go on in the next batch
        for b in batches:
            if not len(b):
                continue
            ids, words, seen = b.column(0).to_numpy(), b.column(1), b.column(2).to_pylist()
            start = np.append(True, (ids[1:] != ids[:-1]) | pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False))
            flat = np.frombuffer(b"".join(seen), dtype=SEEN)
            row = np.repeat(np.cumsum(start) - 1, np.fromiter(map(len, seen), dtype=np.int64, count=len(seen)) // SEEN.itemsize)
            at = np.flatnonzero(start)
            ids, words = ids[at], words.take(pa.array(at))
            counts = np.bincount(row * 2 * classes + flat["k"], flat["n"], len(at) * 2 * classes).reshape(len(at), -1)
            if last and last[0][0] == ids[0] and last[1][0] == words[0]:
                counts[0] += last[2][0]
            elif last:
                yield rows(*last)
            if len(at) > 1:
                yield rows(ids[:-1], words[:-1], counts[:-1])
            last = ids[-1:], words.slice(len(at) - 1), counts[-1:].copy()
        if last:
            yield rows(*last)

    return store(seen.mapInArrow(best, "id long, word string, c long, class long"), "word-classes", BATCH_ROWS)


def joined(path: pa.Array, found: pa.Array) -> pa.Array:
    """Class paths (a byte a token) with the classes found for words put in their places."""
    if not len(path):
        return path
    sizes = np.array([len(p) for p in path.to_pylist()], dtype=np.int64)
    flat = np.frombuffer(b"".join(path.to_pylist()), dtype=np.uint8).copy()
    ends = np.cumsum(sizes)
    many = found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    got = found.flatten()
    flat[np.repeat(ends - sizes, many) + got.field(0).to_numpy()] = got.field(1).to_numpy()
    whole = flat.tobytes()
    return pa.array([whole[i:k] for i, k in zip((ends - sizes).tolist(), ends.tolist())], pa.binary())


def class_pairs(paths: DataFrame, end: int, classes: int) -> np.ndarray:
    """Counts of neighbouring classes over all paths; the end's class also stands before the first word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes * classes, dtype=np.int64)
        for b in batches:
            cls = np.frombuffer(b"".join(b.column(0).to_pylist()), dtype=np.uint8).astype(np.int64)
            total += np.bincount(np.append(end, cls[:-1]) * classes + cls, minlength=len(total)) if len(cls) else 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"pair": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    got = paths.select("path").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(classes * classes)
    for r in got:
        out[r.pair] = r.n
    return out.reshape(classes, classes)


def score_documents(docs: DataFrame, folds: int = 10, classes: int = 48, head_words: int = 768, endings: int = 254, known_words: int = 131_072, mu: float = 20.0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    if not 2 <= classes <= 256:
        raise ValueError("2 to 256 classes: a path holds a byte a token")
    rows = docs.select("doc_id", "text", (crc_text(F.col("doc_id")) % folds == 0).alias("held_out"))
    train = rows.where(~F.col("held_out"))
    vocab = store(vocabulary(train), "vocabulary")
    total = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n_all, v_all = total
    # the least count at which no more than known_words words are as frequent: one row per distinct count is ordered
    at = vocab.where("word <> ''").groupBy("c").agg(F.count("*").alias("n")).withColumn("words", F.sum("n").over(Window.orderBy(F.desc("c"))))
    cut = at.where(F.col("words") <= known_words).agg(F.min("c")).first()[0]
    top = vocab.where((F.col("word") != "") & (F.col("c") >= cut)).collect() if cut else []
    top.sort(key=lambda r: (-r.c, r.word))
    known, counts = [r.word for r in top], np.array([r.c for r in top], dtype=float)
    heads = min(head_words, len(known))
    end_count = vocab.where("word = ''").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    head = docs.sparkSession.createDataFrame([(w,) for w in known[:heads]], "word string")
    tail = vocab.where("word <> ''").join(F.broadcast(head), "word", "left_anti")
    per = tail.groupBy(F.expr("right(word, 2)").alias("e")).agg(F.sum("c").alias("c"))
    common = per.orderBy(F.desc("c"), "e").limit(endings).collect()
    parts = (known, heads, [r.e for r in common])
    units = Units(*parts)
    pairs = unit_pairs(train, parts, units.count)
    of = exchange(pairs, classes)

    hot = np.zeros((units.count, classes))
    hot[np.arange(units.count), of] = 1
    used = hot.sum(0) > 0
    own = chosen(contexts(train, parts, of, classes), hot.T @ pairs @ hot, used)
    of_word = np.append(of[units.unit_of[:-1]], 0)  # known words, end, others (joined later)
    for r in own.where("id >= 0").select("id", "class").collect():
        of_word[r.id] = r["class"]
    types = np.bincount(of[:heads], minlength=classes).astype(float)
    for r in own.groupBy("class").count().collect():
        types[r["class"]] += r["count"]
    log_c = np.append(np.log10(np.append(counts, end_count) + 0.1), 0.0)  # known words, end, others (looked up later)
    ended = end_count > 0
    sent = docs.sparkSession.sparkContext.broadcast((parts, of, of_word.astype(np.uint8), log_c))

    fields = [("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("path", pa.binary()), ("place", pa.list_(pa.int32())), ("cold", pa.list_(pa.string()))]

    @F.arrow_udf("struct<n_tokens:long,n_known:long,base:double,path:binary,place:array<int>,cold:array<string>>")
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        parts, of, of_word, log_c = sent.value
        u = Units(*parts)
        for whole in batches:
            out: list[list] = [[] for _ in fields]
            for lo in range(0, len(whole), ROWS):
                sizes, at, unit, cold, others = u.read(whole.slice(lo, ROWS).to_pylist())
                ends = np.cumsum(sizes)
                starts, known = ends - sizes, log_c[at]
                path = of_word[at]
                path[cold] = of[unit[cold]]
                path, cut = path.tobytes(), np.searchsorted(cold, ends)
                cuts = list(zip([0, *cut[:-1].tolist()], cut.tolist()))
                # the end token is known only if some training text has been read
                n_known = np.add.reduceat((at >= 0).astype(np.int64), starts) - (0 if ended else 1)
                values = (sizes, n_known, np.add.reduceat(known, starts), [path[i:k] for i, k in zip(starts.tolist(), ends.tolist())])
                places = [cold[i:k] - first for (i, k), first in zip(cuts, starts)]
                for column, v in zip(out, (*values, places, [others[i:k] for i, k in cuts])):
                    column.extend(v)
            yield pa.StructArray.from_arrays([pa.array(v, k) for v, (_, k) in zip(out, fields)], [n for n, _ in fields])

    read_rows = rows.select("doc_id", "held_out", read("text").alias("r")).select("doc_id", "held_out", "r.*")
    read_rows = store(read_rows.withColumn("_row", F.monotonically_increasing_id()), "lm-rows", BATCH_ROWS)
    cold = read_rows.select("_row", F.explode(F.arrays_zip("place", "cold")).alias("w")).select("_row", "w.place", F.col("w.cold").alias("word"))
    cold = cold.join(own.where("id < 0").select("word", "c", "class"), "word", "left").groupBy("_row").agg(
        F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("log_c"), F.count("c").alias("more"),
        F.collect_list(F.when(F.col("class").isNotNull(), F.struct("place", "class"))).alias("found"),
    )

    @F.arrow_udf("binary")
    def put(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield joined(b.field("path"), b.field("found"))

    got = read_rows.drop("cold", "place").join(cold, "_row", "left")
    got = store(got.withColumn("path", put(F.struct("path", "found"))).drop("found", "_row"), "lm-paths", BATCH_ROWS)
    end = int(of[units.end])
    n = class_pairs(got.where(~F.col("held_out")), end, classes)
    prior = np.where(used, n.sum(0) + 1, 0)
    step = np.log10(np.where(used[None, :], (n + mu * prior[None, :] / prior.sum()) / (n.sum(1, keepdims=True) + mu), 1.0))
    # a word's share of its class: (c + 0.1) / (class's tokens + 0.1 (class's types + 1)); the end is its class
    share = np.log10(n.sum(0) + 0.1 * (types + 1))
    share[end] = log_c[-2]
    weight = docs.sparkSession.sparkContext.broadcast(step - share[None, :])

    @F.arrow_udf("double")
    def steps(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w = weight.value
        for b in batches:
            out: list[float] = []
            for lo in range(0, len(b), ROWS):
                paths = b.slice(lo, ROWS).to_pylist()
                cls = np.frombuffer(b"".join(paths), dtype=np.uint8).astype(np.int64)
                starts = np.cumsum([0, *map(len, paths)])[:-1]
                out += np.add.reduceat(w[np.append(end, cls[:-1]), cls], starts).tolist()
            yield pa.array(out, pa.float64())

    total = F.col("base") + F.coalesce("log_c", F.lit(0.0))
    norm = float(np.log10(n_all + 0.1 * (v_all + 1)))
    return got.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (total - F.col("n_tokens") * norm).alias("base_score"), (total + steps("path")).alias("score"),
    )
