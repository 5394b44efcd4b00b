"""Benchmark decontamination by latent semantic retrieval.

Benchmark items and corpus passages are TF-IDF vectors over hashed words. A randomised SVD of all passages of all
documents and of the items gives a latent space; its products with the matrix are computed by Spark
tasks over the stored features of the passages and added up by feature range; words are weighted by how many passages
hold them. Nothing is drawn or cut: 16 bits a word are stored once, read once for the weights and once per product. Every passage of every document is then projected (sums of rows of the feature matrix) and compared with all
items by cosine. A space of fixed rank keeps less of each item the more items there are, so an exact search
stands behind it: a text that holds a share of an item's words misses at most the others, hence holds some
of any larger part of them. The item's rarest words are looked up, and every passage with enough of them around is a
candidate too. No passage that verification would accept is left out, whatever the number of items.

Each candidate is verified on the words: the longest common subsequence of the item with the passage's surroundings must cover ``copy`` of the item, or
``paraphrase`` of it, together with the item's answer if the benchmark has a column ``answer`` and it is not null.

Passages are two neighbouring blocks of ``BLOCK`` words, so any stretch of one block's length lies inside
a passage. Documents are searched row by row in the scan's partitions: no shuffle, no pairs beyond the
verified ones. The items are collected to the driver and sent to the tasks: a benchmark must fit
there (``max_items``, an error beyond it); the feature matrix has a fixed size.

Null and empty texts contain nothing; items without words match nothing. Repeated rows are reported each, repeated items too.
Texts are searched whole, however long. Columns beyond ``doc_id``, ``text`` and the kept ones are not read; an empty table or an
empty benchmark gives rows without hits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batched, release, store, stored

BLOCK = 16
WIDE = 2 * BLOCK  # words of a passage
FEATURES = 1 << 15
TEXT_ROWS, STORED_ROWS = 1024, 32  # texts, rows of stored passages a Python function gets at a time: bounds what a task holds
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def tokens(text: str | None) -> list[bytes]:
    """Lower-case words without ASCII punctuation."""
    return text.lower().encode().translate(None, MARKS).split() if text else []


def hashed(words: list[bytes]) -> np.ndarray:
    """Feature numbers of words."""
    return np.fromiter(map(crc32, words), dtype=np.int64, count=len(words)) & (FEATURES - 1)


def blocked(texts: list[list[bytes]], ids: np.ndarray, width: int = BLOCK, empty: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers in blocks, FEATURES where a block is not full, and the text each block is of.

    Every text with words ends with an empty block (``empty``), so that its last block starts a passage too.
    """
    sizes = [-(-len(t) // width) + empty if t else 0 for t in texts]
    flat = np.full((sum(sizes), width), FEATURES, dtype=np.int64)
    line = flat.reshape(-1)
    at = src = 0
    for t, n in zip(texts, sizes):
        line[at : at + len(t)] = ids[src : src + len(t)]
        at, src = at + n * width, src + len(t)
    return flat, np.repeat(np.arange(len(texts)), sizes)


def once(ids: np.ndarray) -> np.ndarray:
    """The features of each row sorted, repeats replaced by FEATURES."""
    part = np.sort(ids, axis=1)
    part[:, 1:][part[:, 1:] == part[:, :-1]] = FEATURES
    return part


def added(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Sums of the table's rows named in each row of ``ids``."""
    out = table[ids[:, 0]]
    for k in range(1, ids.shape[1]):
        out += table[ids[:, k]]
    return out


def lcs(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    where: dict[bytes, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & where.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


class Index:
    """Items in the latent space, with what verification needs."""

    def __init__(self, ids, words, answers, idf, basis, share: float = 0.6):
        self.ids, self.words, self.answers = ids, words, answers
        self.longest = max(map(len, words), default=0)
        self.weight = np.append(idf, 0).astype(np.float32)
        self.table = np.vstack([basis * idf[:, None], np.zeros((1, basis.shape[1]))]).astype(np.float32)
        q = np.array([self.table[np.unique(hashed(w))].sum(0) if w else np.zeros(basis.shape[1]) for w in words], dtype=np.float32).reshape(len(words), basis.shape[1])
        norm = np.linalg.norm(q, axis=1, keepdims=True)
        self.q = np.where(norm > 1e-9, q / np.maximum(norm, 1e-9), 0).astype(np.float32)
        # a text with ``least`` of an item's words holds ``need`` of any ``len - least + need`` of them: the rarest ones
        feature, item, times = [], [], []
        self.need = np.zeros(len(words), dtype=np.int64)
        for k, w in enumerate(words):
            least = math.ceil(share * len(w) - 1e-9)
            self.need[k] = need = max(1, least // 5)
            f = hashed(w)
            f, n = np.unique(f[np.argsort(-idf[f], kind="stable")][: len(w) - least + need], return_counts=True)
            feature.append(f)
            item.append(np.full(len(f), k))
            times.append(n)
        feature, item, times = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (feature, item, times))
        by = np.argsort(feature, kind="stable")
        self.item, self.times = item[by], times[by]
        self.at = np.searchsorted(feature[by], np.arange(FEATURES + 1))
        self.posted = np.diff(self.at) > 0
        self.sizes = np.array([len(w) for w in words], dtype=np.int64)

    def cosine(self, words: list[bytes], block: int, k: int) -> float:
        """Cosine of an item and the passage that starts at the block."""
        at = [np.unique(hashed(words[i * BLOCK : (i + 1) * BLOCK])) for i in (block, block + 1)]
        ids = np.concatenate(at)
        return float(self.table[ids].sum(0) @ self.q[k] / max(1e-9, np.sqrt(np.square(self.weight[ids]).sum())))

    def shared(self, texts: list[list[bytes]], ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, first block, item) of every passage whose surroundings hold enough of the item's rarest words; ``ids`` are the texts' features."""
        sizes = [len(t) for t in texts]
        owner = np.repeat(np.arange(len(texts)), sizes)
        known = np.flatnonzero(self.posted[ids])  # most words are in no item's rarest
        owner, place = owner[known], known - np.cumsum([0, *sizes])[owner[known]]
        f = ids[known]
        n = self.at[f + 1] - self.at[f]
        word = np.repeat(np.arange(len(f)), n)
        post = np.repeat(self.at[f] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        key = owner[word] * len(self.words) + self.item[post]
        held = np.bincount(key, self.times[post], len(texts) * len(self.words))
        some = (held >= np.tile(self.need, len(texts)))[key]
        key, spot, post = key[some], place[word[some]], post[some]
        # the longest window of an item, laid from every hit on: where not even all hits in it are enough, there is nothing to look at
        reach = 2 * (self.sizes + BLOCK)
        wide = int(max(sizes, default=0)) + int(reach.max(initial=0)) + 1
        line = key * wide + spot
        by = np.argsort(line, kind="stable")
        key, spot, post, line = key[by], spot[by], post[by], line[by]
        total = np.append(0, np.cumsum(self.times[post]))
        item = key % len(self.words)
        stop = np.searchsorted(line, line + reach[item])
        enough = np.flatnonzero(total[stop] - total[:-1] >= self.need[item])
        cover = np.zeros(len(line) + 1, dtype=np.int64)
        np.add.at(cover, enough, 1)
        np.add.at(cover, stop[enough], -1)
        near = np.cumsum(cover[:-1]) > 0
        key, spot, post = key[near], spot[near], post[near]
        ends = np.append(np.flatnonzero(np.diff(key)) + 1, len(key))
        for lo, hi in zip(np.append(0, ends[:-1]), ends) if len(key) else ():
            t, k = divmod(int(key[lo]), len(self.words))
            size, last = len(self.words[k]), -(-len(texts[t]) // BLOCK) - 1
            at, which = spot[lo:hi], post[lo:hi].tolist()
            gap = -(-(size + 2 * BLOCK) // BLOCK)
            near = np.unique((at[:, None] // BLOCK + np.arange(-gap, gap + 1)).ravel())
            near = near[(near >= 0) & (near <= last)]
            first, end = np.searchsorted(at, near * BLOCK - size), np.searchsorted(at, (near + 2) * BLOCK + size)
            for block, a, b in zip(near.tolist(), first.tolist(), end.tolist()):
                if b > a and self.times[list(set(which[a:b]))].sum() >= self.need[k]:
                    yield t, block, k

    def candidates(self, texts: list[list[bytes]], ids: np.ndarray, least: float, chunk: int = 2048) -> Iterator[tuple[int, int, int, float]]:
        """(text, first block in the text, item, cosine) of passages close to an item."""
        flat, owner = blocked(texts, ids)
        if not len(flat) or not len(self.words):
            return
        first = np.append(0, np.flatnonzero(np.diff(owner)) + 1)
        start = np.zeros(len(texts), dtype=int)
        start[owner[first]] = first
        for lo in range(0, len(flat), chunk):
            part = once(flat[lo : lo + chunk + 1])  # a word counts once in a block
            rows = added(self.table, part)
            power = np.square(self.weight[part]).sum(1)
            same = owner[lo : lo + chunk][: len(part) - 1] == owner[lo + 1 : lo + 1 + chunk][: len(part) - 1]
            x = (rows[:-1] + rows[1:])[same]
            size = np.sqrt(power[:-1] + power[1:])[same]
            at = np.flatnonzero(same) + lo
            cos = x @ self.q.T
            for i, k in zip(*np.nonzero(cos >= least * np.maximum(size, 1e-9)[:, None])):
                yield int(owner[at[i]]), int(at[i] - start[owner[at[i]]]), int(k), float(cos[i, k] / size[i])


def search(index: Index, texts: list[str | None], least: float, copy: float, paraphrase: float) -> list[tuple[int, int, float, float, str]]:
    """(text, item, share, cosine, kind) of every contaminated text, the best passage of each item."""
    words = [tokens(t) for t in texts]
    best: dict[tuple[int, int], tuple[float, float, str]] = {}
    place, near = (-1, -1), set()
    ids = hashed([w for t in words for w in t])
    found = list(index.candidates(words, ids, least))
    seen = {c[:3] for c in found}
    step = max(1, (1 << 22) // max(1, len(index.words)))
    begin = np.cumsum([0, *map(len, words)])
    for lo in range(0, len(words), step):
        own = ids[begin[lo] : begin[min(lo + step, len(words))]]
        found += [(lo + t, block, k, None) for t, block, k in index.shared(words[lo : lo + step], own) if (lo + t, block, k) not in seen]
    for t, block, k, cos in sorted(found, key=lambda c: c[:3]):
        if best.get((t, k), (0.0,))[0] >= 1:
            continue
        item, answer = index.words[k], index.answers[k]
        if place != (t, block):
            place, near = (t, block), set(words[t][max(0, block * BLOCK - index.longest) : (block + 2) * BLOCK + index.longest])
        if sum(map(near.__contains__, item)) < paraphrase * len(item):
            continue  # no common subsequence can be longer than the words that are there
        around = words[t][max(0, block * BLOCK - len(item)) : (block + 2) * BLOCK + len(item)]
        share = lcs(item, around) / len(item)
        if share >= copy:
            kind = "copy"
        elif share >= paraphrase and lcs(answer, around) >= 0.75 * len(answer):
            kind = "paraphrase"
        else:
            continue
        cos = index.cosine(words[t], block, k) if cos is None else cos
        best[t, k] = max(best.get((t, k), (0.0, 0.0, "")), (share, cos, kind))
    return [(t, k, *v) for (t, k), v in best.items()]


def _passages(texts: DataFrame, rows: int = 256) -> DataFrame:
    """The distinct features of every passage of every text: WIDE 16-bit numbers a passage, a row for up to ``rows`` texts."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, rows):
                words = [tokens(t) for t in b.column(0).slice(lo, rows).to_pylist()]
                ids = blocked(words, hashed([w for t in words for w in t]), WIDE, 0)[0]
                if len(ids):
                    yield pa.RecordBatch.from_pydict({"ids": pa.array([once(ids.astype("<u2")).tobytes()], pa.binary())})

    return texts.select("text").mapInArrow(part, "ids binary")


def _read(batches: Iterator[pa.RecordBatch], passages: int = 4096) -> Iterator[np.ndarray]:
    """Stored passages, a bounded number at a time."""
    for b in batches:
        for row in b.column(0):
            ids = np.frombuffer(row.as_buffer(), dtype="<u2").reshape(-1, WIDE)
            for lo in range(0, len(ids), passages):
                yield ids[lo : lo + passages].astype(np.int64)


def _product(passages: DataFrame, weight: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A^T (A basis) over the stored passages as weighted rows of length 1: partial sums per task, added up per range of features."""
    sent = passages.sparkSession.sparkContext.broadcast((weight, np.vstack([basis * weight[:, None], np.zeros((1, basis.shape[1]))]).astype(np.float32)))
    wide = 256

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (weight, table), out = sent.value, None
        power = np.append(np.square(weight), 0)
        for ids in _read(batches):
            out = np.zeros((table.shape[1], FEATURES + 1)) if out is None else out
            x = added(table, ids) / power[ids].sum(1)[:, None]
            flat = ids.ravel()
            for total, v in zip(out, x.T):
                total += np.bincount(flat, np.repeat(v, WIDE), FEATURES + 1)
        if out is not None:
            ranges = (out[:, :-1] * weight).T.astype(np.float32).reshape(-1, wide * len(out))
            yield pa.RecordBatch.from_pydict({"part": pa.array(range(len(ranges)), pa.int32()), "v": pa.array([r.tobytes() for r in ranges], pa.binary())})

    def add(g: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(v, dtype=np.float32) for v in g.v], axis=0, dtype=np.float32)
        return pd.DataFrame({"part": g.part.iloc[:1], "v": [total.tobytes()]})

    schema = "part int, v binary"
    with batched(passages.sparkSession, STORED_ROWS):
        got = passages.mapInArrow(part, schema).groupBy("part").applyInPandas(add, schema).collect()
    out = np.zeros((FEATURES // wide, wide * basis.shape[1]), dtype=np.float32)
    for r in got:
        out[r.part] = np.frombuffer(r.v, dtype=np.float32)
    return out.reshape(basis.shape)


def _frequencies(passages: DataFrame) -> tuple[int, np.ndarray]:
    """How many stored passages there are, and how many hold each feature."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(FEATURES + 1, dtype=np.int64)
        for ids in _read(batches):
            out += np.bincount(ids.ravel(), minlength=FEATURES + 1) * (np.arange(FEATURES + 1) < FEATURES)
            out[FEATURES] += len(ids)
        f = np.flatnonzero(out)
        yield pa.RecordBatch.from_pydict({"f": pa.array(f, pa.int64()), "n": pa.array(out[f], pa.int64())})

    with batched(passages.sparkSession, STORED_ROWS):
        got = passages.mapInArrow(part, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).collect()  # at most FEATURES rows and one
    out = np.zeros(FEATURES + 1)
    for r in got:
        out[r.f] = r.n
    return int(out[FEATURES]), out[:FEATURES]


def build(docs: DataFrame, benchmark: DataFrame, rank: int = 64, max_items: int = 100_000) -> tuple:
    """What ``Index`` is made of: idf and the latent space, both from every passage of all documents and from the items."""
    named = "answer" in benchmark.columns
    items = benchmark.where("text is not null").select("item_id", "text", *(["answer"] if named else [])).orderBy("item_id", "text").limit(max_items + 1).collect()
    if len(items) > max_items:
        raise ValueError(f"more than {max_items} benchmark items: search in several runs")
    words = [tokens(r.text) for r in items]
    items = [r for r, w in zip(items, words) if w]
    words = [w for w in words if w]
    answers = [tokens(r.answer) if named and r.answer else [] for r in items]
    mark = stored()
    passages = store(_passages(docs), "lsi-passages", TEXT_ROWS)
    n, df = _frequencies(passages)
    for w in words:
        df[np.unique(hashed(w))] += 1
    n += len(words)
    idf = np.log((n + 1) / (df + 1)) + 0.1
    passages = passages.unionAll(store(_passages(benchmark), "lsi-items", TEXT_ROWS))
    # only the half of the space that is the corpus's: columns behind it would never reach it
    basis = np.linalg.qr(np.random.default_rng(7).standard_normal((FEATURES, rank // 2)))[0]
    for _ in range(2):  # random range, then one power step
        basis = np.linalg.qr(_product(passages, idf, basis).astype(np.float64))[0]
    release(docs.sparkSession, mark)
    # the items' own directions count most: what retrieval must not lose
    return [r.item_id for r in items], words, answers, idf, _with_items(basis, words, idf, rank).astype(np.float32)


def _with_items(half: np.ndarray, words: list[list[bytes]], idf: np.ndarray, rank: int) -> np.ndarray:
    """Half of the space from the corpus, half from the items' remainder (a second small randomised SVD)."""
    if not words:
        return half

    def times(m: np.ndarray) -> np.ndarray:
        out = np.zeros_like(m)
        for w in words:
            i = np.unique(hashed(w))
            v = idf[i]
            v = v / np.linalg.norm(v)
            out[i] += v[:, None] * (v @ m[i])[None, :]
        return out - half @ (half.T @ out)

    own = np.random.default_rng(8).standard_normal((FEATURES, rank - half.shape[1]))
    for _ in range(3):
        own = np.linalg.qr(times(own))[0]
    return np.linalg.qr(np.hstack([half, own]))[0]


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.15, copy: float = 0.8, paraphrase: float = 0.6, keep: list[str] | None = None, rows_per_search: int = 256) -> DataFrame:
    """Every row with its hits (array of item_id, share, cosine, kind; empty if clean) and the kept columns."""
    keep = keep or ["doc_id"]
    sent = docs.sparkSession.sparkContext.broadcast(build(docs, benchmark))

    hit = "array<struct<item_id:long,share:double,cosine:double,kind:string>>"

    @F.arrow_udf(hit)
    def hits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = Index(*sent.value, share=min(copy, paraphrase))
        kind_of = pa.list_(pa.struct([("item_id", pa.int64()), ("share", pa.float64()), ("cosine", pa.float64()), ("kind", pa.string())]))
        for b in batches:
            out: list[list[dict]] = [[] for _ in range(len(b))]
            for lo in range(0, len(b), rows_per_search):
                for t, k, share, cos, kind in search(index, b.slice(lo, rows_per_search).to_pylist(), least, copy, paraphrase):
                    out[lo + t].append({"item_id": index.ids[k], "share": share, "cosine": cos, "kind": kind})
            yield pa.array(out, kind_of)

    return docs.select(*keep, hits("text").alias("_hits"))
