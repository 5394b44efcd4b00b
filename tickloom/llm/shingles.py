"""Near copies by the Jaccard similarity of five-word shingles, exact and without a pair lost.

A text is the set of its shingles' hashes. If two sets of n and m shingles reach the similarity s, every order of
all shingles puts a common one among the first ``n - ceil(s n) + 1`` of one and the first ``m - ceil(s m) + 1`` of the
other. So only these prefixes are joined; the order puts shingles that many texts of a sample hold last, the most frequent at the end, which makes
prefixes rare and changes no result. The sample grows with the table, or shingles of the same share of the texts would crowd the prefixes of a larger
one. Shingles missing from a prefix that ends first are missing from the other
set, which rules out many candidates. A set also has at least ``BITS`` bits, and at least one per shingle, each the parity of the shingles that fall on it: one shingle in one
set only moves one bit, so the bits differ in no more places than the sets have such shingles, and candidates that differ in
more than a pair at s can are dropped, long texts too. The rest are compared on their whole sets.

Equal sets are one node, so copies cost nothing. A prefix shingle of more than ``hot`` nodes is not joined pair by
pair: its nodes are compared with one node of their tile each and these with one another's first; nodes that are connected by then, through
whatever links, are not compared again. The nodes outside the largest component that a shingle's nodes have are cut into tiles with all of them, nodes
without a partner of another component by their sizes and bits leave their tile, and a tile returns a spanning forest of its links found on whole sets.

A text of fewer words than ``WIDTH`` is one shingle; texts without words, null ones too, have the same empty set and are one group.
Repeated rows share their text's node. Texts are read whole, however long; columns beyond ``doc_id`` and ``text`` are not read. An empty table has
no nodes and no links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import batched, components, release, store, stored

WIDTH = 5
BATCH_ROWS = 1024  # texts a Python function gets at a time: bounds what a task holds
BITS = 1024  # at least; the width is a power of two
#: The least similarity is PART / OF.
PART, OF = 4, 5


def shingles(text: str | None) -> np.ndarray:
    """Sorted hashes (63 bits, int64) of the distinct shingles; bytes lower and split at ASCII letters and blanks only."""
    w = text.encode().lower().split() if text else []
    if len(w) < WIDTH:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), 5) >> 1] if w else [], dtype=np.int64)
    word = np.fromiter(map(xxhash.xxh64_intdigest, w), dtype=np.uint64, count=len(w))
    n = len(w) - WIDTH + 1
    h = np.zeros(n, dtype=np.uint64)
    for k in range(WIDTH):
        h = h * np.uint64(0x9E3779B97F4A7C15) + word[k : k + n]
        h ^= h >> np.uint64(29)
    return np.unique((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(1)).astype(np.int64)


def close(common: Column, sizes: Column) -> Column:
    """Whether sets of so many common shingles and so many in both added up are similar enough."""
    return common * (PART + OF) >= sizes * PART


def parities(x: np.ndarray) -> bytes:
    """For each of ``BITS`` places or more, one per shingle at least, whether an odd number of the shingles fall on it."""
    wide = max(BITS, 1 << max(0, len(x) - 1).bit_length())
    return np.packbits(np.bincount(x % wide, minlength=wide) & 1, bitorder="little").astype(np.uint8).tobytes()


def places(bits: list[bytes], size: int | None = None) -> np.ndarray:
    """A row of bits per set, of ``size`` bytes (those of the narrowest): folding wide bits gives the parities of the narrower division."""
    long = np.array([len(x) for x in bits], dtype=np.int64)
    size = size or int(long.min(initial=1 << 62))
    out = np.zeros((len(bits), size // 8 if len(bits) else 0), dtype=np.uint64)
    for n in np.unique(long).tolist():
        at = np.flatnonzero(long == n)
        out[at] = np.bitwise_xor.reduce(np.frombuffer(b"".join([bits[k] for k in at.tolist()]), dtype=np.uint64).reshape(len(at), n // size, size // 8), axis=1)
    return out


def near(differing, sizes):
    """Whether sets of so many shingles added up can be similar enough if so many of their bits differ; arrays or columns."""
    return differing * (PART + OF) <= sizes * (OF - PART)


def sized(a, b):
    """Whether sets of so many shingles can be similar enough; arrays or columns."""
    return (a * OF >= b * PART) & (b * OF >= a * PART)


def apart(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """In how many places the bits of sets differ, pair by pair, at the width of the narrower."""
    size, out = np.minimum([len(x) for x in a], [len(x) for x in b]), np.zeros(len(a), dtype=np.int32)
    for n in np.unique(size).astype(int).tolist():
        at = np.flatnonzero(size == n)
        out[at] = np.bitwise_count(places([a[k] for k in at.tolist()], n) ^ places([b[k] for k in at.tolist()], n)).sum(1)
    return out


def differing(a: Column, b: Column) -> Column:
    @F.arrow_udf("int")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in batches:
            yield pa.array(apart(a.to_pylist(), b.to_pylist()), pa.int32())

    return run(a, b)


def sets(text: Column, rows: int = 256) -> Column:
    @F.arrow_udf("array<long>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            kind = pa.list_(pa.int64())
            yield pa.concat_arrays([pa.array([shingles(t) for t in b.slice(lo, rows).to_pylist()], kind) for lo in range(0, len(b), rows)] or [pa.array([], kind)])

    return run(text)


def common_shingles(docs: DataFrame, texts: int = 8192, one_in: int = 32, times: int = 4, most: int = 1 << 20) -> np.ndarray:
    """Shingles that at least ``times`` of the texts drawn by hash hold, rarest first: the end of the order. Drawn are one of ``one_in``, or about ``texts`` if these are more."""
    n, h, mark = docs.count(), F.xxhash64("text"), stored()
    some = docs.select("text").where(F.pmod(h, F.lit(1 << 30)) < int((1 << 30) * min(1.0, max(1 / one_in, texts / max(1, n))))).dropDuplicates(["text"])
    seen = some.select(F.explode(sets(F.col("text"))).alias("x")).groupBy("x").count().where(F.col("count") >= times)
    seen = store(seen.orderBy(F.desc("count"), "x").limit(most), "common-shingles", BATCH_ROWS)
    got = seen.toPandas().sort_values(["count", "x"])  # 16 bytes for each of ``most`` at most
    release(docs.sparkSession, mark)
    return got.x.to_numpy(dtype=np.int64)


def prints(docs: DataFrame, last: np.ndarray, rows: int = 256) -> DataFrame:
    """(doc_id, h hash of the text, node, n shingles, bits, low prefix in the order): cold shingles are negative, common ones their places in ``last``."""
    by = np.argsort(last)
    sent = docs.sparkSession.sparkContext.broadcast((last[by], by))
    kind = pa.struct([("node", pa.int64()), ("n", pa.int64()), ("bits", pa.binary()), ("low", pa.list_(pa.int64()))])

    def row(text: str | None, late: np.ndarray, place: np.ndarray) -> dict:
        x = shingles(text)
        node = int(np.uint64(xxhash.xxh64_intdigest(x.tobytes())).astype(np.int64)) if len(x) else 0
        order = x + np.iinfo(np.int64).min
        if len(late):
            at = np.minimum(np.searchsorted(late, x), len(late) - 1)
            order = np.where(late[at] == x, place[at], order)
        size = len(x) - -(-PART * len(x) // OF) + 1 if len(x) else 0
        return {"node": node, "n": len(x), "bits": parities(x), "low": np.sort(order)[:size]}

    @F.arrow_udf("struct<node:long,n:long,bits:binary,low:array<long>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.concat_arrays([pa.array([row(t, *sent.value) for t in b.slice(lo, rows).to_pylist()], kind) for lo in range(0, len(b), rows)] or [pa.array([], kind)])

    return docs.select("doc_id", F.xxhash64("text").alias("h"), run("text").alias("p")).select("doc_id", "h", "p.*")


def partners(n: np.ndarray, bits: list[bytes], left: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Which sets may be similar to one of another component by their sizes ``n`` and bits: those marked ``left`` to the others."""
    by = np.argsort(n, kind="stable")  # a set's partners are neighbours in this order, and wider bits come later
    n, left, root, bits = n[by], left[by], root[by], [bits[k] for k in by.tolist()]
    wide = np.array([len(x) for x in bits], dtype=np.int64)
    first = {s: int(np.searchsorted(wide, s)) for s in np.unique(wide).tolist()}
    table = {s: places(bits[lo:], s) for s, lo in first.items()}
    other, seen = np.flatnonzero(~left), np.zeros(len(n), dtype=bool)
    begin, end = np.searchsorted(n[other], -(-n * PART // OF)), np.searchsorted(n[other], n * OF // PART, "right")
    for k in np.flatnonzero(left).tolist():
        close_by = other[begin[k] : end[k]]
        close_by = close_by[root[close_by] != root[k]]
        shared = np.minimum(wide[close_by], wide[k])
        for s in np.unique(shared).tolist():
            some = close_by[shared == s]
            found = some[near(np.bitwise_count(table[s][some - first[s]] ^ table[s][k - first[s]]).sum(1, dtype=np.int64), n[some] + n[k])]
            seen[found] = True
            seen[k] |= len(found) > 0
    out = np.zeros(len(n), dtype=bool)
    out[by] = seen
    return out


def forest(ids: list[int], held: list[np.ndarray], left: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of the links between the nodes marked ``left`` and the others."""
    other = np.flatnonzero(~left)
    owner = np.repeat(other, [len(held[k]) for k in other])
    flat = np.concatenate([held[k] for k in other]) if len(other) else np.zeros(0, dtype=np.int64)
    by = np.argsort(flat, kind="stable")
    flat, owner = flat[by], owner[by]
    size = np.array([len(x) for x in held])
    parent = list(range(len(ids)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    a, b = [], []
    for i in np.flatnonzero(left).tolist():
        lo, hi = np.searchsorted(flat, held[i]), np.searchsorted(flat, held[i], "right")
        n = hi - lo
        at = np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(ids))
        for j in np.flatnonzero((both > 0) & (both * (PART + OF) >= (size + size[i]) * PART)).tolist():
            p, q = find(i), find(j)
            if p != q:
                parent[p] = q
                a.append(ids[i])
                b.append(ids[j])
    return a, b


def links(docs: DataFrame, nodes: DataFrame, hot: int = 64, tile: int = 256, sent_rows: int = 1_000_000, first: DataFrame | None = None) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of similar nodes; ``nodes`` is (node, h, n, bits, low).

    ``first`` (node_a, node_b) are candidates of another method: verified like the others, before them."""
    mark = stored()
    posts = nodes.where("n > 0").select("node", F.explode("low").alias("x"))
    # most prefix shingles are held by one node and link nothing: counted first (combined before the exchange), only the others are kept
    held = posts.groupBy("x").agg(F.count("*").cast("int").alias("m")).where("m > 1")
    posts = store(posts.join(held, "x"), "shared-prefixes")
    full = posts.where(f"m > {hot}").groupBy("x", "m").agg(F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who"))
    full = store(full, "hot-shingles")
    cold = posts.where(f"m <= {hot}").join(nodes.where("n > 0").select("node", "n", F.element_at("low", -1).alias("top")), "node")
    cold = store(cold.select("x", "node", "n", "top"), "cold-prefixes")
    a = cold.select("x", *[F.col(c).alias(f"{c}_a") for c in ("node", "n", "top")])
    b = cold.select("x", *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "top")])
    pairs = a.join(b, "x").where((F.col("node_a") < F.col("node_b")) & sized(F.col("n_a"), F.col("n_b")))
    pairs = pairs.groupBy("node_a", "node_b", "n_a", "n_b", "top_a", "top_b").agg(F.count("*").alias("both"))
    # of the prefix that ends first, what is not common is in no place of the other set; n - length of the prefix is ceil(s n) - 1
    rest = lambda n: F.ceil(n * PART / OF) - 1
    n = F.when(F.col("top_a") <= F.col("top_b"), rest(F.col("n_a"))).otherwise(rest(F.col("n_b")))
    pairs = pairs.where(close(n + F.col("both"), F.col("n_a") + F.col("n_b"))).select("node_a", "node_b")

    def possible(some: DataFrame) -> DataFrame:
        bits = lambda k: nodes.select(F.col("node").alias(f"node_{k}"), F.col("n").alias(f"n_{k}"), F.col("bits").alias(f"bits_{k}"))
        both = some.join(bits("a"), "node_a").join(bits("b"), "node_b").where(sized(F.col("n_a"), F.col("n_b"))).where(near(differing(F.col("bits_a"), F.col("bits_b")), F.col("n_a") + F.col("n_b")))
        return store(both.select("node_a", "node_b"), "candidates", BATCH_ROWS)

    pairs = possible(pairs)

    # shingles held by the same nodes are one cell
    cells = full.groupBy("m", "who").agg(F.min("x").alias("x")).select("x", F.ceil(F.col("m") / tile).cast("int").alias("t"))
    crowd = posts.where(f"m > {hot}").select("x", "node").join(cells, "x").select("x", "node", F.pmod(F.xxhash64("x", "node"), F.col("t")).cast("int").alias("p"))
    crowd = store(crowd, "crowds")
    lead = crowd.groupBy("x", "p").agg(F.min(F.struct(F.xxhash64("node", "x").alias("h"), "node")).alias("one"))
    top = lead.groupBy("x").agg(F.min("one").alias("top"))
    stars = crowd.join(lead, ["x", "p"]).select(F.col("one.node").alias("u"), F.col("node").alias("v")).unionAll(lead.join(top, "x").select("top.node", "one.node"))
    stars = stars.where("u <> v").select(F.least("u", "v").alias("node_a"), F.greatest("u", "v").alias("node_b"))
    first = possible((stars if first is None else stars.unionAll(first)).distinct())

    def whole(known: DataFrame, name: str) -> DataFrame:
        """(node, set) of the nodes named in a table."""
        wanted = store(nodes.select("node", "h").join(known.distinct(), "node"), f"wanted-{name}")
        # 16 bytes a row: sent to the tasks while it is small, so that only the wanted texts are exchanged
        few = F.broadcast(wanted) if wanted.count() <= sent_rows else wanted
        texts = docs.select("text", F.xxhash64("text").alias("h")).join(few, "h").dropDuplicates(["h"])
        return store(texts.select("node", sets(F.col("text")).alias("set")), name, BATCH_ROWS)

    own = whole(pairs.unionAll(first).select(F.explode(F.array("node_a", "node_b")).alias("node")), "sets")
    release(docs.sparkSession, mark, mark + 3)  # prefixes have been read for the last time

    def similar(some: DataFrame) -> DataFrame:
        ids = some.select(F.explode(F.array("node_a", "node_b")).alias("node")).distinct()
        held = own.join(F.broadcast(ids) if ids.count() <= sent_rows else ids, "node", "left_semi")  # other sets are not exchanged
        of = lambda k: held.select(F.col("node").alias(f"node_{k}"), F.col("set").alias(f"set_{k}"))
        both = some.join(of("a"), "node_a").join(of("b"), "node_b")
        both = both.where(close(F.size(F.array_intersect("set_a", "set_b")), F.size("set_a") + F.size("set_b")))
        return store(both.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")), "links")

    # one candidate per node first; what these links connect already needs no further look, and whole sets are moved for few pairs
    some = pairs.groupBy("node_b").agg(F.min("node_a").alias("node_a")).select("node_a", "node_b")
    plain = similar(some.unionAll(first).distinct())
    root = components(plain)
    at = lambda k: root.select(F.col("node").alias(f"node_{k}"), F.col("root").alias(f"root_{k}"))
    apart = pairs.join(at("a"), "node_a", "left").join(at("b"), "node_b", "left")
    apart = apart.where(F.coalesce("root_a", "node_a") != F.coalesce("root_b", "node_b")).select("node_a", "node_b")
    plain = plain.unionAll(similar(apart))

    crowd = crowd.select("x", "node").join(root, "node", "left").select("x", "node", F.coalesce("root", "node").alias("root"))
    crowd = store(crowd, "crowd-roots")
    per = crowd.groupBy("x", "root").agg(F.count("*").alias("c")).groupBy("x").agg(F.sum("c").alias("m"), F.max(F.struct("c", "root")).alias("top"), F.count("*").alias("roots"))
    per = per.where("roots > 1").select("x", F.col("top.root").alias("most"), F.ceil((F.col("m") - F.col("top.c")) / tile).cast("int").alias("tu"), F.ceil(F.col("m") / tile).cast("int").alias("tm"))
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    crowd = crowd.join(per, "x")
    left = crowd.where("root <> most").select("x", "node", "root", F.lit(True).alias("left"), part("tu").alias("i"), every("tm").alias("j"))
    tiles = left.unionAll(crowd.select("x", "node", "root", F.lit(False).alias("left"), every("tu").alias("i"), part("tm").alias("j")))

    def partnered(g: pd.DataFrame) -> pd.DataFrame:
        return g.loc[partners(g.n.to_numpy(), g.bits.tolist(), g.left.to_numpy(dtype=bool), g.root.to_numpy()), ["x", "node", "i", "j", "left"]]

    tiles = tiles.join(nodes.select("node", "n", "bits"), "node").groupBy("x", "i", "j").applyInPandas(partnered, "x long, node long, i int, j int, left boolean")
    tiles = store(tiles, "tiles")
    held = whole(tiles.select("node"), "tile-sets")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        a, b = forest(g.node.tolist(), [np.asarray(x, dtype=np.int64) for x in g["set"]], g.left.to_numpy(dtype=bool))
        return pd.DataFrame({"a": a, "b": b}, dtype="int64")

    return plain.unionAll(tiles.join(held, "node").groupBy("x", "i", "j").applyInPandas(run, "a long, b long"))


def grouped(docs: DataFrame, hot: int = 64, tile: int = 256, first: DataFrame | None = None) -> DataFrame:
    """(doc_id, h, root) of every row; root names the component of similar texts. ``first`` (h, group) names texts that may be similar."""
    mark = stored()
    whole = store(prints(docs, common_shingles(docs)), "shingle-prints", BATCH_ROWS)
    rows = store(whole.select("doc_id", "h", "node", "n"), "shingle-rows")
    nodes = whole.groupBy("node").agg(F.min(F.struct("h", "n", "bits", "low")).alias("one")).select("node", "one.*")
    nodes = store(nodes, "shingle-nodes")
    release(docs.sparkSession, mark, mark + 1)  # prefixes are with the nodes from here on
    if first is not None:  # a group's texts against the smallest of them
        of = rows.where("n > 0").select("h", "node").distinct().join(first, "h").select("group", "node").distinct()
        least = of.groupBy("group").agg(F.min("node").alias("node_a"), F.count("*").alias("texts")).where("texts > 1").drop("texts")
        first = of.join(least, "group").where("node <> node_a").select("node_a", F.col("node").alias("node_b")).distinct()
        first = store(first, "first-candidates")
    roots = store(components(links(docs, nodes, hot, tile, first=first)), "shingle-roots")
    named = rows.select("doc_id", "h", "node").join(roots, "node", "left")
    return named.select("doc_id", "h", F.coalesce("root", "node").alias("root"))
