"""SimHash near-duplicates through a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits; its image is the vector of their bit counts (0, 1
or 2). One differing bit moves one coordinate by one, so the Manhattan distance of two images never
exceeds the Hamming distance of the fingerprints. Within 3 bits, one half of the 32 coordinates is within
distance 1. The grid has a cell for every image of a half: each fingerprint lies in two cells and looks into
these and the cells one step along one coordinate, and every candidate is verified with the exact distance.

Only distinct fingerprints enter the join, so copies cost nothing. Cells with many fingerprints (near
copies of one text) are not joined pair by pair: they are cut into tiles, and a tile returns a spanning
forest of its links, which joins the same components with at most one link per member.

Null and empty texts have the fingerprint zero and are linked like any other. Rows with a null id take
part; a component's id is its smallest id that is not null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from . import shingles
from .common import components, packed, release, store, stored

LOW_HALF, TWO_BITS = 0xFFFFFFFF, 0x55555555


def fingerprint(text: str | None, width: int = 3) -> int:
    """Majority of each bit over the shingles' hashes; bytes lower and split at ASCII letters and blanks only."""
    w = text.encode().lower().split() if text else []
    if not w:
        return 0
    parts = zip(*(w[k:] for k in range(width))) if len(w) >= width else [w]
    h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(p), 42) for p in parts), dtype="<u8")
    votes = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 4096):
        votes += np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 3, rows: int = 512) -> DataFrame:
    """(doc_id, h hash of the text, fp long): XXH64 with seed 42 of every shingle of ``width`` words, majority per bit."""

    @F.arrow_udf("long")
    def majority(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([fingerprint(t, width) for lo in range(0, len(b), rows) for t in b.slice(lo, rows).to_pylist()], pa.int64())

    return docs.select("doc_id", F.xxhash64("text").alias("h"), majority("text").alias("fp"))


def embed(half: Column) -> Column:
    """Bit counts of the 16 two-bit segments of a 32-bit half, packed into 32 bits."""
    return half - F.shiftrightunsigned(half, 1).bitwiseAND(F.lit(TWO_BITS))


def _cells(fps: DataFrame) -> DataFrame:
    """(fp, cell, home): the two cells of a fingerprint and those one step away in one coordinate."""
    low, high = F.col("fp").bitwiseAND(F.lit(LOW_HALF)), F.shiftrightunsigned("fp", 32)
    half = F.explode(F.array(*[F.struct(F.lit(k).alias("half"), embed(x).alias("at")) for k, x in enumerate((low, high))]))
    homes = fps.select("fp", half.alias("c")).select("fp", "c.half", "c.at")
    digit = lambda i: F.shiftrightunsigned(F.col("at"), (2 * i)).bitwiseAND(F.lit(3))
    near = [F.lit(0).cast("long")]
    for i in range(16):
        near += [F.when(digit(i) < 2, F.lit(1 << (2 * i))), F.when(digit(i) > 0, F.lit(-(1 << (2 * i))))]
    step = F.explode(F.array_compact(F.array(*near)))
    return homes.select("fp", "half", "at", step.alias("s")).select("fp", ((F.col("at") + F.col("s")) * 2 + F.col("half")).alias("cell"), (F.col("s") == 0).alias("home"))


def _forest(a: np.ndarray, b: np.ndarray, bits: int) -> tuple[list[int], list[int]]:
    """A spanning forest of the links between fingerprints ``a`` and ``b`` (both int64)."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    left, right = [], []
    for x in a.tolist():
        near = b[np.bitwise_count(b ^ np.int64(x)) <= bits]
        for y in near.tolist():
            p, q = find(x), find(y)
            if p != q:
                parent[p] = q
                left.append(x)
                right.append(y)
    return left, right


def links(fps: DataFrame, bits: int = 3, hot: int = 64, tile: int = 1024) -> DataFrame:
    """Links (a, b) whose components are those of all pairs within ``bits`` differing bits."""
    if not 0 <= bits <= 3:
        raise ValueError("two halves cover up to 3 differing bits")
    cells = store(_cells(fps), "cells")
    full = cells.groupBy("cell").agg(F.sum(F.col("home").cast("long")).alias("m"), F.count("*").alias("p")).where(f"m > {hot}")
    full = store(full.select("cell", F.ceil(F.col("m") / tile).cast("int").alias("tm"), F.ceil(F.col("p") / tile).cast("int").alias("tp")), "hot-cells")
    cold = cells.join(full, "cell", "left_anti")
    homes = cold.where("home").select(F.col("fp").alias("b"), "cell")
    pairs = cold.withColumnRenamed("fp", "a").join(homes, "cell").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)).select("a", "b")

    part = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    crowd = cells.join(full, "cell")
    homes = crowd.where("home").select("fp", F.lit(True).alias("home"), "cell", part("tm").alias("i"), every("tp").alias("j"))
    seekers = crowd.select("fp", F.lit(False).alias("home"), "cell", every("tm").alias("i"), part("tp").alias("j"))

    def forest(g: pd.DataFrame) -> pd.DataFrame:
        at = g.home.to_numpy()
        fp = g.fp.to_numpy(dtype=np.int64)
        a, b = _forest(fp[~at], fp[at], bits)
        return pd.DataFrame({"a": a, "b": b}, dtype="int64")

    tiles = homes.unionAll(seekers).groupBy("cell", "i", "j").applyInPandas(forest, "a long, b long")
    return pairs.unionAll(tiles)


def near_duplicates(docs: DataFrame, bits: int = 3, width: int = 3) -> DataFrame:
    """(doc_id, h, fp, root, component_id) of every row; root is the component's smallest fingerprint."""
    prints = store(fingerprints(docs, width), "fingerprints", shingles.BATCH_ROWS)
    distinct = store(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = store(components(links(distinct.select("fp"), bits)), "roots")
    named = distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    best = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(named.select("fp", "root").join(best, "root"), "fp").select("doc_id", "h", "fp", "root", "component_id")


def copies(docs: DataFrame) -> DataFrame:
    """(doc_id, h, root) of every row; root names the component of texts with a five-word Jaccard similarity of 0.8 or more.

    The components of ``near_duplicates`` on five-word fingerprints are the first candidates, verified on whole sets of shingles: texts
    that repeat one sentence have equal fingerprints and little else in common. The exact join of ``shingles`` finds the links beyond 3 bits.
    """
    mark = stored()
    near = near_duplicates(docs, width=shingles.WIDTH).groupBy("h").agg(F.min("root").alias("group"))
    near = store(near, "fingerprint-groups")
    release(docs.sparkSession, mark, stored() - 1)  # cells and links of the fingerprints have been read for the last time
    return shingles.grouped(docs, first=near)


def first_of_group(docs: DataFrame, sent_rows: int = 1_000_000) -> DataFrame:
    """One row of each component of similar texts (see ``copies``), all columns: the one with the smallest id (null last), then text hash.

    Of repeated rows of that id and text one stays; only such rows are exchanged to choose it.
    """
    mark = stored()
    times = copies(docs).groupBy("doc_id", "h").agg(F.count("*").alias("times"), F.min("root").alias("root"))
    chosen = times.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "times")).alias("best"))
    chosen = store(chosen.select(F.col("best.doc_id").alias("_id"), F.col("best.h").alias("_h"), F.col("best.times").alias("_times")), "chosen")
    release(docs.sparkSession, mark, stored() - 1)  # all else has been read for the last time
    # 24 bytes a row: sent to the tasks while it is small
    few = F.broadcast(chosen) if chosen.count() <= sent_rows else chosen
    rows = packed(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("_hash"), "row")
    rows = rows.join(few, rows["doc_id"].eqNullSafe(few["_id"]) & (rows["_hash"] == few["_h"]))
    again = rows.where("_times > 1").dropDuplicates(["doc_id", "_hash"])
    return rows.where("_times = 1").select("row.*").unionAll(again.select("row.*"))


def hex64(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
