"""Conversation prefix trie: adaptive radix trees over fixed-width big-endian turn ids.

A turn's id has ``WIDTH`` bytes: 128 bits of the SHA-256 of role and text, then the text's bytes in UTF-8 as a 32-bit number.
A conversation's key is the concatenation of its turns' ids, so byte prefixes of whole turns are the nodes of the trie. Equal
conversations become one key with a count before anything is exchanged by key. Distinct keys are cut into ranges of
about equal numbers, and each range is put into an adaptive radix tree of its own: inner nodes begin with 4 children and grow to
16, 48 and 256, and bytes without a branch are compressed into one path. Walking the tree, only depths of whole turns emit nodes.

Nodes on the path of a range's first or last key may go on in neighbouring ranges. Such a node belongs to the first range that
has it; what every range adds to it is a sum (conversations, children and leaves that begin there, repeated bytes), so its parts are added up
by a group over these few rows. A range learns from its neighbours' border keys, compared in Spark, how many turns they share.

Nothing is gathered per node: the members that end in a node are listed in pieces of at most ``PIECE`` ids, which stream through
one hash per node in order. A conversation's own ids (40 bytes a turn) are held in one row, and a range of keys in one task.

Null roles and texts are empty; rows of one turn are ordered by their id. A null conv_id is a conversation without decimal text: it counts as
a member, never as the smallest one or in a digest. Repeated rows are turns of their own. Columns beyond the four are not read. An empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import crc_text, store

#: Bytes of a turn id: 16 of the hash, 4 of the text's length.
WIDTH = 20
PIECE_BITS = 12


class Node:
    """A node of the adaptive radix tree: a compressed path, a value, and children in the smallest layout that holds them."""

    __slots__ = ("path", "value", "room", "index", "kids")

    def __init__(self, path: bytes, value=None):
        self.path, self.value = path, value
        self.room, self.index, self.kids = 4, bytearray(), []

    def find(self, b: int) -> Node | None:
        if self.room == 256:
            return self.kids[b]
        at = self.index[b] - 1 if self.room == 48 else self.index.find(b)
        return self.kids[at] if at >= 0 else None

    def add(self, b: int, kid: Node) -> None:
        if self.room < 256 and len(self.kids) == self.room:
            self.grow()
        if self.room == 256:
            self.kids[b] = kid
        elif self.room == 48:
            self.kids.append(kid)
            self.index[b] = len(self.kids)
        else:
            at = sum(x < b for x in self.index)
            self.index.insert(at, b)
            self.kids.insert(at, kid)

    def grow(self) -> None:
        """4 to 16 sorted bytes, then 48 places behind an index by byte, then one place per byte."""
        held = list(self.items())
        self.room = {4: 16, 16: 48, 48: 256}[self.room]
        if self.room == 48:
            self.index, self.kids = bytearray(256), [k for _, k in held]
            for at, (b, _) in enumerate(held):
                self.index[b] = at + 1
        elif self.room == 256:
            self.index, self.kids = bytearray(), [None] * 256
            for b, k in held:
                self.kids[b] = k

    def items(self) -> Iterator[tuple[int, Node]]:
        """Children by byte."""
        if self.room == 256:
            return ((b, k) for b, k in enumerate(self.kids) if k is not None)
        if self.room == 48:
            return ((b, self.kids[at - 1]) for b, at in enumerate(self.index) if at)
        return zip(self.index, self.kids)

    def split(self, m: int) -> None:
        """Cut the path after ``m`` bytes; what was here becomes the only child."""
        low = Node(self.path[m + 1 :], self.value)
        low.room, low.index, low.kids = self.room, self.index, self.kids
        b, self.path, self.value = self.path[m], self.path[:m], None
        self.room, self.index, self.kids = 4, bytearray(), []
        self.add(b, low)


def insert(root: Node, key: bytes, value) -> None:
    node, i = root, 0
    while True:
        p = node.path
        if not key.startswith(p, i):
            m = next((k for k, (a, b) in enumerate(zip(p, memoryview(key)[i:])) if a != b), len(key) - i)
            node.split(m)
            p = node.path
        i += len(p)
        if i == len(key):
            node.value = value
            return
        kid = node.find(key[i])
        if kid is None:
            node.add(key[i], Node(key[i + 1 :], value))
            return
        node, i = kid, i + 1


def prefixes(key: bytes, turns: int) -> set[bytes]:
    """Ids of the nodes for the first 0 to ``turns`` turns of a key."""
    h = hashlib.md5()
    out = {h.digest()} if turns >= 0 else set()
    for d in range(turns):
        h.update(key[d * WIDTH : (d + 1) * WIDTH])
        out.add(h.digest())
    return out


class Trie:
    """Whole-turn nodes of a radix tree, parents first, with sums over their subtrees."""

    def __init__(self, root: Node, carried: set[bytes], shared: set[bytes], last: bytes | None):
        self.id, self.parent, self.depth, self.bytes, self.conv, self.convs = [], [], [], [], [], []
        self.carried, self.border = [], []
        ends = self.read(root, carried, shared)
        n = len(self.id)
        self.children, self.leaves, self.saved, below = [0] * n, [0] * n, [0] * n, [0] * n
        for t in range(n - 1, -1, -1):
            own = not self.carried[t]
            if not below[t] and t in ends and self.id[t] != last:
                self.leaves[t] = 1
            self.saved[t] += (self.convs[t] - own) * self.bytes[t]
            p = self.parent[t]
            if p >= 0:
                below[p] += 1
                self.children[p] += own
                self.leaves[p] += self.leaves[t]
                self.saved[p] += self.saved[t]
                self.convs[p] += self.convs[t]
                self.conv[p] = least(self.conv[p], self.conv[t])

    def node(self, digest: bytes, parent: int, depth: int, size: int, carried: set[bytes], shared: set[bytes]) -> int:
        self.id.append(digest)
        self.parent.append(parent)
        self.depth.append(depth)
        self.bytes.append(size)
        self.conv.append(None)
        self.convs.append(0)
        self.carried.append(digest in carried)
        self.border.append(digest in carried or digest in shared)
        return len(self.id) - 1

    def read(self, root: Node, carried: set[bytes], shared: set[bytes]) -> set[int]:
        h, ends = hashlib.md5(), set()
        stack = [(root, b"", h, self.node(h.digest(), -1, 0, 0, carried, shared))]
        while stack:
            node, before, h, t = stack.pop()
            way, at = before + node.path, 0
            while at + WIDTH <= len(way):
                turn = way[at : at + WIDTH]
                at += WIDTH
                h = h.copy()
                h.update(turn)
                t = self.node(h.digest(), t, self.depth[t] + 1, int.from_bytes(turn[-4:], "big"), carried, shared)
            if node.value is not None:
                self.convs[t], self.conv[t] = node.value
                ends.add(t)
            stack.extend((kid, way[at:] + bytes((b,)), h, t) for b, kid in node.items())
        return ends


def least(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


NODE = "id binary, parent_id binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, border boolean, parent_border boolean"


def grow(group: pa.Table) -> pa.Table:
    """The nodes of one range of keys; columns key, n, conv and the turns shared with the neighbours."""
    key, n, conv = (group.column(c).to_pylist() for c in ("key", "n", "conv"))
    before, after = (group.column(c)[0].as_py() for c in ("before", "after"))
    root = Node(b"")
    for k, x, c in zip(key, n, conv):
        insert(root, k, (x, c))
    first, last = min(key), max(key)
    # the last key's node has children in the next range if the next key begins with all of it
    extended = hashlib.md5(last).digest() if after * WIDTH == len(last) else None
    t = Trie(root, prefixes(first, before), prefixes(last, after), extended)
    up = [(t.id[p], t.conv[p], t.border[p]) if p >= 0 else (None, None, False) for p in t.parent]
    cols = [t.id, [u[0] for u in up], t.depth, t.conv, [None if u[2] else u[1] for u in up], t.convs, t.children, t.leaves, t.saved, t.border, [u[2] for u in up]]
    kinds = [pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.bool_(), pa.bool_()]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in NODE.split(", ")])


def keyed(conversations: DataFrame) -> DataFrame:
    """(conv_id, key): the turn ids of every conversation in order of turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    turn = F.concat(F.substring(F.sha2(said, 256), 1, 32), F.lpad(F.hex(F.octet_length(text)), 8, "0"))
    rows = conversations.select("conv_id", F.struct(F.col("turn").isNotNull().alias("dated"), F.col("turn").alias("turn"), turn.alias("id")).alias("t"))
    got = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return got.select("conv_id", F.unhex(F.array_join(F.transform("t", lambda x: x["id"]), "")).alias("key"))


def rebuilt(keys: DataFrame, step: int = 5, most: int = 9) -> DataFrame:
    """(conv_id, key): the first turns of conversation c - c % step, then c's own after as many."""
    part = lambda k, begin, size: F.substring(k, begin, size)
    h = (crc_text(F.col("conv_id")) % most * WIDTH).cast("int")
    heads = keys.where(f"conv_id % {step} = 0").select(F.col("conv_id").alias("base"), part(F.col("key"), F.lit(1), F.lit((most - 1) * WIDTH)).alias("head"))
    own = keys.select("conv_id", "key", (F.col("conv_id") - F.col("conv_id") % step).alias("base"), h.alias("h"))
    both = own.join(heads, "base", "left")
    head = F.coalesce(part(F.col("head"), F.lit(1), F.col("h")), F.lit(b""))
    return both.select("conv_id", F.concat(head, part(F.col("key"), F.col("h") + 1, F.octet_length("key"))).alias("key"))


def shared_turns(a: Column, b: Column) -> Column:
    """Turns that two keys have in common from the beginning; -1 if one of them is null."""

    @F.arrow_udf("long")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        def count(x: bytes | None, y: bytes | None) -> int:
            if x is None or y is None:
                return -1
            n = min(len(x), len(y)) // WIDTH
            return next((d for d in range(n) if x[d * WIDTH : (d + 1) * WIDTH] != y[d * WIDTH : (d + 1) * WIDTH]), n)

        for x, y in batches:
            yield pa.array([count(*p) for p in zip(x.to_pylist(), y.to_pylist())], pa.int64())

    return run(a, b)


def ends(members: DataFrame) -> DataFrame:
    """(id, ends_sha256): the conversations that end in a node, in pieces of ids that stream through its hash in order."""
    rows = members.select(F.unhex(F.md5("key")).alias("id"), "conv_id", F.shiftright("conv_id", PIECE_BITS).alias("piece"))
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string"))
    pieces = rows.groupBy("id", "piece").agg(F.array_join(ids, ",").alias("ids"))
    pieces = pieces.repartition("id").sortWithinPartitions("id", "piece").select("id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h, empty = None, None, True
        done: list[tuple[bytes, str]] = []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], ["id", "ends_sha256"])
        for b in batches:
            for node, ids in zip(b.column("id").to_pylist(), b.column("ids").to_pylist()):
                if node != now:
                    if h:
                        done.append((now, h.hexdigest()))
                    now, h, empty = node, hashlib.sha256(), True
                if ids:
                    h.update(("" if empty else ",").encode() + ids.encode())
                    empty = False
            yield batch()
            done.clear()
        if h:
            done.append((now, h.hexdigest()))
            yield batch()

    return pieces.mapInArrow(run, "id binary, ends_sha256 string")


def nodes(members: DataFrame, ranges: int | None = None, range_bytes: int = 32 << 20) -> DataFrame:
    """The trie of (conv_id, key) rows: one row per node. ``ranges`` defaults to the session's shuffle partitions, or as many as keep a
    range of distinct keys below ``range_bytes``."""
    spark = members.sparkSession
    members = store(members, "trie-members")
    keys = store(members.groupBy("key").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv")), "trie-keys")
    if ranges is None:
        size = keys.agg(F.sum(F.octet_length("key").cast("long"))).first()[0] or 0
        ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // range_bytes + 1)
    keys = store(keys.repartitionByRange(ranges, "key").withColumn("part", F.spark_partition_id()), "trie-ranges")
    # one row per range
    side = Window.orderBy("part")
    edge = keys.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    edge = edge.select("part", "first", "last", F.lag("last").over(side).alias("left"), F.lead("first").over(side).alias("right"))
    edge = store(edge.select("part", shared_turns(F.col("left"), F.col("first")).alias("before"), shared_turns(F.col("last"), F.col("right")).alias("after")), "trie-edges")
    found = store(keys.join(F.broadcast(edge), "part").groupBy("part").applyInArrow(grow, NODE), "trie-nodes")

    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    same = [F.max(c).alias(c) for c in ("parent_id", "depth", "parent_border")]
    border = found.where("border").groupBy("id").agg(F.min("conv_id").alias("conv_id"), *sums, *same)
    border = store(border.withColumn("parent_conv_id", F.lit(None).cast("long")).withColumn("border", F.lit(True)).select(*found.columns), "trie-border")
    every = found.where("not border").unionByName(border)
    up = border.select(F.col("id").alias("parent_id"), F.col("conv_id").alias("up"))
    below = every.where("parent_border").join(up, "parent_id").withColumn("parent_conv_id", F.col("up")).select(*found.columns)
    every = every.where("not parent_border").unionByName(below)
    got = every.join(ends(members), "id", "left")
    return got.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    )


def prefix_trie(conversations: DataFrame, ranges: int | None = None) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return nodes(rebuilt(keyed(conversations)), ranges)
