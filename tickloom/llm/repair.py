"""Conversation structure repair by bidirectional Dijkstra over the edit lattice.

A repaired conversation has the roles ``(s?(ua)+)?``. The lattice's nodes are (rows read, last role); its edges are the edits:
Keep, Rerole to user or assistant, Delete, Insert an empty turn. What a state may be followed by fixes the role a Rerole
or an Insert gives, so an audit, the string of the edits' initials, names one repair. Two heaps search from the beginning and from the accepted
ends; they stop when their least costs add up to more than the cheapest meeting, so every crossing of equal cost is finished.
Among the cheapest audits through these crossings the least in ASCII is taken: the forward half is walked over nodes
that lead to a crossing, the reverse half along its tight edges, smallest letter first. That takes time in proportion to the turns (times the logarithm).

Only one number per turn goes into a search. The texts are exchanged once, sorted by conversation and turn behind the
audit, and hashed as they stream by: no task holds the texts of a conversation, however long it is. Its turns must be
read in one task, as a digest over them is sequential.

Null roles and texts are one blank; a null conv_id is a conversation, a null turn comes first. Rows of one turn are ordered by role and the text's
SHA-256. Repeated rows are turns of their own (and duplicates). Columns beyond the four are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import BLANKS, crc_text

KEEP, REROLE, DELETE, INSERT = "KRDI"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED = 5
#: States are the last role: none, s, u, a. What may follow, and the role that a Rerole or Insert gives.
NEXT = (2, 2, 3, 2)
AFTER = {"s": (0,), "u": (0, 1, 3), "a": (2,)}
STATE = {"s": 1, "u": 2, "a": 3}
ROLE = ("", "system", "user", "assistant")
ENDS = (0, 3)
#: A turn as one number: 4 * fault + role's state (0 if it is none of the three).
FAULTS = ("", "blank", "duplicate", "truncated")


class Lattice:
    """Edges of the edit lattice over coded turns; a node is 4 * rows read + state."""

    def __init__(self, turns: np.ndarray):
        self.n = len(turns)
        self.role = (turns % 4).tolist()
        fault = turns // 4
        self.gone = ((fault == 1) | (fault == 2)).tolist()
        self.extra = np.where(fault == 3, TRUNCATED, 0).tolist()

    def ahead(self, node: int) -> list[tuple[str, int, int]]:
        """(edit, cost, node after it), by letter: what leaves a node."""
        i, s = divmod(node, 4)
        out = [(INSERT, COST[INSERT], 4 * i + NEXT[s])]
        if i < self.n:
            out.insert(0, (DELETE, COST[DELETE], node + 4))
            if not self.gone[i]:
                r, x = self.role[i], self.extra[i]
                if r and s in AFTER["sua"[r - 1]]:
                    out.append((KEEP, x, 4 * i + 4 + r))
                out.append((REROLE, COST[REROLE] + x, 4 * i + 4 + NEXT[s]))
        return out

    def behind(self, node: int) -> list[tuple[int, int]]:
        """(cost, node before): what reaches a node."""
        i, s = divmod(node, 4)
        before = [p for p in range(4) if NEXT[p] == s]
        out = [(COST[INSERT], 4 * i + p) for p in before]
        if i:
            out.append((COST[DELETE], node - 4))
            if not self.gone[i - 1]:
                x = self.extra[i - 1]
                out += [(COST[REROLE] + x, 4 * i - 4 + p) for p in before]
                if s and self.role[i - 1] == s:
                    out += [(x, 4 * i - 4 + p) for p in AFTER["sua"[s - 1]]]
        return out


def search(turns: np.ndarray) -> tuple[int, str]:
    """Least cost and its least audit."""
    g = Lattice(turns)
    far = 1 << 60
    ahead, behind = {0: 0}, {4 * g.n + s: 0 for s in ENDS}
    heaps = [[(0, 0)], [(0, 4 * g.n + s) for s in ENDS]]
    best = 0 if not g.n else far
    while heaps[0] and heaps[1] and heaps[0][0][0] + heaps[1][0][0] <= best:
        forward = heaps[0][0][0] <= heaps[1][0][0]
        mine, other, heap = (ahead, behind, heaps[0]) if forward else (behind, ahead, heaps[1])
        d, node = heappop(heap)
        if d > mine[node]:
            continue
        for c, to in [(c, to) for _, c, to in g.ahead(node)] if forward else g.behind(node):
            if d + c < mine.get(to, far):
                mine[to] = d + c
                heappush(heap, (d + c, to))
            best = min(best, mine[to] + other.get(to, far))
    # nodes nearer than the heaps' tops are final on their side, and every cheapest way leaves one kind for the other
    tops = [h[0][0] if h else far for h in heaps]
    left = lambda v: behind[v] if behind.get(v, far) < tops[1] else None
    mark = {v for v, d in ahead.items() if d + (0 if v >= 4 * g.n and v % 4 in ENDS else far if left(v) is None else behind[v]) == best}
    todo = list(mark)
    while todo:
        v = todo.pop()
        for c, u in g.behind(v):
            if u not in mark and ahead.get(u, far) < tops[0] and ahead[u] + c == ahead[v]:
                mark.add(u)
                todo.append(u)
    audit, node, spent = [], 0, 0
    while not (node >= 4 * g.n and node % 4 in ENDS and spent == best):
        for edit, c, to in g.ahead(node):
            rest = left(to)
            if spent + c + rest == best if rest is not None else to in mark and spent + c == ahead[to]:
                audit.append(edit)
                node, spent = to, spent + c
                break
        else:
            raise AssertionError("a cheapest way ends before its cost is spent")
    return best, "".join(audit)


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, times): rows after the contract's damage; ``times`` is 0, 1 or 2 copies."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    d = crc_text(F.concat(blank(F.col("conv_id")), F.lit(":"), blank(F.col("turn")))) % 20
    text = F.when(d == 1, F.lit("")).when(d == 2, F.regexp_replace(blank(F.col("text")), "[.!?]+", "")).otherwise(blank(F.col("text")))
    return conversations.select(
        "conv_id", "turn", F.when(d == 4, F.lit("user")).otherwise(blank(F.col("role"))).alias("role"), text.alias("text"), F.when(d == 0, 0).when(d == 3, 2).otherwise(1).alias("times"),
    )


def sha(text: Column) -> Column:
    return F.coalesce(F.unhex(F.sha2(text.cast("binary"), 256)), F.lit(b""))


def audits(rows: DataFrame) -> DataFrame:
    """One row per conversation: gaps, counts of faults, illegal pairs, cost and audit; the texts stay behind."""
    end = F.rtrim(F.col("text"), F.lit(" " + BLANKS))
    state = F.coalesce(*[F.when(F.substring("role", 1, 1) == r, F.lit(s)) for r, s in STATE.items()], F.lit(0))
    fault = F.when(end == "", 1).when(~F.right(end, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    keys = rows.select("conv_id", "turn", "role", sha(F.col("text")).alias("sha"), "times", state.alias("state"), fault.alias("fault"))
    keys = keys.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest("times", F.lit(1)))))
    # dropped rows come last, so that neighbours and places are those after damage
    order = Window.partitionBy("conv_id").orderBy(F.col("times") == 0, F.asc_nulls_first("turn"), "role", "sha", "copy")
    keys = keys.withColumn("place", F.row_number().over(order)).withColumn("before", F.lag("state").over(order))
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "sha", F.col("times") == 0).orderBy("place")) > 1
    here = F.col("times") > 0
    keys = keys.withColumn("fault", F.when((F.col("fault") != 1) & again, 2).otherwise(F.col("fault")))
    legal = (4 * F.col("before") + F.col("state")).isin(*[4 * STATE[a] + STATE[b] for a, b in ("su", "ua", "au")])
    count = lambda k: F.count(F.when(here & (F.col("fault") == k), 1)).alias(FAULTS[k])
    turn = F.when(here, F.col("turn"))
    got = keys.groupBy("conv_id").agg(
        F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn), F.lit(0)).alias("gaps"), count(1), count(2), count(3),
        F.count(F.when(here & (F.col("place") > 1) & ~legal, 1)).alias("illegal"),
        F.array_sort(F.collect_list(F.when(here, F.struct("place", (4 * F.col("fault") + F.col("state")).cast("byte").alias("code"))))).alias("codes"),
    )

    @F.arrow_udf("struct<cost:long,audit:string>")
    def solve(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            found = [search(x.values.to_numpy()) for x in b]
            yield pa.array([{"cost": c, "audit": a} for c, a in found], pa.struct([("cost", pa.int64()), ("audit", pa.string())]))

    return got.withColumn("s", solve(F.transform("codes", lambda x: x["code"]))).select("conv_id", "gaps", *FAULTS[1:], "illegal", "s.cost", "s.audit")


def repair(conversations: DataFrame) -> DataFrame:
    """Per conversation: counts, cost, audit and the SHA-256 of the repaired turns, ``role:text`` joined by newlines."""
    rows = damage(conversations)
    found = audits(rows)
    facts = [c for c in found.columns if c != "conv_id"]
    head = found.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(0).alias("times"), F.struct(*facts).alias("facts"))
    body = rows.where("times > 0").select("conv_id", F.lit(1).alias("kind"), F.col("turn").cast("long").alias("turn"), "role", "text", "times", F.lit(None).cast(head.schema["facts"].dataType).alias("facts"))
    both = head.unionByName(body).withColumn("sha", F.when(F.col("kind") == 1, sha(F.col("text"))))
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.asc_nulls_first("turn"), "role", "sha").drop("sha", "turn")
    kinds = {"conv_id": "long", "gaps": "long", **dict.fromkeys(FAULTS[1:], "long"), "illegal": "long", "cost": "long", "audit": "string", "repaired_sha256": "string"}
    return both.mapInArrow(digest, ", ".join(f"{c} {t}" for c, t in kinds.items()))


def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replays audits on the turns that follow them; holds one batch, one audit and the running hashes."""
    facts, h, at, state, empty, out = None, None, 0, 0, True, []

    def say(role: str, text: str) -> None:
        nonlocal empty
        h.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
        empty = False

    def inserts() -> None:
        nonlocal at, state
        while at < len(facts["audit"]) and facts["audit"][at] == INSERT:
            state, at = NEXT[state], at + 1
            say(ROLE[state], "")

    def done() -> None:
        if facts is not None:
            inserts()
            out.append({**facts, "repaired_sha256": h.hexdigest()})

    def flush() -> pa.RecordBatch:
        names = ["conv_id", "gaps", *FAULTS[1:], "illegal", "cost", "audit", "repaired_sha256"]
        kinds = [pa.string() if c in ("audit", "repaired_sha256") else pa.int64() for c in names]
        got = pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], k) for c, k in zip(names, kinds)], names)
        out.clear()
        return got

    for b in batches:
        cols = [b.column(c) for c in ("conv_id", "kind", "role", "text", "times", "facts")]
        for conv, kind, role, text, times, fact in zip(*[c.to_pylist() for c in cols]):
            if kind == 0:
                done()
                facts, h, at, state, empty = {"conv_id": conv, **fact}, hashlib.sha256(), 0, 0, True
                continue
            for _ in range(times):
                inserts()
                edit, at = facts["audit"][at], at + 1
                if edit == REROLE:
                    state = NEXT[state]
                    say(ROLE[state], text)
                elif edit == KEEP:
                    state = STATE[role[0]]
                    say(role, text)
        if out:
            yield flush()
    done()
    if out:
        yield flush()
