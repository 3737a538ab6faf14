"""Prefix trie of conversations by double arrays.

Every turn becomes a record of 20 bytes (16 of the SHA-256 of role and text, 4 for the number
of words), every conversation the string of its records in order of turns, cut into pieces of
PIECE turns. Pieces begin with a record that names the prefix before them (zero for the
first), so a conversation of any length is a chain of bounded pieces. Equal pieces are counted
once, before the shuffle. Distinct pieces are range-partitioned by their bytes: a range is a
prefix shard, and runs of NODES records of it are packed as tries: dense ids for the records,
BASE and CHECK over them, node t being the child of s under id c where t = BASE[s] + c and
CHECK[t] = s. Walking the arrays gives each node's members, CHECK its parent, from which
counts and subtree sums follow. Nodes that a trie shares with its neighbours (prefixes of
its first and last piece) are keyed by a digest and merged globally; each is counted as a
node by the first trie that holds it, so all sums add up. Sums below pieces that go on come
from their continuations by pointer doubling over the pieces' names.

The ids of the conversations that end at a node are sorted, joined in chunks where they lie and
hashed as a stream, for SHA-256 reads in order; a hot node costs a few rows of text.

Defined cases: rows with a null conv_id are left out; equal turn numbers are ordered by role,
the first TIE characters of the text, then its digest, repeated rows count as turns of their
own; null roles and texts are as empty ones; texts are read whole; an empty table gives an
empty table; extra columns are not read."""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concordia.llm.common import ship, stage

RECORD = 20
PIECE = 256  # turns a piece: 5 KB at most
NODES = 200_000  # records a trie
ROWS_A_RANGE = 200_000
RANGES = 20_000  # at most so many ranges, so a few numbers of each fit the driver
CHUNK = 1 << 20  # bytes of joined ids a row
TIE = 16
ROOT = bytes(RECORD)
WINDOW = 256
EMPTY = hashlib.sha256(b"").hexdigest()


# ---- turns to pieces ----------------------------------------------------------------------------------
def rebuilt_heads(turns: DataFrame, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(conv, total, skip, lent) of every conversation: its length, how many of its own first
    turns fall away, how many of the other conversation's come in; and those (conv, pos, rec)."""
    sizes = stage(turns.groupBy("conv").agg(F.count("*").alias("n")), "conv-sizes")
    lenders = sizes.where("conv % 20 = 0").select(F.col("conv").alias("lender"), F.col("n").alias("lender_n"))
    skip = F.crc32(F.col("conv").cast("string").cast("binary")) % 4
    known = (sizes.withColumn("lender", F.col("conv") - F.col("conv") % 20).join(lenders, "lender", "left")
             .withColumn("skip", skip).withColumn("lent", F.least("skip", F.coalesce("lender_n", F.lit(0))))
             .withColumn("total", F.col("lent") + F.greatest(F.lit(0), F.col("n") - F.col("skip"))))
    first = (turns.where("conv % 20 = 0").withColumn("pos", F.row_number().over(Window.partitionBy("conv").orderBy(*order)))
             .where("pos <= 3").select(F.col("conv").alias("lender"), F.col("pos").cast("long").alias("pos"), "rec"))
    return known, known.join(first, "lender").where("pos <= lent").select("conv", "pos", "rec")


def own_heads(turns: DataFrame, order: list[Column]) -> tuple[DataFrame, None]:
    """The same for conversations as they are."""
    sizes = turns.groupBy("conv").agg(F.count("*").alias("total"))
    return sizes.select("conv", "total", F.lit(0).cast("long").alias("skip"), F.lit(0).cast("long").alias("lent")), None


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to packed runs: one row a conversation and task (or PIECE * 64 turns)."""
    task = TaskContext.get().partitionId()
    names = ["task", "conv", "total", "skip", "lent", "n_lent", "before", "recs"]
    kinds = [pa.int64()] * 7 + [pa.binary()]
    out: list[tuple] = []

    def cut() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
        out.clear()
        return made

    at, head, n_lent, before, recs, size = None, (None, None, None), 0, 0, [], 0

    def close() -> None:
        nonlocal n_lent, before, recs, size
        out.append((task, at, *head, n_lent, before, b"".join(recs)))
        before += len(recs) - n_lent
        size += len(recs)
        n_lent, recs = 0, []

    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(6)]
        for conv, part, rec, total, skip, lent in zip(*cols):
            if conv != at:
                if at is not None:
                    close()
                at, head, before = conv, (None, None, None), 0
            if part == 0:
                head = total, skip, lent
                continue
            recs.append(rec)
            n_lent += part == 1
            if len(recs) >= PIECE * 64:
                close()
        if size > ROWS_A_RANGE // 8 or len(out) > 8192:
            size = 0
            yield cut()
    if at is not None:
        close()
    if out:
        yield cut()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs with known offsets to parts of pieces (conv, layer, first, whole, last, long, recs)."""
    for batch in batches:
        out = []
        for conv, total, skip, lent, n_lent, before, lent_before, begins, recs in zip(*(c.to_pylist() for c in batch.columns)):
            # turns lent come first, then own ones from the skip-th on
            mine = max(0, min(skip - before, len(recs) // RECORD - n_lent))
            kept = recs[:n_lent * RECORD] + recs[(n_lent + mine) * RECORD:]
            first = lent_before if n_lent else lent + max(0, before - skip)
            n = len(kept) // RECORD
            if not n and (total or not begins):
                continue
            last_layer = max(0, total - 1) // PIECE
            at = 0
            while True:
                layer = (first + at) // PIECE
                to = min(n, (layer + 1) * PIECE - first)
                end = min(total, (layer + 1) * PIECE)
                whole = first + at == layer * PIECE and first + to == end
                out.append((conv, layer, first + at, whole, layer == last_layer, total > PIECE, kept[at * RECORD:to * RECORD]))
                at = to
                if at >= n:
                    break
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.binary()]
        cols = list(zip(*out)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["conv", "layer", "first", "whole", "last", "long", "recs"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [b"".join(p["recs"] for p in ps) for ps in batch.column(4).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(parts, pa.binary())], ["conv", "layer", "last", "long", "recs"])


def pieces(rows: DataFrame, heads: Callable) -> DataFrame:
    """Staged (conv, layer, last, long, recs) of conversations (conv, turn, role, text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    words = F.lpad(F.hex(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))), 8, "0")
    turns = stage(rows.where("conv is not null").select("conv", "turn", role.alias("role"), F.substring(text, 1, TIE).alias("tie"),
                                                        F.unhex(F.concat(digest, words)).alias("rec")), "turns")
    order = ["turn", "role", "tie", "rec"]
    known, lent = heads(turns, [F.col(c).asc_nulls_first() for c in order])
    none = {"pos": "long", "turn": turns.schema["turn"].dataType, "role": "string", "tie": "string", "rec": "binary", "total": "long", "skip": "long", "lent": "long"}

    def laid(df: DataFrame, part: int, *has: str) -> DataFrame:
        return df.select("conv", F.lit(part).alias("part"), *(F.col(c).cast(k).alias(c) if c in has else F.lit(None).cast(k).alias(c) for c, k in none.items()))

    everything = laid(known, 0, "total", "skip", "lent").union(laid(turns, 2, *order))
    everything = everything.union(laid(lent, 1, "pos", "rec")) if lent is not None else everything
    ranges = min(RANGES, 1 + turns.count() // ROWS_A_RANGE)
    keys = ["conv", "part", "pos", *order]
    runs = stage(everything.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
                 .select("conv", "part", "rec", "total", "skip", "lent")
                 .mapInArrow(_runs, "task long, conv long, total long, skip long, lent long, n_lent long, before long, recs binary"), "runs")
    # a conversation that goes on in another range: its last run in each range but the last, and the
    # first in each but the first; a row a range at most, so small enough to broadcast
    n_own = (F.octet_length("recs") / RECORD).cast("long") - F.col("n_lent")
    per = runs.groupBy("conv", "task").agg(F.sum("n_lent").alias("l"), F.sum(n_own).alias("o"), *(F.max(c).alias(c) for c in ("total", "skip", "lent")))
    several = per.groupBy("conv").agg(F.count("*").alias("k")).where("k > 1").select("conv")
    prior = Window.partitionBy("conv").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    carry = (per.join(several, "conv").select("conv", "task", *(F.max(c).over(prior).alias(f"c_{c}") for c in ("total", "skip", "lent")),
                                              F.sum("l").over(prior).alias("c_l"), F.sum("o").over(prior).alias("c_o")).where("c_total is not null"))
    carried = runs.join(F.broadcast(stage(carry, "carry")), ["conv", "task"], "left")
    ready = carried.select("conv", *(F.coalesce(c, f"c_{c}").alias(c) for c in ("total", "skip", "lent")), "n_lent",
                           (F.col("before") + F.coalesce("c_o", F.lit(0))).alias("before"), F.coalesce("c_l", F.lit(0)).alias("lent_before"),
                           F.col("total").isNotNull().alias("begins"), "recs")
    parts = stage(ready.mapInArrow(_pieces, "conv long, layer long, first long, whole boolean, last boolean, long boolean, recs binary"), "piece-parts")
    split = (parts.where("not whole").groupBy("conv", "layer", "last", "long")
             .agg(F.sort_array(F.collect_list(F.struct("first", "recs"))).alias("parts")))  # PIECE records at most
    joined = split.mapInArrow(_joined, "conv long, layer long, last boolean, long boolean, recs binary")
    return stage(parts.where("whole").select("conv", "layer", "last", "long", "recs").union(joined), "pieces")


def named(pieces: DataFrame) -> DataFrame:
    """(conv, layer, last, path, next): pieces after the record that names their prefix, and the
    name of what follows. A name joins digests of the pieces before by exclusive or."""
    short = pieces.where("not long").select("conv", "layer", "last", F.concat(F.lit(ROOT), "recs").alias("path"), F.lit(None).cast("binary").alias("next"))
    if pieces.where("long").isEmpty():
        return short
    sha = F.sha2(F.concat(F.col("layer").cast("string").cast("binary"), F.lit(b":"), F.col("recs")), 256)
    prior = Window.partitionBy("conv").orderBy("layer").rowsBetween(Window.unboundedPreceding, -1)
    digests = pieces.where("long").select("conv", "layer", *(F.conv(F.substring(sha, a, 15), 16, 10).cast("long").alias(d) for a, d in ((1, "d1"), (16, "d2"))))
    names = digests.select("conv", "layer", "d1", "d2", *(F.coalesce(F.bit_xor(d).over(prior), F.lit(0)).alias(r) for d, r in (("d1", "r1"), ("d2", "r2"))))

    def name(a: Column, b: Column) -> Column:
        return F.unhex(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0"), F.lit("0" * 8)))

    long = pieces.where("long").join(names, ["conv", "layer"]).select(
        "conv", "layer", "last", F.concat(name(F.col("r1"), F.col("r2")), "recs").alias("path"),
        F.when(~F.col("last"), name(F.col("r1").bitwiseXOR(F.col("d1")), F.col("r2").bitwiseXOR(F.col("d2")))).alias("next"))
    return stage(short.union(long), "named")


# ---- ends ----------------------------------------------------------------------------------------------
def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (pk, conv): the digest of every run inside, joined ids of the first and last run,
    which may go on in other tasks."""
    at, ids, size, first, opening, out = None, [], 0, None, True, []

    def batch_of() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), [pa.binary(), pa.int64(), pa.binary(), pa.string()])], ["pk", "first", "ids", "sha"])
        out.clear()
        return made

    def close(whole: bool) -> None:
        nonlocal ids, size, first
        text = b",".join(ids)
        out.append((at, first, None, hashlib.sha256(text).hexdigest()) if whole else (at, first, text, None))
        ids, size, first = [], 0, None

    cut = False  # the run has been closed in part
    for batch in batches:
        for pk, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if pk != at:
                if at is not None and ids:
                    close(not opening and not cut)
                opening, cut = at is None, False
                at = pk
            if first is None:
                first = conv
            ids.append(b"%d" % conv)
            size += len(ids[-1]) + 1
            if size >= CHUNK:
                close(False)
                cut = True
        if len(out) > 4096 or sum(len(o[2] or b"") for o in out[-64:]) > CHUNK:
            yield batch_of()
    if ids:
        close(False)
    if out:
        yield batch_of()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (pk, first, ids): the digest over each pk's chunks, as a stream."""
    at, sha, out = None, None, []
    for batch in batches:
        for pk, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if pk != at:
                if at is not None:
                    out.append((at, sha.hexdigest()))
                at, sha = pk, hashlib.sha256(ids)
            else:
                sha.update(b"," + ids)
    if at is not None:
        out.append((at, sha.hexdigest()))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.binary()), pa.array([s for _, s in out], pa.string())], ["pk", "sha"])


def ends(last: DataFrame, ranges: int) -> DataFrame:
    """(pk, sha): the digest of the sorted ids that end at each piece."""
    some = stage(last.repartitionByRange(ranges, "pk", "conv").sortWithinPartitions("pk", "conv")
                 .mapInArrow(_chunks, "pk binary, first long, ids binary, sha string"), "end-ids")
    rest = (some.where("sha is null").select("pk", "first", "ids").repartition("pk").sortWithinPartitions("pk", "first")
            .mapInArrow(_hashed, "pk binary, sha string"))
    return some.where("sha is not null").select("pk", "sha").union(rest)


# ---- tries ---------------------------------------------------------------------------------------------
def pack(parents: np.ndarray, codes: np.ndarray, ids: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BASE, CHECK and the slot of each node. Node i + 1 is the child of ``parents[i]`` under the
    dense id ``codes[i]``; node 0 is the root, in slot 0. Wide nodes are placed first: from the
    lowest free slot, near the node before, or behind all others; single children fill the gaps."""
    n = len(parents) + 1
    order = np.lexsort((codes, parents))
    fans = np.bincount(parents, minlength=n)
    begin = np.cumsum(fans) - fans
    used = np.zeros(2 * n + ids + 64, bool)
    used[0] = True
    base_of, child_slot = np.zeros(n, np.int64), np.zeros(n, np.int64)  # by node
    low, last, high = 1, 1, 1  # lowest free slot, where the last node went, end of what is used
    wide = np.flatnonzero(fans > 1)
    for p in wide[np.argsort(-fans[wide], kind="stable")].tolist():
        kids = order[begin[p]:begin[p] + fans[p]]
        want = codes[kids] - codes[kids[0]]
        if high + int(want[-1]) + WINDOW >= len(used):
            used = np.concatenate([used, np.zeros(len(used) + int(want[-1]) + WINDOW, bool)])
        for at in (low, *range(last, last + 4 * WINDOW, WINDOW), high):
            free = min(at, high) + np.flatnonzero(~used[min(at, high):min(at, high) + WINDOW])
            for w in want[1:]:
                free = free[~used[free + w]]
                if not len(free):
                    break
            if len(free):
                break
        slots = free[0] + want
        used[slots] = True
        child_slot[kids + 1] = slots
        base_of[p] = free[0] - codes[kids[0]]
        last, high = int(free[0]), max(high, int(slots[-1]) + 1)
        while used[low]:
            low += 1
    single = np.flatnonzero(fans == 1)
    kids = order[begin[single]]
    free = np.flatnonzero(~used)[:len(single)]
    if len(free) < len(single):
        free = np.concatenate([free, len(used) + np.arange(len(single) - len(free))])
    child_slot[kids + 1] = free
    base_of[single] = free - codes[kids]
    size = int(child_slot.max()) + 1
    base, check = np.zeros(size, np.int64), np.full(size, -1, np.int64)
    base[child_slot] = base_of
    check[child_slot[1:]] = child_slot[parents]
    return base, check, child_slot


def build(codes: np.ndarray, lens: np.ndarray, ids: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BASE, CHECK and the common prefix of each piece with the one before, of sorted distinct
    pieces of dense ids laid end to end."""
    k = len(lens)
    off = np.cumsum(lens) - lens
    owner = np.repeat(np.arange(k), lens)
    depth = np.arange(len(codes)) - off[owner]
    shared = np.zeros(k, np.int64)
    if k > 1:
        # places that differ from the same place in the piece before
        before = off[owner] - np.concatenate([[0], lens[:-1]])[owner] + depth
        inside = (owner > 0) & (depth < np.concatenate([[0], lens[:-1]])[owner])
        same = np.zeros(len(codes), bool)
        same[inside] = codes[inside] == codes[before[inside]]
        shared = np.minimum.reduceat(np.where(same, np.iinfo(np.int64).max, depth), off)
        shared = np.minimum(shared, lens)
    new = depth >= shared[owner]
    # the node of each record: of equal depth, the last new one up to here
    by_depth = np.argsort(depth, kind="stable")
    number = np.cumsum(new)  # nodes in order of the pieces; 0 is the root
    made = np.where(new[by_depth], number[by_depth], 0)
    at = np.maximum.accumulate(np.where(new[by_depth], np.arange(len(codes)), 0))
    node = np.zeros(len(codes), np.int64)
    node[by_depth] = made[at]
    parent = np.where(depth > 0, np.concatenate([[0], node[:-1]]), 0)
    base, check, _ = pack(parent[new], codes[new], ids)
    return base, check, shared


class Paths:
    """A run of sorted distinct pieces, packed as a trie and walked."""

    def __init__(self, rows: list[tuple], shared_before: int, shared_after: int):
        # rows: (path, layer, next, low, n, n_end, sha, more_leaves, more_saved)
        self.rows = rows
        data = np.frombuffer(b"".join(r[0] for r in rows), np.dtype((np.void, RECORD)))
        self.lens = np.array([len(r[0]) // RECORD for r in rows], np.int64)
        self.off = np.cumsum(self.lens) - self.lens
        distinct, first, inverse = np.unique(data, return_index=True, return_inverse=True)
        rank = np.empty(len(distinct), np.int64)
        rank[np.argsort(first, kind="stable")] = np.arange(len(distinct))  # dense ids in order of appearance
        self.codes = rank[inverse] + 1
        words = np.frombuffer(distinct.tobytes(), np.uint8).reshape(-1, RECORD)[:, 16:].astype(np.int64) @ np.array([1 << 24, 1 << 16, 1 << 8, 1])
        self.base, self.check, self.shared = build(self.codes, self.lens, len(distinct) + 1)
        self.words = np.zeros(len(distinct) + 1, np.int64)
        self.words[rank + 1] = words
        self.before, self.after = shared_before, shared_after
        self.slots = self.walk()

    def walk(self) -> np.ndarray:
        """Slot of every record, all pieces in step: t = BASE[s] + id, CHECK[t] = s."""
        slots = np.zeros(len(self.codes), np.int64)
        live, at = np.arange(len(self.lens)), np.zeros(len(self.lens), np.int64)
        for d in range(int(self.lens.max())):
            go = self.lens[live] > d
            live, at = live[go], at[go]
            place = self.off[live] + d
            to = self.base[at] + self.codes[place]
            if not np.array_equal(self.check[to], at):
                raise AssertionError("a piece is not in its trie")
            slots[place] = at = to
        return slots

    def nodes(self) -> dict[str, np.ndarray]:
        """Per slot: members, smallest conversation, children, and sums over the subtree."""
        size, slots = len(self.base), self.slots
        n, low = np.array([r[4] for r in self.rows], np.int64), np.array([r[3] for r in self.rows], np.int64)
        members, smallest = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max)
        np.add.at(members, slots, np.repeat(n, self.lens))
        np.minimum.at(smallest, slots, np.repeat(low, self.lens))
        depth, words, real = np.zeros(size, np.int64), np.zeros(size, np.int64), self.check >= 0
        depth[slots] = np.arange(len(slots)) - np.repeat(self.off, self.lens) + 1
        words[slots] = self.words[self.codes]
        owned = real.copy()
        owned[slots[:self.before]] = False  # an earlier trie counts them
        end = slots[self.off + self.lens - 1]
        leaf = np.array([r[4] == r[5] for r in self.rows]) & (np.append(self.shared[1:], self.after) < self.lens)
        leaves, saved = np.zeros(size, np.int64), members * words - np.where(owned, words, 0)
        leaves[end] += leaf
        leaves[end] += np.array([r[7] for r in self.rows], np.int64)
        saved[end] += np.array([r[8] for r in self.rows], np.int64)
        children = np.zeros(size, np.int64)
        mine = np.flatnonzero(owned)
        np.add.at(children, self.check[mine], 1)
        order = np.argsort(-depth, kind="stable")
        order = order[depth[order] > 0]
        for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if len(order) else []:
            np.add.at(leaves, self.check[level], leaves[level])
            np.add.at(saved, self.check[level], saved[level])
        return {"members": members, "low": smallest, "children": children, "leaves": leaves, "saved": saved, "depth": depth, "end": end}

    def names(self, layers: np.ndarray, top: np.ndarray) -> dict[int, bytes]:
        """Slot -> digest of the prefix, of nodes that other tries hold too."""
        out: dict[int, bytes] = {}
        for i, upto in ((0, self.before), (len(self.rows) - 1, self.after)):
            path, name = self.rows[i][0], b""
            for d in range(upto):
                rec = path[d * RECORD:(d + 1) * RECORD]
                name = hashlib.sha256(name + rec).digest()[:RECORD] if d else rec
                out[int(self.slots[self.off[i] + d])] = name
        for i in np.flatnonzero(top & (layers > 0)).tolist():  # prefixes that go on from another piece
            out[int(self.slots[self.off[i]])] = self.rows[i][0][:RECORD]
        for i, r in enumerate(self.rows):
            if r[2] is not None:
                out[int(self.slots[self.off[i] + self.lens[i] - 1])] = r[2]
        return out


NODE = ["name", "parent_name", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
NODE_KINDS = [pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.string()]
NODE_SCHEMA = ("name binary, parent_name binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
               "n_leaves long, saved_tokens long, ends_sha256 string")


def node_rows(paths: Paths) -> pa.RecordBatch:
    """A row a node; shared nodes bear names, and so does the parent of a node if it is shared."""
    v = paths.nodes()
    layers = np.array([r[1] for r in paths.rows], np.int64)
    top = paths.shared < 1  # pieces that open a top node
    names = paths.names(layers, top)
    slots = np.flatnonzero(paths.check >= 0)
    layer = np.zeros(len(paths.base), np.int64)
    layer[paths.slots] = np.repeat(layers, paths.lens)
    parent = paths.check[slots]
    is_top = parent == 0  # below the trie's own root
    again = is_top & (layer[slots] > 0)  # counted where the piece before ends
    zero = lambda x: np.where(again, 0, x[slots])
    sha: dict[int, str] = {int(s): r[6] for s, r in zip(v["end"], paths.rows) if r[6] is not None}
    place = slots.tolist()
    parents = [None if t else names.get(p) for p, t in zip(parent.tolist(), is_top.tolist())]
    known = np.array([p is None for p in parents]) & ~is_top
    return pa.RecordBatch.from_arrays([
        pa.array([names.get(s) for s in place], pa.binary()), pa.array(parents, pa.binary()), pa.array(v["low"][slots]),
        pa.array(layer[slots] * PIECE + v["depth"][slots] - 1), pa.array(v["low"][parent], mask=~known), pa.array(zero(v["members"])),
        pa.array(v["children"][slots]), pa.array(zero(v["leaves"])), pa.array(zero(v["saved"])), pa.array([sha.get(s) for s in place], pa.string())], NODE)


def sum_rows(paths: Paths) -> pa.RecordBatch | None:
    """(name, leaves, saved) below each prefix that goes on from another piece."""
    v = paths.nodes()
    tops = {int(paths.slots[o]): r[0][:RECORD] for o, r in zip(paths.off, paths.rows) if r[1] > 0}
    if not tops:
        return None
    at = np.array(list(tops))
    return pa.RecordBatch.from_arrays([pa.array(list(tops.values()), pa.binary()), pa.array(v["leaves"][at]), pa.array(v["saved"][at])], ["name", "leaves", "saved"])


def common(a: bytes, b: bytes) -> int:
    """Records that two paths have in common from the start."""
    n = min(len(a), len(b)) // RECORD
    if not n:
        return 0
    x, y = (np.frombuffer(p[:n * RECORD], np.uint8).reshape(n, RECORD) for p in (a, b))
    differ = np.flatnonzero((x != y).any(axis=1))
    return int(differ[0]) if len(differ) else n


def each_trie(batches: Iterator[pa.RecordBatch], edges: dict[int, tuple[int, int]], result: Callable) -> Iterator[pa.RecordBatch]:
    """Results of the tries of sorted rows (range, path, layer, next, low, n, n_end, sha, more_leaves, more_saved);
    ``edges``: records that a range shares with the ranges before and after it."""
    rows, size, at, shared = [], 0, None, 0

    def done(after: int) -> Iterator[pa.RecordBatch]:
        if rows and (found := result(Paths(rows, shared, after))) is not None:
            yield found

    for batch in batches:
        for of, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if of != at:
                if rows:
                    yield from done(edges[at][1])
                rows, size, at, shared = [], 0, of, edges[of][0]
            elif size >= NODES:
                cut = common(rows[-1][0], row[0])
                yield from done(cut)
                rows, size, shared = [], 0, cut
            rows.append(tuple(row))
            size += len(row[0]) // RECORD
    if rows:
        yield from done(edges[at][1])


def range_edges(dealt: DataFrame) -> dict[int, tuple[int, int]]:
    """Records that each range shares with its neighbours. RANGES ranges at most."""
    bounds = stage(dealt.groupBy("range").agg(F.min("path").alias("low"), F.max("path").alias("high")), "bounds")
    ranges = sorted(r.range for r in bounds.select("range").collect())
    if not ranges:
        return {}
    spark = dealt.sparkSession
    follow = spark.createDataFrame(list(zip(ranges, ranges[1:])) or [(-1, -1)], "range int, after int")
    pairs = (bounds.join(F.broadcast(follow), "range").select("range", "after", "high")
             .join(bounds.select(F.col("range").alias("after"), F.col("low").alias("next_low")), "after"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shared = [common(x, y) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shared, pa.int32())], ["range", "after", "shared"])

    found = pairs.select("range", "after", "high", "next_low").mapInArrow(run, "range int, after int, shared int").collect()
    before, after = {r.after: r.shared for r in found}, {r.range: r.shared for r in found}
    return {r: (before.get(r, 0), after.get(r, 0)) for r in ranges}


def below(dealt: DataFrame, walk: Callable) -> DataFrame:
    """(next, more_leaves, more_saved): sums over all that follows each name, by doubling: after
    j rounds a name has what lies less than 2^j pieces below, and points 2^j pieces up."""
    local = walk(sum_rows, "name binary, leaves long, saved long").groupBy("name").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    up = dealt.where("next is not null and layer > 0").select(F.col("next").alias("name"), F.substring("path", 1, RECORD).alias("up")).distinct()
    at = stage(local.join(up, "name", "left"), "below")
    while not at.where("up is not null").isEmpty():
        more = at.where("up is not null").groupBy(F.col("up").alias("name")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        higher = at.select(F.col("name").alias("up"), F.col("up").alias("higher"))
        at = stage(at.join(more, "name", "left").join(higher, "up", "left").select(
            "name", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"),
            F.col("higher").alias("up")), "below")
    return at.select(F.col("name").alias("next"), F.col("leaves").alias("more_leaves"), F.col("saved").alias("more_saved"))


def prefix_trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                heads: Callable = own_heads) -> DataFrame:
    """A row a node; ``heads`` says how conversations are rebuilt (own_heads: not at all)."""
    rows = conversations.select(F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"),
                                F.col(text).cast("string").alias("text"))
    made = named(pieces(rows, heads)).withColumn("pk", F.unhex(F.substring(F.sha2("path", 256), 1, 32)))
    distinct = stage(made.groupBy("pk", "path", "layer").agg(
        F.max("next").alias("next"), F.min("conv").alias("low"), F.count("*").alias("n"), F.count_if("last").alias("n_end")), "distinct-pieces")
    size = distinct.agg(F.sum(F.octet_length("path") / RECORD).alias("records"), F.sum("n_end").alias("ends")).first()
    ranges = min(RANGES, 1 + int((size.records or 0) // ROWS_A_RANGE))
    shas = ends(made.where("last").select("pk", "conv"), min(RANGES, 1 + int((size.ends or 0) // ROWS_A_RANGE)))
    dealt = stage(distinct.join(shas, "pk", "left").repartitionByRange(ranges, "path").select(
        F.spark_partition_id().alias("range"), "path", "layer", "next", "low", "n", "n_end", "sha"), "ranges")
    edges = range_edges(dealt)

    def walk(result: Callable, schema: str, more: DataFrame | None = None) -> DataFrame:
        zero = F.lit(0).cast("long")
        full = dealt if more is None else dealt.join(more, "next", "left")
        full = full.select("range", "path", "layer", "next", "low", "n", "n_end", "sha",
                           *(zero.alias(c) if more is None else F.coalesce(c, zero).alias(c) for c in ("more_leaves", "more_saved")))
        return (full.repartition(ranges, "range").sortWithinPartitions("range", "path")
                .mapInArrow(lambda batches: each_trie(batches, edges, result), schema))

    deep = not dealt.where("next is not null").isEmpty()
    nodes = stage(walk(node_rows, NODE_SCHEMA, below(dealt, walk) if deep else None), "nodes")
    merged = stage(nodes.where("name is not null").groupBy("name").agg(
        F.max("parent_name").alias("parent_name"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent_conv_id").alias("parent_conv_id"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.max("ends_sha256").alias("ends_sha256")).select(*NODE), "shared-nodes")
    everything = nodes.where("name is null").union(merged)
    parents = merged.select(F.col("name").alias("parent_name"), F.col("conv_id").alias("merged_parent"))
    out = [c for c in NODE if not c.endswith("name")]
    # the children of a hot node are a skewed key of a join with few rows on the other side
    named_parent = everything.where("parent_name is not null").join(parents, "parent_name", "left").withColumn("parent_conv_id", F.col("merged_parent"))
    return (everything.where("parent_name is null").select(*out).union(named_parent.select(*out))
            .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY))))


ship(__name__)
