"""Byte-level BPE encoding and decoding.

Pre-tokenisation runs without regular expressions. Every code point has a class; what a
class does to the scanner's state is a function on eight states, and such functions
compose associatively, so a prefix scan over blocks yields the state before every code
point and with it the token boundaries. The slices are merged by rank through a cache.

Defined cases: null and empty texts give no ids; bytes that are no UTF-8 count as U+FFFD;
a text of any length is scanned in windows that end at a boundary; repeated rows, ties and
extra columns (also of the result's name, which is replaced) are plain rows; an empty
table gives an empty table."""
from __future__ import annotations

import base64
import heapq
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordia.llm.common import as_texts, binary_array, byte_slices, list_array, release, ship

# Classes of code points. Apostrophes, spaces before a word and the last white space of a
# run depend on what follows and are told apart by shifted comparisons.
LETTER, NUMBER, OTHER, SHORT, LONG, PREFIX, LAST, SPACE, BREAK = range(9)
# What the scanner is in: nothing, a run of one class, a prefix space, a contraction with
# one or two letters to come.
NONE, IN_L, IN_N, IN_O, IN_W, IN_P, ONE, TWO = range(8)

# Fixed values of the public pattern: white space, and the letters after an apostrophe.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
               0x205F, 0x3000)
SHORT_FORMS = "stmd"
LONG_FORMS = ("re", "ve", "ll")

WINDOW = 1 << 20
BLOCK = 64
CACHE = 100_000  # about 30 MB
SLICE_BYTES = 1 << 20  # text in work at once; a longer text is one slice
TOGETHER = 64    # fewer new slices are merged one by one
WIDEST = 32      # as are slices of more bytes
NO_PAIR = 1 << 24


def _step(state: int, cls: int) -> tuple[int, bool]:
    """The state after a code point, and whether a token begins at it."""
    if cls == BREAK:
        return NONE, False
    if cls == LETTER:
        if state in (ONE, TWO):
            return (NONE if state == ONE else ONE), False
        return IN_L, state not in (IN_L, IN_P)
    if cls == NUMBER:
        return IN_N, state not in (IN_N, IN_P)
    if cls in (OTHER, SHORT, LONG):
        if state in (IN_O, IN_P):
            return IN_O, False
        return {OTHER: IN_O, SHORT: ONE, LONG: TWO}[cls], True
    if cls == PREFIX:
        return IN_P, True
    if cls == LAST:
        return NONE, True
    return IN_W, state != IN_W


def scanner() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The monoid that the classes generate on the states: element of each class, table of
    compositions (first, then second), state reached from each state, boundary table."""
    gens = [tuple(_step(s, c)[0] for s in range(8)) for c in range(9)]
    elems, index, todo = [tuple(range(8))], {tuple(range(8)): 0}, [tuple(range(8))]
    while todo:
        f = todo.pop()
        for g in gens:
            h = tuple(g[s] for s in f)
            if h not in index:
                index[h] = len(elems)
                elems.append(h)
                todo.append(h)
    comp = np.array([[index[tuple(g[s] for s in f)] for g in elems] for f in elems], np.uint8)
    assert len(elems) <= 256
    reach = np.array(elems, np.uint8)
    bound = np.array([[_step(s, c)[1] for c in range(9)] for s in range(8)])
    return np.array([index[g] for g in gens], np.uint8), comp, reach, bound


def class_table() -> bytes:
    """Class of every code point by general category, compressed (a few KB to ship)."""
    table = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            table[c] = LETTER if kind == "L" else NUMBER
    table[list(WHITE_SPACE)] = SPACE
    return zlib.compress(table.tobytes())


def _prefix_states(elems: np.ndarray, comp: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """State before each element, from NONE: compositions inside blocks, a scan over the
    blocks' totals by doubling, then one lookup per element."""
    n = len(elems)
    rows = -(-n // BLOCK)
    grid = np.zeros((rows, BLOCK), np.uint8)  # 0 is the identity
    grid.ravel()[:n] = elems
    grid = np.ascontiguousarray(grid.T)
    before = np.empty_like(grid)
    run = np.zeros(rows, np.uint8)
    flat, width = comp.ravel(), comp.shape[1]
    for k in range(BLOCK):
        before[k] = run
        run = flat[run.astype(np.intp) * width + grid[k]]
    total, shift = run, 1
    while shift < rows:  # inclusive scan of the blocks
        total = np.concatenate([total[:shift], comp[total[:-shift], total[shift:]]])
        shift *= 2
    start = np.concatenate([[0], total[:-1]]).astype(np.uint8)
    entry = reach[start, NONE]
    states = reach.ravel()[before.astype(np.intp) * 8 + entry]
    return states.T.ravel()[:n]


def boundaries(cp: np.ndarray, breaks: np.ndarray, table: np.ndarray, scan) -> np.ndarray:
    """True where a token begins. ``breaks``: positions of separators between texts."""
    gens, comp, reach, bound = scan
    n = len(cp)
    cls = table[cp]
    cls[breaks] = BREAK
    nxt = np.full(n + 2, BREAK, np.uint8)
    nxt[:n] = cls
    solid = (cls == SPACE) & (nxt[1:n + 1] != SPACE) & (nxt[1:n + 1] != BREAK)
    quote = np.flatnonzero((cp == 0x27) & (cls == OTHER))
    if len(quote):
        ext = np.zeros(n + 2, cp.dtype)
        ext[:n] = cp
        ext[breaks] = 0
        a, b = ext[quote + 1], ext[quote + 2]
        short = np.isin(a, [ord(x) for x in SHORT_FORMS])
        long = np.zeros(len(quote), bool)
        for x, y in LONG_FORMS:
            long |= (a == ord(x)) & (b == ord(y))
        cls[quote[short]] = SHORT
        cls[quote[long]] = LONG
    at = np.flatnonzero(solid)
    cls[at] = np.where(cp[at] == 0x20, PREFIX, LAST)
    states = _prefix_states(gens[cls], comp, reach)
    return bound.ravel()[states.astype(np.intp) * 9 + cls]


def slices(texts: list[str], table: np.ndarray, scan, window: int = WINDOW) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Token slices of the texts as UTF-8 bytes, with the text each belongs to, in runs of
    about ``window`` code points; a long text is cut where a token begins, at which the
    scanner can start anew."""
    for at, to in byte_slices(np.array([len(t) + 1 for t in texts]), window):
        if to == at + 1 and len(texts[at]) > window:
            text, size, pos = texts[at], window, 0
            while pos < len(text):
                part = text[pos:pos + size + 2]  # two code points to look ahead
                last = pos + len(part) >= len(text)
                cp = np.frombuffer(part.encode("utf-32-le", "replace"), "<u4")
                starts = np.flatnonzero(boundaries(cp, np.zeros(0, np.intp), table, scan))
                cut = len(part) if last else int(starts[starts <= size][-1])
                if not cut:
                    size *= 2  # one token fills the window
                    continue
                yield _cut(part[:cut], cp[:cut], starts[starts < cut], np.array([at]), np.array([0]))
                pos, size = pos + cut, window
            continue
        lens = np.array([len(t) for t in texts[at:to]])
        joined = "\n".join(texts[at:to]) + "\n"
        breaks = np.cumsum(lens + 1) - 1
        cp = np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4")
        starts = np.flatnonzero(boundaries(cp, breaks, table, scan))
        yield _cut(joined, cp, starts, np.arange(at, to), breaks - lens, breaks)


def _cut(text: str, cp: np.ndarray, starts: np.ndarray, rows: np.ndarray, firsts: np.ndarray,
         breaks: np.ndarray | None = None) -> tuple[list[bytes], np.ndarray]:
    width = 1 + (cp >= 0x80).astype(np.int8) + (cp >= 0x800) + (cp >= 0x10000)
    byte_at = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(width, out=byte_at[1:])
    data = text.encode("utf-8", "replace")
    ends = np.append(starts[1:], len(cp))
    row = np.searchsorted(firsts, starts, "right") - 1
    if breaks is not None and len(starts):
        ends = np.minimum(ends, breaks[row])
    a, b = byte_at[starts].tolist(), byte_at[ends].tolist()
    return [data[x:y] for x, y in zip(a, b)], rows[row]


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 and rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one slice: the adjacent pair of lowest rank (leftmost first) joins until none is left."""
    if (whole := ranks.get(piece)) is not None:
        return (whole,)
    if len(piece) <= 64:
        return _merge_short(piece, ranks)
    n = len(piece)
    right, left, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or (j := right[i]) >= n or end[j] != stop:
            continue
        alive[j] = False
        end[i], right[i] = stop, right[j]
        if right[i] < n:
            left[right[i]] = i
            if (r := ranks.get(piece[i:end[right[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[right[i]]))
        if (k := left[i]) >= 0 and (r := ranks.get(piece[k:stop])) is not None:
            heapq.heappush(heap, (r, k, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = right[i]
    return tuple(out)


def _merge_short(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The same on lists: quadratic, but quicker for the lengths that words have."""
    get, none = ranks.get, 1 << 60
    parts = [piece[i:i + 1] for i in range(len(piece))]
    pairs = [get(a + b, none) for a, b in zip(parts, parts[1:])]
    while pairs and (low := min(pairs)) != none:
        i = pairs.index(low)
        parts[i] += parts.pop(i + 1)
        del pairs[i]
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], none)
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], none)
    return tuple([ranks[x] for x in parts])


class Pairs:
    """Hash table from two adjacent ids to the id of both together (open addressing)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.pad = max(ranks.values()) + 1  # the id that stands for nothing
        self.byte = np.array([ranks.get(bytes([x]), self.pad) for x in range(256)], np.int32)
        get, found = ranks.get, []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                if (x := get(token[:i])) is not None and (y := get(token[i:])) is not None:
                    found.append((x, y, rank))
        x, y, rank = np.array(found, np.int64).reshape(-1, 3).T
        bits = max(10, (4 * len(x)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ids = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        key = x * (self.pad + 1) + y
        at, todo = self._home(key), np.arange(len(key))
        while len(todo):  # of the keys that want a free place one gets it, the others go on
            free = todo[self.keys[at[todo]] < 0]
            self.keys[at[free]] = key[free]
            todo = todo[self.keys[at[todo]] != key[todo]]
            at[todo] = (at[todo] + 1) & self.mask
        at, todo = self._home(key), np.arange(len(key))
        while len(todo):
            here = self.keys[at[todo]] == key[todo]
            self.ids[at[todo[here]]] = rank[todo[here]]
            todo = todo[~here]
            at[todo] = (at[todo] + 1) & self.mask

    def _home(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id of each pair, NO_PAIR where there is none."""
        key = (a.astype(np.int64) * (self.pad + 1) + b).ravel()
        at = self._home(key)
        seen = self.keys[at]
        hit = seen == key
        out = np.where(hit, self.ids[at], NO_PAIR).astype(np.int32)
        todo = np.flatnonzero(~hit & (seen >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            seen = self.keys[at[todo]]
            hit = seen == key[todo]
            out[todo[hit]] = self.ids[at[todo[hit]]]
            todo = todo[~hit & (seen >= 0)]
        return out.reshape(a.shape)

    def merge(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of slices of at most WIDEST bytes, of which none is a token: in each step every
        slice joins its pair of lowest rank, leftmost first."""
        out: list = [None] * len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data, stop = self.byte[np.frombuffer(b"".join(pieces), np.uint8)], np.cumsum(size)
        for low, width in ((0, 6), (6, 8), (8, 10), (10, 12), (12, 16), (16, WIDEST)):
            row = np.flatnonzero((size > low) & (size <= width))
            n = size[row].astype(np.int32)
            place = np.arange(width)[:, None]
            ids = np.where(place < n, data[np.minimum((stop - size)[row] + place, len(data) - 1)], self.pad)
            pair = self(ids[:-1], ids[1:])
            while len(row):
                best = pair[0] * WIDEST
                for j in range(1, width - 1):
                    np.minimum(best, pair[j] * WIDEST + j, out=best)
                done = best >= NO_PAIR * WIDEST
                if done.any():
                    for r, k, piece in zip(row[done].tolist(), n[done].tolist(), ids[:, done].T.tolist()):
                        out[r] = tuple(piece[:k])
                    live = ~done
                    row, n, best, ids, pair = row[live], n[live], best[live], ids[:, live], pair[:, live]
                    if not len(row):
                        break
                at, all_ = best % WIDEST, np.arange(len(row))
                ids[at, all_] = best // WIDEST
                n -= 1
                for j in range(1, width):  # what stands right of the joined pair moves up
                    after = at < j
                    np.copyto(ids[j], ids[j + 1] if j + 1 < width else self.pad, where=after)
                    if j < width - 1:
                        np.copyto(pair[j], pair[j + 1] if j + 1 < width - 1 else NO_PAIR, where=after)
                right = np.flatnonzero(at < width - 1)
                pair[at[right], right] = self(ids[at[right], right], ids[at[right] + 1, right])
                left = np.flatnonzero(at > 0)
                pair[at[left] - 1, left] = self(ids[at[left] - 1, left], ids[at[left], left])
        return out


class PieceIds(dict):
    """Ids of the slices seen so far; emptied when full, so its memory is bounded."""

    def __init__(self, ranks: dict[bytes, int], pairs: Pairs | None = None):
        super().__init__()
        self.ranks, self.pairs = ranks, pairs

    def learn(self, pieces: list[bytes]) -> None:
        """Take in the slices of a run that are not known yet."""
        new = set(pieces).difference(self)
        if len(new) < TOGETHER:
            return
        if len(self) + len(new) > CACHE:
            self.clear()
            new = set(pieces)
        ranks = self.ranks
        self.update((p, (ranks[p],)) for p in new if p in ranks)
        rest = [p for p in new if len(p) <= WIDEST and p not in ranks]
        if not self.pairs:
            self.pairs = Pairs(ranks)
        self.update(zip(rest, self.pairs.merge(rest)))

    def __missing__(self, piece: bytes) -> tuple[int, ...]:
        ids = merge(piece, self.ranks)
        if len(self) >= CACHE:
            self.clear()
        if len(piece) < 256:
            self[piece] = ids
        return ids


def encode_texts(texts: list[str], table: np.ndarray, scan, cache: PieceIds) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of the texts and the end of each text's ids."""
    ids, counts = [], np.zeros(len(texts), np.int64)
    for pieces, rows in slices(texts, table, scan):
        cache.learn(pieces)
        found = list(map(cache.__getitem__, pieces))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        counts += np.bincount(rows, sizes, len(texts)).astype(np.int64)
        ids.append(np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum())))
    return (np.concatenate(ids) if ids else np.zeros(0, np.int32)), np.cumsum(counts)


def vocabulary(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes in id order, each token's start among them, its length."""
    size = max(ranks.values()) + 1
    tokens = [b""] * size
    for token, rank in ranks.items():
        tokens[rank] = token
    lengths = np.array([len(t) for t in tokens], np.int64)
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(lengths) - lengths, lengths


def encode(df: DataFrame, ranks_path: str, text: str = "text", to: str = "bpe") -> DataFrame:
    """Add ``to``: struct(ids array<int>, ends array<int>), the ids of the text and the byte
    offset at which each token ends. The ranks' file must lie at ``ranks_path`` on the driver and
    on every machine that runs tasks; the table of pairs, a few MB whatever the input, is shipped."""
    packed, scan, pairs = class_table(), scanner(), Pairs(load_ranks(ranks_path))

    @F.arrow_udf("struct<ids: array<int>, ends: array<int>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ranks = load_ranks(ranks_path)
        lengths = vocabulary(ranks)[2]
        table = np.frombuffer(zlib.decompress(packed), np.uint8)
        cache = PieceIds(ranks, pairs)
        for batch in batches:  # results leave slice by slice, so none piles up
            sizes = pc.binary_length(batch.cast(pa.binary())).fill_null(0).to_numpy(zero_copy_only=False)
            for at, to_ in byte_slices(sizes + 1, SLICE_BYTES):
                ids, ends = encode_texts(as_texts(batch[at:to_]), table, scan, cache)
                offset = np.cumsum(lengths[ids])
                base = np.concatenate([[0], offset])[np.concatenate([[0], ends[:-1]])]
                offset -= np.repeat(base, np.diff(ends, prepend=0))
                yield pa.StructArray.from_arrays(
                    [list_array(ids, ends, pa.int32()), list_array(offset.astype(np.int32), ends, pa.int32())], ["ids", "ends"])
                del ids, ends, offset, base
        cache.clear()
        release()

    return df.withColumn(to, run(F.col(text)))


def decode(df: DataFrame, ranks_path: str, tokens: str = "bpe", to: str = "decoded") -> DataFrame:
    """Add ``to``: the bytes (binary) that the ids in column ``tokens`` stand for, gathered at
    the retained offsets. A null struct gives empty bytes; an unknown id raises."""

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        data, starts, lengths = vocabulary(load_ranks(ranks_path))
        for batch in batches:
            sizes = pc.list_value_length(batch.field("ids")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at, to_ in byte_slices(sizes * 4 + 1, SLICE_BYTES):
                ids_col, ends_col = batch[at:to_].flatten()
                ids, ends = ids_col.flatten().to_numpy(), ends_col.flatten().to_numpy().astype(np.int64)
                row_ends = np.cumsum(sizes[at:to_]).astype(np.int64)
                size = lengths[ids]
                total = np.concatenate([[0], np.cumsum(size)])[row_ends]
                base = np.repeat(np.concatenate([[0], total[:-1]]), np.diff(row_ends, prepend=0))
                shift = starts[ids] - (base + ends - size)  # where a token lies in data, less where it goes
                where = np.repeat(shift, size)
                where += np.arange(len(where))
                yield binary_array(data[where], total)
                del where, shift, base
        release()

    return df.withColumn(to, run(F.col(tokens)))


ship(__name__)
