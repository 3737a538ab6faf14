"""Benchmark decontamination.

A document holds a benchmark item where a window of as many words as the item has a weighted
similarity of 0.75 or more with it: the sum of smaller over the sum of larger counts of the
5-word shingles of both (of an item with fewer words, its whole sequence). Such a window
shares a shingle with the item, so windows are taken wherever one occurs, in whole texts. A
document of fewer words than the item is one window, as a whole.
Each window gets a 256-bit SimHash, from prefix sums of its shingles' signed bits. Two
fingerprints within a radius agree in one of sixteen blocks of 16 bits up to a sixteenth of
it, so the index over blocks misses none of them (of random pairs 47 % pass it, and next to
none the radius); what it yields is held to the radius and then to the exact similarity. The
radius is 5 standard deviations above the mean distance of the least cosine that the
threshold allows: 74 bits without repeated shingles, more where some repeat (`reach`).

The benchmark is read in blocks of a bounded size, one at a time: a block is shipped to the
tasks that scan the documents, and what they find is written before the next one is read.
Documents are neither shuffled nor sampled.

Defined cases: a null or word-less text or item matches nothing; repeated items of one text
count once; a null doc_id is a plain row; of equal windows the first is reported; extra
columns stay, and a column of the result's name is replaced; very long texts are scanned
whole; empty tables give no match."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordia.llm.common import as_bytes, byte_slices, drop_stage, mix64, ship, stage
from concordia.llm.minhash import WORDS, WordHashes, shingle_hashes, word_hashes

SIMILARITY = 0.75
DEVIATIONS = 5
PRINT_BITS = 256
BLOCKS = 16
BLOCK_BYTES = 8 << 20
MATCHES = "array<struct<item_id: bigint, start_word: bigint, n_words: bigint, similarity: double>>"
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1).astype(np.uint8)


def signed_bits(hashes: np.ndarray) -> np.ndarray:
    """One row of PRINT_BITS values, 1 or -1, for each hash."""
    words = np.stack([mix64(hashes ^ salt) for salt in mix64(np.arange(1, PRINT_BITS // 64 + 1, dtype=np.uint64))], axis=1)
    return np.unpackbits(words.view(np.uint8), axis=1).astype(np.int32) * 2 - 1


def fingerprint(sums: np.ndarray) -> np.ndarray:
    """The bytes of a fingerprint for each row of sums."""
    return np.packbits(sums > 0, axis=-1)


def reach(n: np.ndarray, repeats: np.ndarray, total: int, norm: float) -> np.ndarray:
    """Radius for windows of ``n`` shingles, at most ``repeats`` of them repeated, and items of
    ``total`` shingles whose squared counts sum up to ``norm`` at most. At the threshold the
    smaller counts sum up to a share of all, and so do their products at least; the squared
    counts of a window are the most if one shingle has all repeats."""
    least = SIMILARITY / (1 + SIMILARITY) * (n + total)
    most = n - repeats - 1 + (repeats + 1.0) ** 2
    p = np.arccos(np.minimum(1, least / np.sqrt(most * norm))) / np.pi
    return np.minimum(PRINT_BITS, PRINT_BITS * p + DEVIATIONS * np.sqrt(PRINT_BITS * p * (1 - p))).astype(np.int64)


class Items:
    """Items of one number of words: their shingles with counts, and the index of blocks."""

    def __init__(self, size: int, rows: list[tuple[int, np.ndarray]]):
        self.size, self.length = size, min(size, WORDS)
        self.ids = [i for i, _ in rows]
        self.shingles = [np.unique(shingle_hashes(w, self.length), return_counts=True) for _, w in rows]
        self.prints = np.concatenate([fingerprint((signed_bits(h) * c[:, None]).sum(axis=0, keepdims=True)) for h, c in self.shingles])
        self.norm = max(float((c.astype(np.float64) ** 2).sum()) for _, c in self.shingles)
        value = np.arange(256, dtype=np.uint8)
        self.bits = [BITS[value[:, None] ^ self.prints[None, :, b]] for b in range(PRINT_BITS // 8)]  # byte x item

    def candidates(self, prints: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) within the window's radius, the nearest first."""
        some = np.zeros((len(prints), len(self.ids)), bool)
        near, wide = (radius // BLOCKS)[:, None], PRINT_BITS // 8 // BLOCKS
        for block in range(0, PRINT_BITS // 8, wide):
            some |= sum(self.bits[b][prints[:, b]] for b in range(block, block + wide)) <= near
        w, g = np.nonzero(some)
        distance = BITS[prints[w] ^ self.prints[g]].sum(axis=1, dtype=np.int64)
        ok = np.flatnonzero(distance <= radius[w])
        ok = ok[np.argsort(distance[ok], kind="stable")]
        return w[ok], g[ok]

    def similarity(self, item: int, window: np.ndarray) -> float:
        h, c = self.shingles[item]
        x, n = np.unique(window, return_counts=True)
        _, i, j = np.intersect1d(h, x, assume_unique=True, return_indices=True)
        both = int(np.minimum(c[i], n[j]).sum())
        return both / (int(c.sum()) + len(window) - both)


def index(items: list[tuple[int, bytes]]) -> tuple[list[Items], dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Items by their number of words; for each shingle length the sorted shingles of all
    items and the group that each one occurs in."""
    cache, by_size = WordHashes(), {}
    words, counts = word_hashes([t for _, t in items], cache)
    for (i, _), w in zip(items, np.split(words, np.cumsum(counts)[:-1])):
        if len(w):
            by_size.setdefault(len(w), []).append((i, w))
    groups = [Items(n, rows) for n, rows in sorted(by_size.items())]
    hits = {}
    for length in sorted({g.length for g in groups}):
        pairs = sorted({(int(h), k) for k, g in enumerate(groups) if g.length == length for s, _ in g.shingles for h in s})
        hits[length] = (np.array([h for h, _ in pairs], np.uint64), np.array([k for _, k in pairs]))
    return groups, hits


def short(every: np.ndarray, begins: np.ndarray, ends: np.ndarray, docs: np.ndarray, g: Items) -> Iterator[tuple[int, int, float]]:
    """Texts of fewer words than the items that match one as a whole: text, item, similarity."""
    n = ends[docs] - begins[docs] - g.length + 1  # shingles; similarity is at most their share of the item's
    ok = (ends[docs] - begins[docs] < g.size) & (n / (g.size - g.length + 1) >= SIMILARITY)
    docs, n = docs[ok], n[ok]
    for at in range(0, len(docs), 256):
        d, m = docs[at:at + 256], n[at:at + 256]
        stop = np.cumsum(m)
        where = np.repeat(begins[d] - (stop - m), m) + np.arange(m.sum())
        prints = fingerprint(np.add.reduceat(signed_bits(every[where]), stop - m, axis=0))
        row = np.repeat(np.arange(len(d)), m)
        order = np.lexsort((every[where], row))
        same = (every[where[order[1:]]] == every[where[order[:-1]]]) & (row[order[1:]] == row[order[:-1]])
        radius = reach(m, np.bincount(row[order[1:]][same], minlength=len(d)), g.size - g.length + 1, g.norm)
        for w, item in zip(*(x.tolist() for x in g.candidates(prints, radius))):
            value = g.similarity(item, every[begins[d[w]]:begins[d[w]] + m[w]])
            if value >= SIMILARITY:
                yield int(d[w]), item, value


def matches(words: np.ndarray, ends: np.ndarray, groups: list[Items], hits: dict) -> list[list[tuple]]:
    """For each text, (item, first word, words, similarity) of the best window of every item
    it holds; ``ends``: where each text's words end."""
    out: list[dict] = [{} for _ in ends]
    begins = np.concatenate([[0], ends[:-1]])
    for length, (known, group) in hits.items():
        every = shingle_hashes(words, length)
        low = np.zeros(1 << 16, bool)
        low[(known & np.uint64(0xFFFF)).astype(np.int64)] = True
        at = np.flatnonzero(low[(every & np.uint64(0xFFFF)).astype(np.int64)])
        left, right = np.searchsorted(known, every[at], "left"), np.searchsorted(known, every[at], "right")
        at, left, right = at[right > left], left[right > left], right[right > left]
        doc = np.searchsorted(ends, at, "right")
        inside = at + length <= ends[doc]
        at, doc, left, right = at[inside], doc[inside], left[inside], right[inside]
        n = right - left
        which = group[np.repeat(left - np.cumsum(n) + n, n) + np.arange(n.sum())] if len(n) else np.zeros(0, np.int64)
        at, doc = np.repeat(at, n), np.repeat(doc, n)
        for k in np.unique(which).tolist():
            g = groups[k]
            wide = g.size - g.length
            mine = which == k
            for d, item, value in short(every, begins, ends, np.unique(doc[mine]), g):
                out[d][k, item] = (-value, 0, int(ends[d] - begins[d]))
            first = np.maximum(at[mine] - wide, begins[doc[mine]])
            last = np.minimum(at[mine], ends[doc[mine]] - g.size)
            ok = last >= first
            first, last = first[ok], last[ok]
            if not len(first):
                continue
            m = last - first + 1
            starts = np.unique(np.repeat(first - np.cumsum(m) + m, m) + np.arange(m.sum()))
            # neighbouring windows share prefix sums; a run of them is summed at once
            for run in np.split(starts, np.flatnonzero(np.diff(starts) > g.size) + 1):
                for part in np.array_split(run, -(-len(run) // 4096)):
                    a = int(part[0])
                    here = every[a:int(part[-1]) + wide + 1]
                    sums = np.concatenate([np.zeros((1, PRINT_BITS), np.int32), np.cumsum(signed_bits(here), axis=0)])
                    prints = fingerprint(sums[part - a + wide + 1] - sums[part - a])
                    order = np.argsort(here, kind="stable")
                    again = (here[order[1:]] == here[order[:-1]]) & (np.diff(order) <= wide)
                    repeats = np.zeros(len(here) + 1, np.int64)
                    repeats[order[1:][again] + 1] = 1
                    repeats = np.cumsum(repeats)
                    radius = reach(wide + 1, repeats[part - a + wide + 1] - repeats[part - a], wide + 1, g.norm)
                    for w, item in zip(*(x.tolist() for x in g.candidates(prints, radius))):
                        s = int(part[w])
                        value = g.similarity(item, every[s:s + wide + 1])
                        d = int(np.searchsorted(ends, s, "right"))
                        if value >= SIMILARITY and (-value, s - int(begins[d])) < out[d].get((k, item), (0, 0, 0))[:2]:
                            out[d][k, item] = (-value, s - int(begins[d]), g.size)
    return [sorted(((groups[k].ids[i], s, n, -v) for (k, i), (v, s, n) in found.items()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
            for found in out]


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                 to: str = "matches") -> DataFrame:
    """Add ``to``: the benchmark items that each text holds, an array of structs."""
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    out, before = docs.withColumn(to, F.array().cast(MATCHES)), None
    for b in range(blocks):
        block = [(r.item_id, r.text.encode("utf-8", "replace")) for r in  # about BLOCK_BYTES
                 items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()]
        if block:
            out = out.withColumn(to, F.concat(to, _scan(sorted(block, key=lambda r: (r[0] is None, r)))(F.col(text))))
        if b + 1 < blocks:
            out = stage(out, "decontaminate")
            if before is not None:
                drop_stage(before)
            before = out
    return out


def _scan(items: list[tuple[int, bytes]]):
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("similarity", pa.float64())]))

    @F.arrow_udf(MATCHES)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        (groups, hits), cache = index(items), WordHashes()
        for batch in batches:
            sizes, out = pc.binary_length(batch.cast(pa.binary())).fill_null(0).to_numpy(zero_copy_only=False), []
            for at, to in byte_slices(sizes + 1, 2 << 20):
                words, counts = word_hashes(as_bytes(batch[at:to]), cache)
                out += matches(words, np.cumsum(counts), groups, hits)
            names = ("item_id", "start_word", "n_words", "similarity")
            yield pa.array([[dict(zip(names, m)) for m in found] for found in out], kind)

    return run


ship(__name__)
