"""MinHash near-duplicate detection.

A document's set is its distinct 5-word shingles. Documents of one set are one class. 128
universal hash minima give 32 bands of four; classes that share a band's key are candidates
(a pair at similarity 0.75 shares none with probability 5e-6). Candidates must agree in
enough of the signature and are then confirmed on the full sets, recomputed from the texts.

Within a key all members are first held against the smallest one (a star, linear in the
members). Keys that still hold several components are gone through in cells: up to 256
members at once, larger keys in blocks, those outside the key's largest component against
all. A cell compares signatures as arrays, then full sets, and emits only links that join
components, so no pairs are emitted as rows and no link that would join two is lost.

Defined cases: a null or word-less text has an empty set and is linked with nothing; fewer
words than five are one shingle; rows of one doc_id are one document (one node); a row with
a null doc_id is linked with nothing, has a null component and is kept; extra columns are
not read; an empty table gives an empty table."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordia.llm.common import as_bytes, binary_array, byte_slices, list_array, mix64, released, ship, stage
from concordia.llm.components import components

WORDS = 5
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
AGREE = 72  # of 128: 4.9 standard deviations below the mean at similarity 0.75
MEMBERS = 256
PER_CELL = 64
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
ODD = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hash of each word seen; emptied when full, so its memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def word_hashes(texts: list[bytes], cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lower-cased, and the number of words of each text."""
    split = [t.translate(LOWER).split() for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    flat = [np.fromiter(map(cache.__getitem__, w), np.uint64, len(w)) for w in split]
    return (np.concatenate(flat) if flat else np.zeros(0, np.uint64)), counts


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the run of ``size`` words at every position that has one."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for k in range(1, size):
        h *= ODD
        h += words[k:k + n]
    return mix64(h)


def shingle_sets(texts: list[bytes], cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, concatenated, and each set's size."""
    words, counts = word_hashes(texts, cache)
    every = shingle_hashes(words, WORDS)
    sets, at = [], 0
    for n in counts.tolist():
        if n >= WORDS:
            s = np.sort(every[at:at + n - WORDS + 1])
            sets.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        else:
            sets.append(shingle_hashes(words[at:at + n], n) + np.uint64(n) if n else words[:0])
        at += n
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), sizes


def minima(sets: np.ndarray, sizes: np.ndarray, block: int = 2048) -> np.ndarray:
    """32-bit minima of HASHES multiply-add-shift hashes, one row per set."""
    rng = np.random.default_rng(20240229)
    a = rng.integers(0, 2**63, (HASHES, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, (HASHES, 1), dtype=np.uint64) * np.uint64(2)
    x = sets >> np.uint64(32)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    out = np.full((len(sizes), HASHES), np.iinfo(np.uint64).max, np.uint64)
    room = np.empty((HASHES, block), np.uint64)
    for at in range(0, len(x), block):
        to = min(at + block, len(x))
        v = room[:, :to - at]
        np.multiply(a, x[at:to], out=v)
        np.add(v, b, out=v)
        who = owner[at:to]
        first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
        rows = who[first]
        out[rows] = np.minimum(out[rows], np.minimum.reduceat(v, first, axis=1).T)
    return (out >> np.uint64(32)).astype(np.uint32)


def band_keys(low: np.ndarray) -> np.ndarray:
    """A 64-bit key per band; the band's number is part of it."""
    m = low.astype(np.uint64).reshape(len(low), BANDS, ROWS)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * ODD, m.shape[:2]).copy()
    for k in range(ROWS):
        h = mix64(h + m[:, :, k] * ODD)
    return h.view(np.int64)


def document_sets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, hi and lo (128-bit hash of the set), sig, bands; hi is null for an
    empty set, and bands are empty then."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            lengths = pc.binary_length(batch.column(1).cast(pa.binary())).fill_null(0).to_numpy(zero_copy_only=False)
            for at, to in byte_slices(lengths + 1, 2 << 20):
                sets, sizes = shingle_sets(as_bytes(batch.column(1)[at:to]), cache)
                low = minima(sets, sizes)
                keys = band_keys(low)
                full = sizes > 0
                digest = [xxhash.xxh3_128_intdigest(s.tobytes()) if len(s) else None
                          for s in np.split(sets, np.cumsum(sizes)[:-1])]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[at:to], pa.array(sizes),
                    pa.array([None if d is None else (d >> 64) - 2**63 for d in digest], pa.int64()),
                    pa.array([None if d is None else (d & 2**64 - 1) - 2**63 for d in digest], pa.int64()),
                    binary_array((low & np.uint32(255)).astype(np.uint8).ravel(), np.arange(1, len(sizes) + 1) * HASHES),
                    list_array(keys[full].ravel(), np.cumsum(full) * BANDS, pa.int64())],
                    ["doc_id", "n_shingles", "hi", "lo", "sig", "bands"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        released(run), "doc_id long, n_shingles long, hi long, lo long, sig binary, bands array<long>")


def _agreeing(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures agree in AGREE of the minima at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, HASHES) for k in (2, 3))
            good = pa.array((x == y).sum(axis=1) >= AGREE)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(good)

    one = sigs.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"))
    two = sigs.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(released(run), "a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= 75 * union of the full sets. All b of an a are
    dealt to cells of about PER_CELL, so a hub's text is sent once per cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, cell, hubs = WordHashes(), None, []
        for batch in batches:
            lengths = pc.binary_length(batch.column(4).cast(pa.binary())).fill_null(0).to_numpy(zero_copy_only=False)
            for at, to in byte_slices(lengths + 1, 2 << 20):
                part = batch.slice(at, to - at)
                a, part_no, is_b, node = (part.column(k).to_pylist() for k in range(4))
                sets, sizes = shingle_sets(as_bytes(part.column(4)), cache)
                found = []
                for i, s in enumerate(np.split(sets, np.cumsum(sizes)[:-1])):
                    if (a[i], part_no[i]) != cell:
                        cell, hubs = (a[i], part_no[i]), []
                    if not is_b[i]:
                        hubs.append(s)
                        continue
                    for h in hubs:
                        both = len(np.intersect1d(h, s, assume_unique=True))
                        if both and 100 * both >= 75 * (len(h) + len(s) - both):
                            found.append((a[i], node[i]))
                            break
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()),
                                                      pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    cells = pairs.groupBy("a").agg(F.ceil(F.count("*") / PER_CELL).alias("cells"))
    dealt = pairs.join(cells, "a").select("a", F.pmod(F.xxhash64("b"), F.col("cells")).alias("part"), F.lit(1).alias("is_b"),
                                          F.col("b").alias("node"))
    hubs = dealt.select("a", "part").distinct().select("a", "part", F.lit(0).alias("is_b"), F.col("a").alias("node"))
    # partitions follow the number of cells, not of keys: cells of one hub may lie anywhere
    return (dealt.union(hubs).join(texts, "node").select("a", "part", "is_b", "node", "text")
            .repartition("a", "part").sortWithinPartitions("a", "part", "is_b").mapInArrow(released(run), "a long, b long").distinct())


def _across(cells: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) that join different roots inside cells (key, i, j, node, root, side).
    Members of side 0 are held against those of side 1, or against each other where the
    cell has no side 1: signatures first, then full sets, and a pair only while its ends are
    not yet joined, so that a cell emits fewer links than it has members."""

    def joined(sets: list[np.ndarray], node: list[int], root: list[int], side: list[int]) -> Iterator[tuple[int, int]]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        sig = (minima(np.concatenate(sets), sizes) & np.uint32(255)).astype(np.uint8)
        kind = np.array(side)
        left = np.flatnonzero(kind == 0)
        right = np.flatnonzero(kind == 1)
        if not len(left):
            return
        alone = not len(right)
        right = left if alone else right
        agree = np.stack([(sig[i] == sig[right]).sum(axis=1) for i in left])
        x, y = np.nonzero(agree >= AGREE)
        i, j = left[x], right[y]
        near = 100 * np.minimum(sizes[i], sizes[j]) >= 75 * np.maximum(sizes[i], sizes[j])
        if alone:
            near &= i < j
        for k in np.flatnonzero(near)[np.argsort(-agree[x, y][near], kind="stable")].tolist():
            a, b = int(i[k]), int(j[k])
            if (ra := find(root[a])) == (rb := find(root[b])):
                continue
            both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                parent[ra] = rb
                yield node[a], node[b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, cell, held = WordHashes(), None, ([], [], [], [])

        def flush() -> pa.RecordBatch | None:
            found = list(joined(*held)) if held[0] else []
            for h in held:
                h.clear()
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()),
                                               pa.array([y for _, y in found], pa.int64())], ["a", "b"]) if found else None

        for batch in batches:
            lengths = pc.binary_length(batch.column(6).cast(pa.binary())).fill_null(0).to_numpy(zero_copy_only=False)
            for at, to in byte_slices(lengths + 1, 2 << 20):
                part = batch.slice(at, to - at)
                key, i, j, node, root, side = (part.column(k).to_pylist() for k in range(6))
                sets, sizes = shingle_sets(as_bytes(part.column(6)), cache)
                for k, s in enumerate(np.split(sets, np.cumsum(sizes)[:-1])):
                    if (key[k], i[k], j[k]) != cell:
                        if (out := flush()) is not None:
                            yield out
                        cell = (key[k], i[k], j[k])
                    for h, x in zip(held, (s, node[k], root[k], side[k])):
                        h.append(x)
        if (out := flush()) is not None:
            yield out

    where = ["key", "i", "j"]
    return (cells.join(texts, "node").select(*where, "node", "root", "side", "text")
            .repartition(*where).sortWithinPartitions(*where).mapInArrow(released(run), "a long, b long").distinct())


def _open(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """Members (key, members, node, root) of the keys that hold several roots; keys of the
    same members count once, and a pair has been held against its head already."""
    placed = shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    same = [F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("y")]
    keys = (placed.where("members > 2").groupBy("key", "members").agg(F.min("root").alias("low"), F.max("root").alias("high"), *same)
            .where("low <> high").groupBy("members", "x", "y").agg(F.min("key").alias("key")).select("key"))
    return placed.join(keys, "key").select("key", "members", "node", "root")


def _blocks(rest: DataFrame) -> DataFrame:
    """Cells of large keys: blocks of the members outside a key's commonest root, each
    against blocks of all its members."""
    main = (rest.groupBy("key", "members", "root").agg(F.count("*").alias("n"))
            .groupBy("key", "members").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("most")))
    main = main.select("key", "main", F.ceil((F.col("members") - F.col("most")) / MEMBERS).cast("int").alias("ni"),
                       F.ceil(F.col("members") / MEMBERS).cast("int").alias("nj"))
    at = rest.join(main, "key")
    one = (at.where("root <> main").withColumn("i", F.pmod(F.xxhash64("node"), F.col("ni")).cast("int"))
           .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nj") - 1))).withColumn("side", F.lit(0)))
    all_ = (at.withColumn("j", F.pmod(F.xxhash64("node", "key"), F.col("nj")).cast("int"))
            .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("ni") - 1))).withColumn("side", F.lit(1)))
    cols = ["key", "i", "j", "node", "root", "side"]
    return one.select(cols).union(all_.select(cols))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    sets = stage(document_sets(docs, doc_id, text), "sets")
    known = sets.where("doc_id is not null and hi is not null")
    classes = stage(known.groupBy("hi", "lo").agg(F.min("doc_id").alias("node")), "classes")
    sigs = stage(known.select(F.col("doc_id").alias("node"), "hi", "lo", "sig", "bands")
                 .join(classes, ["node", "hi", "lo"]).dropDuplicates(["node", "hi", "lo"]), "signatures")

    bands = sigs.select("node", F.explode("bands").alias("key")).distinct()
    heads = bands.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("members")).where("members > 1")
    shared = stage(bands.join(heads, "key"), "bands")
    # whole texts are shuffled once; what is compared below are the texts of shared keys only
    texts = stage(docs.select(F.col(doc_id).cast("long").alias("node"), F.col(text).alias("text"))
                  .join(shared.select("node").distinct(), "node", "left_semi"), "texts")
    pairs = shared.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    links = stage(_confirmed(stage(_agreeing(pairs, sigs), "stars"), texts), "links")
    roots = components(links)

    for large in (False, True):  # small keys first: what they join closes most of the large ones
        rest = stage(_open(shared, roots).where(F.col("members") > MEMBERS if large else F.col("members") <= MEMBERS), "open")
        if rest.isEmpty():
            continue
        zero = F.lit(0)
        cells = _blocks(rest) if large else rest.select("key", zero.alias("i"), zero.alias("j"), "node", "root", zero.alias("side"))
        more = stage(_across(cells, texts), "links")
        if not more.isEmpty():
            links = stage(links.union(more), "links")
            roots = components(links)

    by_class = classes.join(roots, "node", "left").select("hi", "lo", F.coalesce("root", "node").alias("class_root"))
    return (sets.select("doc_id", "n_shingles", "hi", "lo").join(by_class, ["hi", "lo"], "left")
            .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_root", "doc_id")))
            .select("doc_id", "n_shingles", "component_id",
                    F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")))


ship(__name__)
