"""Near-duplicate embeddings by a random-projection tree forest.

Vectors are compared only where labels are equal. Equal vectors of a label are one class.
Each tree splits the classes by random projections at thresholds fitted on a bounded sample
(SAMPLE rows); a band of quantiles around each threshold goes to both sides, so near pairs
are seldom parted. Every class is indexed in every tree. What travels to the leaves is a
sketch of a byte a component with the length of its error, so the cosine of two that meet in
a leaf has strict bounds: pairs whose bounds lie on one side of the limit are decided, the
others are compared in double precision on the vectors. Links are united, and components run
over them. TOGETHER trees are worked through at a time and their files deleted.

Splits are at quantiles of at least FITTED sample rows, and a label goes as deep as its own
rows need for leaves near LEAF, so the forest has a bounded size and leaves grow with the
table beyond what the sample can split; a leaf that outgrows MOST rows is split at random into parts, each pair of which
is compared, so no task holds an unbounded leaf.

Defined cases: a null label, a null, empty, zero or non-finite vector, and one with a null
component link with nothing (component: itself); vectors of different lengths do not link;
repeated rows of a vec_id are further vectors; a row with a null vec_id links with nothing,
has a null component and is kept; extra columns are not read; an empty table gives an empty
table."""
from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordia.llm.common import drop_stage, ship, stage
from concordia.llm.components import components

COSINE = 0.98
TREES = 16
LEAF = 192
MOST = 1024
SPILL = 0.08
SAMPLE = 20_000
FITTED = 100
TOGETHER = 4
ROUNDING = 1e-6


def fit_tree(sample: np.ndarray, depth: int, rng: np.random.Generator) -> list[tuple[np.ndarray, float, float]]:
    """Nodes in heap order: direction, and the two thresholds between which a vector goes to
    both sides."""
    nodes: list[tuple[np.ndarray, float, float]] = []
    rows = [np.arange(len(sample))]
    for level in range(depth):
        below = []
        for r in rows:
            direction = rng.normal(size=sample.shape[1])
            direction /= np.linalg.norm(direction)
            p = sample[r] @ direction
            low, high = np.quantile(p, [0.5 - SPILL, 0.5 + SPILL]) if len(r) else (0.0, 0.0)
            nodes.append((direction, float(low), float(high)))
            below += [r[p <= high], r[p >= low]]
        rows = below
    return nodes


def leaves(unit: np.ndarray, nodes: list[tuple[np.ndarray, float, float]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of every leaf that each vector goes to."""
    row, node = np.arange(len(unit)), np.zeros(len(unit), np.int64)
    for _ in range(depth):
        out_r, out_n = [], []
        for k in np.unique(node).tolist():
            r = row[node == k]
            direction, low, high = nodes[k]
            p = unit[r] @ direction
            for side, mask in ((1, p <= high), (2, p >= low)):
                out_r.append(r[mask])
                out_n.append(np.full(int(mask.sum()), 2 * k + side))
        row, node = np.concatenate(out_r), np.concatenate(out_n)
    return row, node


def normal(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; the largest component goes first, so that squares keep in range."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def sketch(unit: np.ndarray) -> np.ndarray:
    """A row of bytes a vector: components as whole steps of -127 to 127, the step, and the length of the error."""
    step = (np.abs(unit).max(axis=1, keepdims=True) / 127).astype(np.float32)
    whole = np.rint(unit / step).clip(-127, 127).astype(np.int8)
    error = np.linalg.norm(unit - whole * step.astype(float), axis=1, keepdims=True).astype(np.float32)
    return np.hstack([whole.view(np.uint8), step.view(np.uint8), error.view(np.uint8)])


def cosine_bounds(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the cosine of every pair of sketches: |u.v - p.q| <= |u - p| |v| + |p| |v - q|, |p| <= 1 + |u - p|."""
    width = a.shape[1] - 8
    exact = np.float32 if width * 127 * 127 < 1 << 24 else np.float64  # sums of whole numbers stay exact
    (p, s, e), (q, t, f) = ((np.ascontiguousarray(c[:, :width]).view(np.int8).astype(exact), np.ascontiguousarray(c[:, width:width + 4]).view(np.float32).astype(float),
                             np.ascontiguousarray(c[:, width + 4:]).view(np.float32).astype(float)) for c in (a, b))
    about, off = (p @ q.T) * (s * t.T), e + (1 + e) * f.T + ROUNDING
    return about - off, about + off


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
                 cosine: float = COSINE, trees: int = TREES) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    x = F.col("x")
    finite = (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(x, lambda v: v != 0)
    rows = stage(vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"),
                                F.transform(F.col(embedding), lambda v: v.cast("double") + F.lit(0.0)).alias("x"))
                 .withColumn("usable", F.coalesce(finite & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))), "vectors")
    classes = stage(rows.where("usable").groupBy("label", "x").agg(F.min("vec_id").alias("node"), F.count("*").alias("size"))
                    .withColumn("width", F.size("x")), "classes")
    links = None
    widths = [r.width for r in classes.select("width").distinct().collect()]  # one row a vector length
    for width in sorted(widths):
        part = classes.where(F.col("width") == width)
        found = _links(part, part.count(), width, cosine, trees)
        links = found if links is None else links.union(found)
    if links is None:
        links = spark.createDataFrame([], "a long, b long")
    links = stage(links.distinct(), "links")
    sizes = classes.select("node", "size")
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    count = (both.join(sizes.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("size").alias("far")))
    per_class = (classes.select("label", "x", "node", "size").join(count, "node", "left").join(components(links), "node", "left")
                 .select("label", "x", (F.col("size") - 1 + F.coalesce("far", F.lit(0))).alias("n"), F.coalesce("root", "node").alias("c")))
    # the join on equal vectors is skewed by hot ones; AQE splits it
    return (rows.join(per_class.withColumn("usable", F.lit(True)), ["label", "x", "usable"], "left")
            .withColumn("component_id", F.when(F.col("vec_id").isNotNull(), F.coalesce("c", "vec_id")))
            .select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), "component_id",
                    F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept")))


def _links(classes: DataFrame, n: int, width: int, cosine: float, trees: int) -> DataFrame:
    picked = classes.where(F.pmod(F.xxhash64("node"), F.lit(1_000_000)) < min(1_000_000, 1_100_000 * SAMPLE // max(n, 1)))
    sample = np.array([r.x for r in picked.select("x").limit(2 * SAMPLE).collect()], float).reshape(-1, width)
    sample = normal(sample) if len(sample) else sample
    fitted = 1 + int(np.log(len(sample) / FITTED) / -np.log(0.5 + SPILL)) if len(sample) >= FITTED else 0
    sizes = classes.groupBy("label").agg(F.count("*").alias("n"))
    wanted = F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("n") / LEAF)) / F.lit(float(1 - np.log2(1 + 2 * SPILL))))
    depths = stage(sizes.select("label", F.least(wanted, F.lit(fitted)).cast("int").alias("depth")), "depths")
    deepest = depths.agg(F.max("depth").alias("d")).first().d or 0
    forest = [fit_tree(sample, deepest, np.random.default_rng([17, t])) for t in range(trees)]

    def assign(first: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 2000):
                    part = batch.slice(at, 2000)
                    unit, depth = normal(_matrix(part.column(2), width)), part.column(3).to_numpy()
                    codes = pa.array([c.tobytes() for c in sketch(unit)], pa.binary())
                    for t in range(first, min(first + TOGETHER, trees)):
                        row, leaf = [], []
                        for d in np.unique(depth).tolist():
                            own = np.flatnonzero(depth == d)
                            r, k = leaves(unit[own], forest[t], d)
                            row.append(own[r])
                            leaf.append(k)
                        row, leaf = pa.array(np.concatenate(row)), np.concatenate(leaf)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), t, np.int32)), pa.array(leaf), part.column(0).take(row),
                                                          part.column(1).take(row), codes.take(row)], ["tree", "leaf", "label", "node", "code"])
        return run

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []  # rows of the cell being read: nodes, sides, sketches

        def flush() -> Iterator[pa.RecordBatch]:
            ids, side, code = (np.concatenate(c) for c in zip(*held))
            held.clear()
            split = side.min() != side.max()
            for at in range(0, len(ids) if len(ids) > 1 else 0, 512):
                low, high = cosine_bounds(code[at:at + 512], code)
                a, b = np.nonzero(high >= cosine)
                sure = low[a, b] >= cosine
                a += at
                ok = (ids[a] < ids[b]) & ((side[a] != side[b]) | (not split))
                if ok.any():
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a[ok]]), pa.array(ids[b[ok]]), pa.array(sure[ok])], ["a", "b", "sure"])

        for batch in batches:
            keys = [batch.column(k) for k in range(5)]
            change = np.zeros(batch.num_rows, bool)
            for k in keys:
                k = k.dictionary_encode().indices.to_numpy(zero_copy_only=False)
                change[1:] |= k[1:] != k[:-1]
            ids, side = (batch.column(k).to_numpy() for k in (5, 6))
            code = np.frombuffer(b"".join(batch.column(7).to_pylist()), np.uint8).reshape(-1, width + 8)
            cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for at, to in zip(cuts, cuts[1:]):
                if at < to:
                    own = tuple(k[at].as_py() for k in keys)
                    if own != key and held:
                        yield from flush()
                    key = own
                    held.append((ids[at:to], side[at:to], code[at:to]))
        if held:
            yield from flush()

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.einsum("ij,ij->i", normal(_matrix(batch.column(2), width)), normal(_matrix(batch.column(3), width))) >= cosine
            yield batch.select([0, 1]).filter(pa.array(near))

    kind = classes.schema["label"].dataType.simpleString()
    leaf, placed = ["tree", "leaf", "label"], classes.join(depths, "label").select("label", "node", "x", "depth")
    where, met = [*leaf, "i", "j"], []
    for first in range(0, trees, TOGETHER):
        at = stage(placed.mapInArrow(assign(first), f"tree int, leaf long, label {kind}, node long, code binary"), "leaves")
        parts = at.groupBy(*leaf).agg(F.ceil(F.count("*") * 2 / MOST).cast("int").alias("parts")).where("parts > 1")
        # a leaf of up to MOST / 2 rows is one cell; of a larger one each pair of parts is a cell
        spread = (at.join(parts, leaf, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
                  .withColumn("p", F.pmod(F.xxhash64("node"), "parts").cast("int"))
                  .withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))))
        cells = spread.select(*leaf, F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), "node",
                              F.when(F.col("p") <= F.col("q"), 0).otherwise(1).alias("side"), "code")
        pairs = cells.repartition(*where).sortWithinPartitions(*where).mapInArrow(compare, "a long, b long, sure boolean")
        met.append(stage(pairs.distinct(), "pairs"))
        drop_stage(at)
    found = reduce(DataFrame.union, met).distinct()
    xs = classes.select("node", "x")
    open_ = (found.where("not sure").join(xs.toDF("a", "xa"), "a").join(xs.toDF("b", "xb"), "b").select("a", "b", "xa", "xb")
             .mapInArrow(confirm, "a long, b long"))
    links = stage(found.where("sure").select("a", "b").union(open_), "links")
    for m in met:
        drop_stage(m)
    return links


ship(__name__)
