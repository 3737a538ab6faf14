"""Quality classifier by co-training.

Two views of a document are classified apart: its text (binned statistics of words, repeats,
letter case and symbols, and the presence of telling words) and its metadata (source,
language, length). Each view is fitted on the labelled rows and calibrated on rows it has not
seen; in each round a view labels the pool rows that it is sure of and hands them to the
other as training rows. At last both calibrated views are combined, by a logistic fit on the
calibration rows, and every document is scored on its whole text.

A document is good where its quality is 1 and it is not toxic. The fit reads a bounded sample,
at most LABELLED rows with labels and POOL rows without (parameters), as features made in the
tasks: the rows of the smallest hashes of id and content, of equal rows one. Equal texts under
different ids are rows of their own, in the sample at their share.

Defined cases: a null text is as an empty one; null metadata is a value of its own; labels
that are null count for nothing, of repeated ones the worst counts; without labels of both
kinds every score is null and every document is kept; extra columns stay, and a column of the
result's name is replaced; an empty table gives an empty table."""
from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordia.llm.common import as_bytes, byte_slices, ship
from concordia.llm.minhash import LOWER, WordHashes

LABELLED = 8000
POOL = 4000
BINS = 10
TELLING = 2000
ROUNDS = 4
SURE = 0.98
HANDED = 400
META = 512
STATS = 10
KIND = np.zeros(256, np.uint8)  # 0 letters and the rest of UTF-8, 1 capitals, 2 digits, 3 spaces, 4 symbols
KIND[65:91], KIND[48:58], KIND[[9, 10, 11, 12, 13, 32]] = 1, 2, 3
KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 4


def text_stats(texts: list[bytes], cache: WordHashes) -> tuple[np.ndarray, list[np.ndarray]]:
    """STATS numbers and the distinct words' hashes of each text."""
    n = len(texts)
    size = np.fromiter(map(len, texts), np.int64, n)
    kinds = KIND[np.frombuffer(b"".join(texts), np.uint8)]
    owner = np.repeat(np.arange(n), size)
    share = [np.bincount(owner, kinds == k, n) / np.maximum(size, 1) for k in (1, 2, 4)]
    out, words = np.zeros((n, STATS)), []
    for i, t in enumerate(texts):
        split = t.translate(LOWER).split()
        split = [w.strip(b".,;:!?\"'()[]") for w in split]
        h = np.fromiter(map(cache.__getitem__, split), np.uint64, len(split))
        distinct, counts = np.unique(h, return_counts=True)
        words.append(distinct)
        lines = t.split(b"\n")
        m = max(1, len(h))
        out[i, :7] = (len(distinct) / m, float((h[1:] == h[:-1]).sum()) / m, counts.max() / m if len(h) else 0, size[i] / m, np.log1p(len(h)),
                      len(set(lines)) / len(lines), size[i] / len(lines))
    out[:, 7:] = np.stack(share, 1)
    return out, words


def meta_ids(rows: list[tuple]) -> np.ndarray:
    """Hashed ids of (source, language, length on a log scale)."""
    def one(*x) -> int:
        return zlib.crc32(repr(x).encode("utf-8", "replace")) % META

    return np.array([(one("s", s), one("l", g), one("n", None if n is None else int(2 * np.log2(max(0, n) + 1)))) for s, g, n in rows]).reshape(-1, 3)


def logistic(x_ids: np.ndarray, width: int, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (the bias last) of a logistic regression on rows of feature ids; -1 is none.
    Gradient steps with per-feature scaling (Adagrad) on the whole sample."""
    w, g2 = np.zeros(width + 1), np.full(width + 1, 1e-8)
    row, col = np.nonzero(x_ids >= 0)
    ids = x_ids[row, col]
    for _ in range(150):
        z = np.bincount(row, w[ids], len(y)) + w[-1]
        e = weight * (y - 1 / (1 + np.exp(-np.clip(z, -30, 30))))
        g = np.append(np.bincount(ids, e[row], width), e.sum()) - ridge * np.append(w[:-1], 0)
        g2 += g * g
        w += 0.5 * g / np.sqrt(g2)
    return w


def margin(x_ids: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.where(x_ids >= 0, w[x_ids], 0).sum(axis=1) + w[-1]


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Intercept and slopes that turn margins (one column a view) into a log-odds."""
    x = np.column_stack([np.ones(len(z)), z])
    b = np.zeros(x.shape[1])
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(b))
        b += np.linalg.solve(h, x.T @ (target - p) - 1e-2 * b)
    return float(b[0]), b[1:]


@dataclass
class Model:
    cuts: list[np.ndarray]
    telling: np.ndarray  # sorted hashes of the telling words
    text: np.ndarray
    meta: np.ndarray
    bias: float
    slopes: np.ndarray

    def text_ids(self, stats: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
        return np.concatenate([bin_ids(stats, self.cuts), word_ids(words, self.telling)], 1)

    def score(self, stats: np.ndarray, words: list[np.ndarray], meta: np.ndarray) -> np.ndarray:
        z = np.column_stack([margin(self.text_ids(stats, words), self.text), margin(meta, self.meta)])
        return 1 / (1 + np.exp(-np.clip(self.bias + z @ self.slopes, -30, 30)))


def bin_ids(stats: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x, "right") + k * BINS for k, (c, x) in enumerate(zip(cuts, stats.T))], 1)


def word_ids(words: list[np.ndarray], telling: np.ndarray) -> np.ndarray:
    """Ids of the telling words of each text, filled up with -1."""
    if not len(telling) or not words:
        return np.zeros((len(words), 0), np.int64)
    flat = np.concatenate(words)
    at = np.minimum(np.searchsorted(telling, flat), len(telling) - 1)
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    hit = telling[at] == flat
    owner, at = owner[hit], at[hit]
    n = np.bincount(owner, minlength=len(words))
    out = np.full((len(words), int(n.max(initial=0))), -1)
    out[owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)] = STATS * BINS + at
    return out


def fit(labelled: tuple, pool: tuple) -> Model | None:
    """``labelled``: (stats, words, meta, y); ``pool``: (stats, words, meta)."""
    stats, words, meta, y = labelled
    if not 0 < y.sum() < len(y):
        return None
    fold = np.arange(len(y)) % 4 == 3  # rows to calibrate on
    if not 0 < y[fold].sum() < fold.sum() or not 0 < y[~fold].sum() < (~fold).sum():
        fold = np.zeros(len(y), bool)
    train, held = np.flatnonzero(~fold), np.flatnonzero(fold) if fold.any() else np.arange(len(y))
    cuts = [np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1]) for x in stats[train].T]
    # telling words: presence differs between the labels by more than chance
    flat, inverse = np.unique(np.concatenate([words[i] for i in train]), return_inverse=True)
    good = np.repeat(y[train] > 0, [len(words[i]) for i in train])
    a, b = np.bincount(inverse[good], minlength=len(flat)), np.bincount(inverse[~good], minlength=len(flat))
    n, m = y[train].sum(), len(train) - y[train].sum()
    p = (a + b) / (n + m)
    chance = np.abs(a / n - b / m) / np.sqrt(np.maximum(p * (1 - p) * (1 / n + 1 / m), 1e-12))
    keep = np.flatnonzero((chance > 4) & (a + b >= 4))
    telling = np.sort(flat[keep[np.argsort(-chance[keep], kind="stable")][:TELLING]])
    model = Model(cuts, telling, np.zeros(1), np.zeros(1), 0.0, np.ones(2))
    width = STATS * BINS + len(telling)
    joined = [*words, *pool[1]]
    ids = model.text_ids(np.concatenate([stats, pool[0]]), joined), np.concatenate([meta, pool[2]])
    size = (width, META)
    rows = [train, train]
    labels, weight = [y[train].astype(float)] * 2, [np.ones(len(train))] * 2
    first = len(y)
    for _ in range(ROUNDS):
        w = [logistic(ids[v][rows[v]], size[v], labels[v], weight[v]) for v in (0, 1)]
        handed = []
        for v in (0, 1):
            bias, slope = platt(margin(ids[v][held], w[v])[:, None], y[held])
            p = 1 / (1 + np.exp(-np.clip(bias + slope[0] * margin(ids[v][first:], w[v]), -30, 30))) if len(pool[0]) else np.zeros(0)
            sure = np.flatnonzero((p >= SURE) | (p <= 1 - SURE))
            best = sure[np.argsort(-np.abs(p[sure] - 0.5), kind="stable")][:HANDED]
            handed.append((best, p[best] >= 0.5))
        for v, (best, guess) in ((1, handed[0]), (0, handed[1])):  # what one view is sure of trains the other
            new = ~np.isin(best + first, rows[v])
            rows[v] = np.concatenate([rows[v], best[new] + first])
            labels[v] = np.concatenate([labels[v], guess[new].astype(float)])
            weight[v] = np.concatenate([weight[v], np.full(int(new.sum()), 0.5)])
    model.text, model.meta = (logistic(ids[v][rows[v]], size[v], labels[v], weight[v]) for v in (0, 1))
    model.bias, model.slopes = platt(np.column_stack([margin(ids[0][held], model.text), margin(ids[1][held], model.meta)]), y[held])
    return model


def _features(rows: DataFrame, cols: tuple[str, str, str, str], n: int, label: str | None, known: DataFrame | None = None) -> tuple:
    """Features of at most ``n`` distinct rows, those of the smallest hashes of id and content. With
    ``known`` (__id, label; an id once) they are of the rows that it holds, with ``label`` in the hash,
    or, without ``label``, of the others. Only ids and hashes are joined: a text is read where it lies."""
    @F.arrow_udf("struct<stats: binary, words: binary>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache = WordHashes()
        for batch in batches:
            stats, words = text_stats(as_bytes(batch), cache)
            yield pa.StructArray.from_arrays([pa.array([x.tobytes() for x in stats], pa.binary()),
                                              pa.array([x.tobytes() for x in words], pa.binary())], ["stats", "words"])

    text, source, lang, chars = cols
    ids = rows.select("__id")
    total = rows.count() if known is None else ids.join(known.select("__id"), "__id", "inner" if label else "left_anti").count()
    cut = min(2**63 - 1, int(2 * n / max(1, total) * 2**63))  # twice as many as wanted, so that the sort is small

    def hashed(*more: Column) -> Column:
        return F.xxhash64("__id", *cols, *more).bitwiseAND(F.lit(2**63 - 1)).alias("__at")

    if label:  # one hash a label, of which there are few; the join keeps the row's own
        kind = known.schema[label].dataType
        values = [F.lit(r[0]).cast(kind) for r in known.select(label).distinct().collect()] or [F.lit(None).cast(kind)]
        marks = F.filter(F.array(*(F.struct(hashed(v), v.alias(label)) for v in values)), lambda m: m["__at"] <= F.lit(cut))
        marked = rows.select("*", F.explode(marks).alias("m")).select("__id", *cols, "m.*")
    else:
        marked = rows.select("*", hashed()).where(F.col("__at") <= F.lit(cut))
    if known is not None:
        keys = ["__id", label] if label else ["__id"]
        own = marked.select(*keys, "__at").join(known.select(*keys), keys, "inner" if label else "left_anti")
        chosen = own.select("__at").distinct().orderBy("__at").limit(n)
        marked = marked.join(F.broadcast(chosen), "__at")  # n hashes at most
    got = (marked.dropDuplicates(["__at"])
           .select(run(F.col(text)).alias("f"), F.col(source).cast("string"), F.col(lang).cast("string"), F.col(chars).cast("long"),
                   *([F.col(label)] if label else []), "__at").orderBy("__at").limit(n).collect())
    return (np.frombuffer(b"".join([r.f.stats for r in got])).reshape(-1, STATS), [np.frombuffer(r.f.words, np.uint64) for r in got],
            meta_ids([(r[1], r[2], r[3]) for r in got]), *([np.array([r[4] for r in got], float)] if label else []))


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang",
             chars: str = "n_chars", to: str = "good", labelled: int = LABELLED, pool: int = POOL) -> DataFrame:
    """Add ``to``: the probability that a document is good (null if nothing could be learned). The
    fit reads at most ``labelled`` rows with labels and ``pool`` rows without; every row is scored."""
    known = (labels.select(F.col(doc_id).alias("__id"), "quality", "toxic").where("quality is not null and toxic is not null and __id is not null")
             .groupBy("__id").agg((F.min("quality") * (1 - F.max("toxic"))).alias("__good")))
    cols = (text, source, lang, chars)
    slim = docs.select(F.col(doc_id).alias("__id"), *cols)
    model = fit(_features(slim, cols, labelled, "__good", known), _features(slim, cols, pool, None, known))
    if model is None:
        return docs.withColumn(to, F.lit(None).cast("double"))

    @F.arrow_udf("double")
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        cache = WordHashes()
        for body, src, lng, num in batches:
            sizes, out = pc.binary_length(body.cast(pa.binary())).fill_null(0).to_numpy(zero_copy_only=False), []
            for at, n in byte_slices(sizes + 1, 2 << 20):
                meta = meta_ids(list(zip(src[at:n].to_pylist(), lng[at:n].to_pylist(), num[at:n].to_pylist())))
                out.append(model.score(*text_stats(as_bytes(body[at:n]), cache), meta))
            yield pa.array(np.concatenate(out) if out else [], pa.float64())

    return docs.withColumn(to, run(F.col(text), F.col(source).cast("string"), F.col(lang).cast("string"), F.col(chars).cast("long")))


ship(__name__)
