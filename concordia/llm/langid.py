"""Language identification of words by a linear-chain conditional random field.

A word's emission sums weights of hashed character n-grams and affixes and, for words of the
learned lexicon, its share in each language. Learned transitions join the words; forward-
backward gives every word's posterior, also in texts that switch between languages, and a
document takes the language of most posterior mass, weighted by letters. Training sequences
splice segments of documents of different languages, so that transitions see switches.

The fit reads a bounded sample: up to SAMPLE_CHARS characters a language of labelled rows,
whole texts in the order of a hash, none longer than a quarter of that. Every prediction
reads the whole text: blocks of 64 words yield transfer matrices that compose associatively,
so long texts cost no more a word than short ones.

Defined cases: a null text, or one without letters, is `und` with score 0; without a labelled
row other texts get a null language; ties go to the first language in order; extra columns stay, and a column
of the result's name is replaced; an empty table gives an empty table."""
from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordia.llm.common import as_texts, byte_slices, mix64, release, ship

SAMPLE_CHARS = 400_000
FEATURES = 1 << 16
NGRAMS = (1, 2, 3, 4)
LEXICON = 20_000
LENGTH = 32
BLOCK = 64
EPOCHS = 4
KNOWN_WORDS = 200_000
SLICE = 1 << 19  # bytes of texts whose words are in arrays at once
START, END = 2, 3
SLOTS = 1 << 18
BACK = 5.0


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # FEATURES x languages
    gain: float  # weight of the lexicon's shares
    lexicon: dict[str, np.ndarray]  # word -> share in each language, less the mean
    trans: np.ndarray  # languages x languages


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature of every n-gram (word ends marked) and affix, and its word's row."""
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 2
    body = "".join([f"{chr(START)}{w}{chr(END)}" for w in words])
    cp = np.frombuffer(body.encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    ends = np.cumsum(lens)
    owner = np.repeat(np.arange(len(words)), lens)
    left = np.repeat(ends, lens) - np.arange(len(cp))  # code points from here to the word's end
    place = lens[owner] - left
    ids, rows = [], []
    h = np.zeros(len(cp), np.uint64)
    for n in range(1, max(NGRAMS) + 1):
        h = h[:len(cp) - n + 1] * np.uint64(0x100000001B3) + cp[n - 1:] + np.uint64(n)
        ok = left[:len(h)] >= n
        mixed = mix64(h[ok])
        ids.append(mixed % np.uint64(FEATURES))
        mine = owner[:len(h)][ok]
        rows.append(mine)
        first, last = place[:len(h)][ok] == 0, left[:len(h)][ok] == n
        for edge, salt in ((first, 7), (last, 11)):  # affixes are told apart from inner n-grams
            ids.append(mix64(mixed[edge] + np.uint64(salt)) % np.uint64(FEATURES))
            rows.append(mine[edge])
    order = np.argsort(np.concatenate(rows), kind="stable")
    return np.concatenate(ids)[order].astype(np.int64), np.concatenate(rows)[order]


def emissions(words: list[str], model: Model) -> np.ndarray:
    """Score of each word in each language."""
    k = len(model.langs)
    if not words:
        return np.zeros((0, k), np.float32)
    ids, rows = features(words)
    counts = np.bincount(rows, minlength=len(words))
    sums = np.add.reduceat(model.weights[ids], np.cumsum(counts) - counts, axis=0)
    out = sums / np.sqrt(counts)[:, None]
    for i, w in enumerate(words):
        if (share := model.lexicon.get(w)) is not None:
            out[i] += model.gain * share
    return out.astype(np.float32)


def letters(word: str) -> int:
    return sum(map(str.isalpha, word))


def trim(word: str) -> str:
    """The word without what is no letter at its ends, composed."""
    a, b = 0, len(word)
    while a < b and not word[a].isalpha():
        a += 1
    while b > a and not word[b - 1].isalpha():
        b -= 1
    return unicodedata.normalize("NFC", word[a:b]) if not word.isascii() else word[a:b]


def fit(rows: list[tuple[str, str]], seed: int = 11) -> Model:
    """Train on (language, text) rows by Adagrad on spliced sequences."""
    langs = sorted({lang for lang, _ in rows})
    k = len(langs)
    stream: list[list[str]] = [[] for _ in langs]
    for lang, text in rows:
        stream[langs.index(lang)] += [t for w in text.lower().split() if (t := trim(w))]
    counts = Counter()
    for i, ws in enumerate(stream):
        counts.update((w, i) for w in ws)
    total = Counter()
    for (w, _), n in counts.items():
        total[w] += n
    size = [max(1, len(ws)) for ws in stream]
    lexicon = {}
    for w, n in total.most_common(LEXICON):
        if n >= 3:
            rate = np.array([counts[w, i] / size[i] for i in range(k)])
            lexicon[w] = (rate / rate.sum() - 1 / k).astype(np.float32)
    rng = np.random.default_rng(seed)
    vocab = sorted(total)
    row_of = {w: i for i, w in enumerate(vocab)}
    ids, rows_ = features(vocab) if vocab else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    nf = np.bincount(rows_, minlength=len(vocab))
    start = np.cumsum(nf) - nf
    share = np.zeros((len(vocab), k), np.float32)
    for w, s in lexicon.items():
        share[row_of[w]] = s
    index = [np.array([row_of[w] for w in ws], np.int64) for ws in stream]
    seqs, tags = [], []
    for lang in range(k):
        for at in range(0, max(0, len(index[lang]) - LENGTH + 1), LENGTH):
            x, y = index[lang][at:at + LENGTH].copy(), np.full(LENGTH, lang)
            for _ in range(int(rng.integers(0, 3))):  # splice in a run of another language
                other = int(rng.integers(0, k))
                n = int(rng.integers(3, 13))
                if len(index[other]) > n:
                    a, b = int(rng.integers(0, LENGTH - n)), int(rng.integers(0, len(index[other]) - n))
                    x[a:a + n], y[a:a + n] = index[other][b:b + n], other
            seqs.append(x)
            tags.append(y)
    weights, trans = np.zeros((FEATURES, k), np.float32), np.zeros((k, k))
    model = Model(langs, weights, 1.0, lexicon, trans)
    if not seqs:
        return model
    xs, ys = np.array(seqs), np.array(tags)
    g_w, g_t, g_g = np.full((FEATURES, k), 1e-6, np.float32), np.full((k, k), 1e-6), 1e-6
    for _ in range(EPOCHS):
        for batch in np.array_split(rng.permutation(len(xs)), -(-len(xs) // 128)):
            x, y = xs[batch], ys[batch]
            words, inv = np.unique(x, return_inverse=True)
            n = nf[words]
            flat = ids[np.repeat(start[words] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            who = np.repeat(np.arange(len(words)), n)
            e = np.add.reduceat(weights[flat], np.cumsum(n) - n, axis=0) / np.sqrt(n)[:, None] + model.gain * share[words]
            emit = e[inv.reshape(x.shape)]
            gamma, pairs = forward_backward(emit, trans)
            target = np.eye(k)[y]
            diff = (target - gamma).reshape(-1, k) / len(batch)
            per_word = np.stack([np.bincount(inv.ravel(), diff[:, c], len(words)) for c in range(k)], 1)
            d_g = float((per_word * share[words]).sum())
            grad = np.stack([np.bincount(flat, (per_word[:, c] / np.sqrt(n))[who], FEATURES) for c in range(k)], 1)
            seen = np.zeros((k, k))
            np.add.at(seen, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1 / len(batch))
            d_t = seen - pairs / len(batch)
            g_w += grad ** 2
            g_t += d_t ** 2
            g_g += d_g ** 2
            weights += (0.3 * grad / np.sqrt(g_w)).astype(np.float32)
            trans += 0.1 * d_t / np.sqrt(g_t)
            model.gain += 0.1 * d_g / np.sqrt(g_g)
    return model


def forward_backward(emit: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of sequences of one length, and expected counts of transitions."""
    b, t, k = emit.shape
    e = np.exp(emit - emit.max(axis=2, keepdims=True))
    m = np.exp(trans - trans.max())
    alpha, beta = np.empty((t, b, k)), np.ones((t, b, k))
    run = np.full((b, k), 1.0 / k)
    for i in range(t):
        run = (run @ m) * e[:, i]
        run /= run.sum(axis=1, keepdims=True)
        alpha[i] = run
    for i in range(t - 2, -1, -1):
        back = (e[:, i + 1] * beta[i + 1]) @ m.T
        beta[i] = back / back.sum(axis=1, keepdims=True)
    gamma = alpha * beta
    gamma /= gamma.sum(axis=2, keepdims=True)
    pairs = np.zeros((k, k))
    for i in range(t - 1):
        xi = alpha[i][:, :, None] * m * (e[:, i + 1] * beta[i + 1])[:, None, :]
        pairs += (xi / xi.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return gamma.transpose(1, 0, 2), pairs


def posteriors(emit: np.ndarray, counts: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Posterior of every word of texts with the given numbers of words. Each block of words
    is a matrix; vectors pass through the blocks of a text, then through the words of all
    blocks at once."""
    k = emit.shape[1]
    m = np.exp(trans - trans.max())
    blocks = -(-counts // BLOCK)
    nb = int(blocks.sum())
    if not nb:
        return np.zeros((0, k))
    text_of = np.repeat(np.arange(len(counts)), counts)
    base = np.cumsum(blocks) - blocks
    inside = np.arange(len(emit)) - (np.cumsum(counts) - counts)[text_of]
    row, col = base[text_of] + inside // BLOCK, inside % BLOCK
    e = np.ones((BLOCK, nb, k))
    real = np.zeros((BLOCK, nb), bool)
    e[col, row] = np.exp(emit - emit.max(axis=1, keepdims=True))
    real[col, row] = True
    used = int(col.max()) + 1
    p = np.broadcast_to(np.eye(k), (nb, k, k)).copy()
    for t in range(used):
        q = (p.reshape(-1, k) @ m).reshape(nb, k, k) * e[t][:, None, :]
        q /= q.max(axis=(1, 2), keepdims=True)
        p = np.where(real[t][:, None, None], q, p)
    into, out = np.full((nb, k), 1.0 / k), np.ones((nb, k))
    for j in range(1, int(blocks.max())):
        at = base[blocks > j] + j
        v = np.einsum("bi,bij->bj", into[at - 1], p[at - 1])
        into[at] = v / v.sum(axis=1, keepdims=True)
    for j in range(int(blocks.max()) - 2, -1, -1):
        at = base[blocks > j + 1] + j
        v = np.einsum("bij,bj->bi", p[at + 1], out[at + 1])
        out[at] = v / v.sum(axis=1, keepdims=True)
    alpha, run = np.empty((used, nb, k)), into
    for t in range(used):
        nxt = (run @ m) * e[t]
        nxt /= nxt.sum(axis=1, keepdims=True)
        run = np.where(real[t][:, None], nxt, run)
        alpha[t] = run
    gamma, back = np.empty((used, nb, k)), out
    for t in range(used - 1, -1, -1):
        g = alpha[t] * back
        gamma[t] = g / g.sum(axis=1, keepdims=True)
        nxt = (e[t] * back) @ m.T
        back = np.where(real[t][:, None], nxt / nxt.sum(axis=1, keepdims=True), back)
    return gamma[col, row]


class Words(dict):
    """Row of each word seen; ``new`` holds the words whose emissions are still to be computed."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        row = self[word] = len(self)
        return row


def predict_texts(texts: list[str], model: Model, words: Words, table: list[np.ndarray]) -> list[tuple[str, float]]:
    """(language, score) of each text; ``table`` holds emissions and letters of the words."""
    k = len(model.langs)
    if len(words) > KNOWN_WORDS:
        words.clear()
        table[:] = [np.zeros((0, k), np.float32), np.zeros(0)]
    split = [t.lower().split() for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    rows = [np.fromiter(map(words.__getitem__, ws), np.int64, len(ws)) for ws in split]
    if words.new:
        size = np.array([letters(w) for w in words.new], float)
        e = emissions([trim(w) for w in words.new], model) * (size > 0)[:, None]
        table[0], table[1] = np.concatenate([table[0], e]), np.concatenate([table[1], size])
        words.new = []
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    weight = table[1][flat]
    gamma = posteriors(table[0][flat].astype(float), counts, model.trans)
    owner = np.repeat(np.arange(len(texts)), counts)
    mass = np.stack([np.bincount(owner, gamma[:, c] * weight, len(texts)) for c in range(k)], 1)
    total = np.bincount(owner, weight, len(texts))
    best = mass.argmax(axis=1)
    return [(model.langs[b], min(1.0, m / t)) if t > 0 else ("und", 0.0)
            for b, m, t in zip(best.tolist(), mass.max(axis=1).tolist(), total.tolist())]


class Characters:
    """Whether a learned language explains words: characters after the two before them in each
    language, against the share of each character in all of them, in any order."""

    def __init__(self, rows: list[tuple[str, str]], langs: list[str]):
        shape = SLOTS, max(1, len(langs))
        self.three, self.two, self.one = np.zeros(shape, np.float32), np.zeros(shape, np.float32), {}
        counts = Counter()
        for i, lang in enumerate(langs):
            words = [t for x, text in rows if x == lang for w in text.lower().split() if (t := trim(w))]
            if words:
                three, two, cp, _ = self._slots(words)
                self.three[:, i], self.two[:, i] = np.bincount(three, minlength=SLOTS), np.bincount(two, minlength=SLOTS)
                counts.update(dict(zip(*(x.tolist() for x in np.unique(cp, return_counts=True)))))
        self.total = sum(counts.values()) + 1.0
        self.one = {c: n / self.total for c, n in counts.items()}

    @staticmethod
    def _slots(words: list[str]) -> tuple[np.ndarray, ...]:
        """Slots of each character with the two before it, and of those two; the characters; sizes."""
        body = "".join([f"{chr(START) * 2}{w}{chr(END)}" for w in words])
        cp = np.frombuffer(body.encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        at = np.arange(size.sum()) + 2 * np.repeat(np.arange(1, len(words) + 1), size)
        two = (cp[at - 2] << np.uint64(21)) | cp[at - 1]
        three = mix64((two << np.uint64(21)) | cp[at])
        return *((x % np.uint64(SLOTS)).astype(np.int64) for x in (three, mix64(two))), cp[at], size

    def evidence(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of each word in its best language, less that of its characters alone."""
        if not words:
            return np.zeros(0)
        three, two, cp, size = self._slots(words)
        seen, inverse = np.unique(cp, return_inverse=True)
        alone = np.array([self.one.get(c, 2.0 ** -16 / self.total) for c in seen.tolist()])[inverse]
        ratio = (self.three[three] / alone[:, None] + BACK) / (self.two[two] + BACK)
        return np.add.reduceat(np.log(ratio), np.cumsum(size) - size, axis=0).max(axis=1)

    def of_texts(self, texts: list[str], known: dict[str, float]) -> list[float]:
        """Sum over each text's words; ``known`` holds those of earlier texts."""
        if len(known) > KNOWN_WORDS:
            known.clear()
        split = [t.lower().split() for t in texts]
        new = [w for w in dict.fromkeys(w for ws in split for w in ws) if w not in known]
        bare = [trim(w) for w in new]
        known.update(dict.fromkeys(new, 0.0))
        known.update(zip([w for w, t in zip(new, bare) if t], self.evidence([t for t in bare if t]).tolist()))
        return [sum(map(known.__getitem__, ws)) for ws in split]


def sample(docs: DataFrame, doc_id: str, text: str, lang: str) -> list[tuple[str, str]]:
    """Labelled rows for the fit, SAMPLE_CHARS characters a language at most."""
    at = F.xxhash64(doc_id, text)
    rows = (docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"), at.alias("at"), F.length(text).alias("n"))
            .where(f"lang is not null and n > 0 and n <= {SAMPLE_CHARS // 4}"))
    sizes = rows.groupBy("lang").agg(F.sum("n").alias("chars")).collect()  # one row a language
    if not sizes:
        return []
    cuts = docs.sparkSession.createDataFrame(
        [(r.lang, min(2**63 - 1, int(1.5 * SAMPLE_CHARS / r.chars * 2**63))) for r in sizes], "lang string, cut long")
    picked = rows.join(F.broadcast(cuts), "lang").where("(at & 9223372036854775807) <= cut").collect()
    out, used = [], Counter()
    for r in sorted(picked, key=lambda r: (r.at, r.text)):
        if used[r.lang] < SAMPLE_CHARS:
            used[r.lang] += r.n
            out.append((r.lang, r.text))
    return out


def identify_batches(batches: Iterator[pa.Array], model: Model, chars: Characters | None) -> Iterator[pa.Array]:
    """lang, score and, with ``chars``, evidence of each text, SLICE bytes at a time."""
    known: dict[str, float] = {}
    words, table = Words(), [np.zeros((0, len(model.langs)), np.float32), np.zeros(0)]
    for batch in batches:
        sizes = pc.binary_length(batch.cast(pa.binary())).fill_null(0).to_numpy(zero_copy_only=False)
        out, more = [], []
        for at, to in byte_slices(sizes + 1, SLICE):
            texts = as_texts(batch[at:to])
            out += predict_texts(texts, model, words, table) if model.langs else [
                (None if any(map(str.isalpha, t)) else "und", 0.0) for t in texts]
            more += chars.of_texts(texts, known) if chars else []
        yield pa.StructArray.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([y for _, y in out], pa.float64()),
                                          *([pa.array(more, pa.float64())] if chars else [])],
                                         ["lang", "score", *(["evidence"] if chars else [])])


def identify(docs: DataFrame, labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
             to: str = "language", evidence: bool = False) -> DataFrame:
    """Add ``to``: struct(lang string, score double), learned from ``labelled`` rows; with
    ``evidence`` also evidence double, above 0 where learned languages explain the words."""
    rows = sample(labelled, doc_id, text, lang)
    model = fit(rows)
    chars = Characters(rows, model.langs) if evidence else None

    @F.arrow_udf("struct<lang: string, score: double, evidence: double>" if evidence else "struct<lang: string, score: double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from identify_batches(batches, model, chars)
        release()

    return docs.withColumn(to, run(F.col(text)))


ship(__name__)
