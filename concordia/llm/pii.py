"""Personal data by fixed patterns and a linear-chain conditional random field.

The patterns (email, ip, card, phone) give the base spans, each kind's matches leftmost and
not overlapping. The field labels words by their shapes: the shape of the word and of its
neighbours, with the lengths of digit runs. It is trained on a small labelled table, by
default one generated from templates (`examples`), and adds spans that the patterns do not
reach: numbers without a plus, dotted cards, masked addresses. A decoded run of words becomes
a span if, trimmed and unmasked, it passes the exact check of its kind and overlaps no base
span; base spans always stay.

Decoding is Viterbi over whole texts in numpy batches. A word without a digit or one of
``@+[]()``, with two such neighbours, has one constant emission; if its margin for "outside"
exceeds all that transitions can win (checked, else no word is left out), the best path runs
through "outside" there, so the chain falls into independent pieces that are decoded together.

Defined cases: a null or empty text has no span; positions are code points, bytes that are no
UTF-8 count as U+FFFD; texts and words of any length are read whole, words over LONGEST code
points share one shape; repeated rows are each searched; extra columns stay, a column of the
result's name is replaced; an empty table gives an empty table; without labelled rows only
base spans are found."""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordia.llm.common import as_texts, byte_slices, ship

KINDS = ("email", "ip", "card", "phone")
OUT = 0  # tag of words outside; kind i has tag i + 1
TAGS = len(KINDS) + 1
LONGEST = 256
SLICE_BYTES = 1 << 20
LABELLED_ROWS = 4000  # labelled rows read at most, in the order of a hash
EPOCHS = 6
KNOWN = 100_000
CELLS = 1 << 18  # padded words a Viterbi batch

# The patterns of the base kinds. Possessive forms match alike, in linear time.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
NOT_DIGIT = re.compile(r"[^0-9]+")
AT = re.compile(r" ?(?:\[at\]|\(at\)|\[@\]|\(@\)) ?", re.I)
DOT = re.compile(r" ?(?:\[dot\]|\(dot\)|\[\.\]|\(\.\)) ?", re.I)


def luhn(digits: str) -> bool:
    """Whether 13 to 19 digits pass the check sum of card numbers."""
    if not 13 <= len(digits) <= 19:
        return False
    twice = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(int(d) for d in digits[::-2]) + sum(d - 9 * (d > 9) for d in twice)) % 10 == 0


def small_parts(ip: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in ip.split("."))


def _emails(s: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the run of local characters before each @, from the last match on."""
    done, at = 0, s.find("@")
    while at >= 0:
        if at >= done and (domain := DOMAIN.match(s, at + 1)):
            reach = 64
            while True:  # a longer look back while the run fills it
                low = max(done, at - reach)
                run = LOCAL_END.search(s[low:at]) if low < at else None
                if run is None or run.start() > 0 or low == done:
                    break
                reach *= 4
            if run:
                done = domain.end()
                yield low + run.start(), done
        at = s.find("@", at + 1)


def base_spans(s: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the pattern matches, by kind and start."""
    out = [(0, a, b) for a, b in _emails(s)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(s) if small_parts(m[0])]
    out += [(2, m.start(), m.end()) for m in CARD.finditer(s) if m.end() - m.start() >= 13 and luhn(NOT_DIGIT.sub("", m[0]))]
    if "+" in s:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(s) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def passes(kind: int, span: str) -> bool:
    """The exact check of an added span."""
    if kind == 0:
        return EMAIL.fullmatch(DOT.sub(".", AT.sub("@", span))) is not None
    if kind == 1:
        plain = DOT.sub(".", span)
        return IP.fullmatch(plain) is not None and small_parts(plain)
    digits = NOT_DIGIT.sub("", span)
    rest = set(span) - set("0123456789")
    if kind == 2:
        return rest <= set(" .-/_") and luhn(digits)
    return rest <= set(" ().+-/") and 10 <= len(digits) <= 15


# ---- shapes and features -----------------------------------------------------------------------
PLAIN = "w"
SHAPE = {**{c: "d" for c in range(48, 58)}, **{c: "X" for c in range(65, 91)}, **{c: "x" for c in range(97, 123)}}
RUNS = re.compile(r"d+|X+|x+|[^\x00-\x7f]+")
FLAGGED = "0123456789@+[]()"


def shape(word: str) -> str:
    """Letters collapsed by case, digit runs with their length, other signs as they are."""
    if len(word) > LONGEST:
        return "long"
    if not any(c in FLAGGED for c in word):
        return PLAIN
    low = word.lower()
    if "at" in low and low.strip("[](),.;") == "at" or "dot" in low and low.strip("[](),.;") == "dot":
        return low
    return RUNS.sub(lambda m: f"d{len(m[0])}" if m[0][0] == "d" else "o" if m[0][0] > "\x7f" else m[0][0], word.translate(SHAPE))


def features(before: str, own: str, after: str) -> list[str]:
    """Names of a word's features."""
    bare = NOT_DIGIT.sub("", own)
    runs = re.findall(r"d\d+", own)
    signs = re.sub(r"d\d+|[Xxow]", "", own)
    digits = sum(int(r[1:]) for r in runs)
    return [f"own {own}", f"before {before}", f"after {after}", f"pair {before} {own}", f"next {own} {after}",
            f"runs {'.'.join(runs)}", f"signs {signs}", f"digits {digits}", f"parts {len(runs)} {signs}", f"head {own[:1]}", f"tail {own[-1:]}",
            f"letters {'x' in own or 'X' in own} {bool(bare)}"]


@dataclass
class Model:
    names: dict[str, int]
    weights: np.ndarray  # features x tags
    trans: np.ndarray  # tags x tags; texts begin and end beside a word outside

    def emission(self, key: tuple[str, str, str]) -> np.ndarray:
        rows = [i for f in features(*key) if (i := self.names.get(f)) is not None]
        return self.weights[rows].sum(axis=0)

    def plain_is_out(self) -> bool:
        """Whether a plain word among plain words is outside on every best path."""
        e, t = self.emission((PLAIN, PLAIN, PLAIN)), self.trans
        win = t[:, :, None] + t[None, :, :] - (t[:, OUT][:, None, None] + t[OUT][None, None, :])
        return all(e[OUT] - e[s] > win[:, s].max() for s in range(TAGS) if s != OUT)


# ---- the small labelled table ----------------------------------------------------------------------
def examples(n: int = 2500, seed: int = 5) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Labelled rows from templates: (text, spans); plain words, personal data in usual and
    masked forms, and numbers that are none."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[int(rng.integers(0, len(x)))]
    num = lambda k: "".join(str(d) for d in rng.integers(0, 10, k))
    letters = lambda a, b: "".join(chr(97 + c) for c in rng.integers(0, 26, int(rng.integers(a, b))))

    def word() -> str:
        w = letters(1, 10)
        return pick(w, w, w, w.title(), w.upper()) + pick("", "", "", "", ",", ".")

    def card() -> str:
        d = "4" + num(int(pick(14, 14, 14, 13, 17)))
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = pick("", " ", "-", ".")
        return sep.join(d[i:i + 4] for i in range(0, len(d), 4))

    def email() -> str:
        at, dot = pick(("@", "."), ("@", "."), ("[at]", "[dot]"), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" (at) ", " (dot) "), ("[at]", "."), ("(at)", "."))
        local = pick(letters(2, 9), letters(2, 8) + "." + letters(2, 8), letters(2, 8) + "." + num(2), letters(3, 8) + num(3), letters(2, 6) + "_" + letters(2, 6))
        return local + at + dot.join([pick(letters(2, 9), letters(3, 6) + num(1)), *([pick("example", letters(3, 8))] if rng.random() < 0.5 else []), pick("com", "org", "de", "net")])

    def ip() -> str:
        return pick(".", ".", "[.]", "(.)", "[dot]").join(str(v) for v in rng.integers(0, pick(256, 256, 100, 20), 4))

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return pick(f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"({a}){b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1-{a}-{b}-{c}", f"+49 {num(2)} {num(7)}",
                    f"+33 {num(1)} {num(2)} {num(2)} {num(2)} {num(2)}", f"1-{a}-{b}-{c}", f"+{num(11)}", f"{a} {b}-{c}", f"+44 {num(4)} {num(6)}", f"001-{a}-{b}-{c}")

    def other() -> str:
        hexa = "".join("0123456789abcdef"[c] for c in rng.integers(0, 16, 40))
        return pick(f"{num(1)}.", f"{num(1)}.{num(1)}.", f"{num(4)}-{num(2)}-{num(2)}", f"{num(2)}:{num(2)}", f"{num(1)},{num(3)}.{num(2)}", "AKIA" + hexa[:16].upper(),
                    f'"{hexa}"', hexa, f"password={hexa[:18]}", f"[{num(2)}]", f"({num(1)})", f"({letters(1, 6)})", f"v{num(1)}.{num(1)}.{num(2)}", f"{num(1)}.{num(1)}.{num(1)}",
                    f"{num(3)}.{num(2)}.{num(1)}.{num(2)}.{num(1)}", letters(1, 4) + "+" + letters(1, 4), "C++", f"@{letters(3, 8)}", f"{letters(2, 5)}@{letters(2, 5)}", f"#{num(3)}",
                    f"{num(2)}-{num(2)}", f"{num(2)}%", f"{num(1)}x{num(1)}", num(5), num(8), num(4), f"{num(4)}-{num(4)}", f"{num(3)}/{num(2)}", f"+{num(2)}%", f"+{num(1)}", f"({num(4)})",
                    f"ISBN {num(3)}-{num(1)}-{num(2)}-{num(6)}-{num(1)}", f"${num(3)}.{num(2)}", f"{num(3)}-{num(2)}-{num(4)}", f"{num(3)}-{num(4)}", f"[{letters(2, 6)}]", f"f({letters(1, 3)})[{num(1)}]")

    made = {"email": email, "ip": ip, "card": card, "phone": phone}
    rows = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(int(rng.integers(1, 5))):
            text += "".join(f"{word()} " for _ in range(int(rng.integers(0, 6))))
            if rng.random() < 0.55:
                kind = pick(*KINDS)
                lead = pick("", "", "", "(", "<", '"', "tel:" if kind == "phone" else "")
                found = made[kind]()
                spans.append((kind, len(text) + len(lead), len(text) + len(lead) + len(found)))
                text += lead + found + pick("", "", "", ".", ",", ";", ")", ">") + " "
            else:
                text += other() + pick("", "", ".", ",") + " "
        rows.append((text + word(), spans))
    return rows


WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def fit(rows: list[tuple[str, list[tuple[str, int, int]]]]) -> Model:
    """Train by Adagrad on the log-likelihood of the labelled rows' tags."""
    names: dict[str, int] = {}
    keys: dict[tuple, int] = {}
    ids: list[list[int]] = []
    seqs, tags = [], []
    for text, spans in rows:
        found = list(WORDS.finditer(text))
        if not found:
            continue
        shapes = [PLAIN] + [shape(m[0]) for m in found] + [PLAIN]
        row = []
        for key in zip(shapes, shapes[1:], shapes[2:]):
            if key not in keys:
                keys[key] = len(ids)
                ids.append([names.setdefault(f, len(names)) for f in features(*key)])
            row.append(keys[key])
        seqs.append(row)
        tags.append([next((KINDS.index(k) + 1 for k, a, b in spans if a < m.end() and m.start() < b), OUT) for m in found])
    model = Model(names, np.zeros((len(names), TAGS)), np.zeros((TAGS, TAGS)))
    if not seqs:
        return model
    table = np.array(ids)  # every key has as many features
    order = np.argsort([len(s) for s in seqs], kind="stable")
    rng = np.random.default_rng(1)
    batches = [order[i:i + 64] for i in range(0, len(order), 64)]
    g_w, g_t = np.full_like(model.weights, 1e-3), np.full((TAGS, TAGS), 1e-3)
    for _ in range(EPOCHS):
        for b in rng.permutation(len(batches)):
            mine = batches[b]
            long = max(len(seqs[i]) for i in mine)
            x, y = np.zeros((len(mine), long), np.int64), np.full((len(mine), long), OUT)
            real = np.zeros((len(mine), long), bool)
            for r, i in enumerate(mine):
                x[r, :len(seqs[i])], y[r, :len(seqs[i])], real[r, :len(seqs[i])] = seqs[i], tags[i], True
            emit = model.weights[table[x]].sum(axis=2)
            gamma, pairs = marginals(emit, real, model.trans)
            diff = (np.eye(TAGS)[y] - gamma) * real[..., None] / len(mine)
            flat = table[x[real]].ravel()
            grad = np.stack([np.bincount(flat, np.repeat(diff[real][:, c], table.shape[1]), len(names)) for c in range(TAGS)], 1)
            seen = np.zeros((TAGS, TAGS))
            ends = real.sum(axis=1) - 1
            np.add.at(seen, (OUT, y[:, 0]), 1)
            np.add.at(seen, (y[np.arange(len(mine)), ends], OUT), 1)
            np.add.at(seen, (y[:, :-1][real[:, 1:]], y[:, 1:][real[:, 1:]]), 1)
            grad -= 1e-5 * model.weights
            d_t = (seen - pairs) / len(mine) - 1e-5 * model.trans
            g_w += grad ** 2
            g_t += d_t ** 2
            model.weights += 0.3 * grad / np.sqrt(g_w)
            model.trans += 0.1 * d_t / np.sqrt(g_t)
    return model


def marginals(emit: np.ndarray, real: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of padded sequences, and the expected transitions, both ends included."""
    b, t, k = emit.shape
    m = np.exp(trans)
    e = np.exp(emit - emit.max(axis=2, keepdims=True))
    alpha, beta = np.zeros((b, t, k)), np.zeros((b, t, k))
    run = m[OUT] * e[:, 0]
    alpha[:, 0] = run / run.sum(axis=1, keepdims=True)
    for i in range(1, t):
        run = (alpha[:, i - 1] @ m) * e[:, i]
        alpha[:, i] = np.where(real[:, i, None], run / run.sum(axis=1, keepdims=True), alpha[:, i - 1])
    last = real.sum(axis=1) - 1
    beta[:, t - 1] = m[:, OUT]
    for i in range(t - 2, -1, -1):
        run = (beta[:, i + 1] * e[:, i + 1]) @ m.T
        beta[:, i] = np.where((last > i)[:, None], run / run.sum(axis=1, keepdims=True), m[:, OUT])
    gamma = alpha * beta
    gamma /= gamma.sum(axis=2, keepdims=True)
    pairs = np.zeros((k, k))
    pairs[OUT] += gamma[:, 0].sum(axis=0)
    pairs[:, OUT] += gamma[np.arange(b), last].sum(axis=0)
    for i in range(t - 1):
        xi = alpha[:, i, :, None] * m * (e[:, i + 1] * beta[:, i + 1])[:, None, :]
        xi = xi[real[:, i + 1]]
        pairs += (xi / xi.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return gamma, pairs


# ---- decoding ------------------------------------------------------------------------------------------
def viterbi(emit: np.ndarray, lens: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best tags of pieces laid end to end (emit: all words x tags; lens: words a piece), each
    between words outside; ties go to the lower tag. Pieces of similar length go together."""
    out = np.zeros(len(emit), np.int8)
    starts = np.cumsum(lens) - lens
    order = np.argsort(lens, kind="stable")
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and (to + 1 - at) * int(lens[order[to]]) <= CELLS:
            to += 1
        mine = order[at:to]
        n, begin = lens[mine], starts[mine]
        long = int(n[-1])
        back = np.zeros((long, len(mine), TAGS), np.int8)
        score = trans[OUT] + emit[begin]
        for i in range(1, long):
            live = int(np.searchsorted(n, i, "right"))  # pieces from here on have a word i
            paths = score[live:, :, None] + trans
            back[i, live:] = paths.argmax(axis=1)
            score[live:] = paths.max(axis=1) + emit[begin[live:] + i]
        tag = (score + trans[:, OUT]).argmax(axis=1)
        for i in range(long - 1, -1, -1):
            live = int(np.searchsorted(n, i, "right"))
            out[begin[live:] + i] = tag[live:]
            if i:
                tag[live:] = back[i, np.arange(live, len(mine)), tag[live:]]
        at = to
    return out


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(9, 14)]] = True
IS_FLAG = np.zeros(256, bool)
IS_FLAG[[ord(c) for c in FLAGGED]] = True
TRIM_LEFT = "<\"'{,;:!?=*"
TRIM_RIGHT = ">\"'},;:!?=*."


class Decoder:
    """Tags words of joined texts; emissions are kept by the shapes of three words."""

    def __init__(self, model: Model):
        self.model, self.sparse = model, model.plain_is_out()
        self.rows: dict[tuple, int] = {}
        self.table: list[np.ndarray] = []

    def emit(self, keys: list[tuple]) -> np.ndarray:
        if len(self.rows) > KNOWN:
            self.rows, self.table = {}, []
        at = []
        for key in keys:
            if (row := self.rows.get(key)) is None:
                row = self.rows[key] = len(self.table)
                self.table.append(self.model.emission(key))
            at.append(row)
        return np.array(self.table)[at]

    def added(self, s: str, bounds: np.ndarray) -> list[tuple[int, int, int]]:
        """(kind, start, end) of decoded spans of the texts that begin at ``bounds``."""
        low = np.minimum(np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4"), 255).astype(np.uint8)
        space = IS_SPACE[low]
        flags = np.flatnonzero(IS_FLAG[low])
        if not len(flags):
            return []
        starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]])).astype(np.int64)
        ends = np.flatnonzero(~space & np.concatenate([space[1:], [True]])).astype(np.int64) + 1
        del low, space
        hit = np.unique(np.searchsorted(starts, flags, "right") - 1)
        near = np.arange(len(starts)) if not self.sparse else np.unique(np.clip(np.concatenate([hit - 1, hit, hit + 1]), 0, len(starts) - 1))
        text = np.searchsorted(bounds, starts[near], "right")
        shapes = dict(zip(hit.tolist(), (shape(s[a:b]) for a, b in zip(starts[hit].tolist(), ends[hit].tolist()))))
        first = np.concatenate([[True], (near[1:] != near[:-1] + 1) | (text[1:] != text[:-1])])
        edge = {int(w) for w in near[first]}
        # a neighbour in another text counts as a plain word
        owner = np.searchsorted(bounds, starts, "right") if len(bounds) > 1 else np.zeros(len(starts), np.int64)
        keys = []
        for w in near.tolist():
            a = shapes.get(w - 1, PLAIN) if w and owner[w - 1] == owner[w] else PLAIN
            b = shapes.get(w + 1, PLAIN) if w + 1 < len(owner) and owner[w + 1] == owner[w] else PLAIN
            keys.append((a, shapes.get(w, PLAIN), b))
        begin = np.flatnonzero(first)
        tags = viterbi(self.emit(keys), np.diff(np.append(begin, len(near))), self.model.trans)
        out = []
        at = 0
        where = np.flatnonzero(tags)
        while at < len(where):
            to = at + 1
            while to < len(where) and where[to] == where[to - 1] + 1 and tags[where[to]] == tags[where[at]] and int(near[where[to]]) not in edge:
                to += 1
            kind = int(tags[where[at]]) - 1
            a, b = trimmed(s, int(starts[near[where[at]]]), int(ends[near[where[to - 1]]]), kind)
            if b > a and passes(kind, s[a:b]):
                out.append((kind, a, b))
            at = to
        return out


def trimmed(s: str, a: int, b: int, kind: int) -> tuple[int, int]:
    """Without leading labels, quotes and unpaired brackets, and without trailing signs."""
    label = re.match(r"(?:mailto|tel|phone|fax|ip|email|e-mail|card):", s[a:min(b, a + 16)], re.I)
    a += label.end() if label else 0
    while a < b:
        if s[a] in TRIM_LEFT or s[a] == "(" and s.count("(", a, b) > s.count(")", a, b):
            a += 1
        elif s[b - 1] in TRIM_RIGHT or s[b - 1] == ")" and s.count("(", a, b) < s.count(")", a, b):
            b -= 1
        elif kind != 0 and s[a] == "(" and s[b - 1] == ")" and kind != 3:
            a, b = a + 1, b - 1
        else:
            break
    if kind == 1 and (port := re.search(r":[0-9]{1,5}\Z", s[a:b])):
        b -= len(port[0])
    return a, b


def spans(texts: list[str], decoder: Decoder | None) -> list[list[tuple[int, int, int, bool]]]:
    """(kind, start, end, base) of each text, by kind and start."""
    out: list[list] = [[] for _ in texts]
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    s = "\n".join(texts)  # no pattern and no word crosses a line end
    base = base_spans(s)
    found = [(*b, True) for b in base]
    if decoder is not None:
        taken = sorted((a, b) for _, a, b in base)
        at = 0
        for kind, a, b in decoder.added(s, bounds):  # in order of their places
            while at < len(taken) and taken[at][1] <= a:
                at += 1
            later = at
            while later < len(taken) and taken[later][0] < b and taken[later][1] <= a:
                later += 1
            if later == len(taken) or taken[later][0] >= b:
                found.append((kind, a, b, False))
    for kind, a, b, is_base in sorted(found):
        i = int(np.searchsorted(bounds, a, "right")) - 1
        out[i].append((kind, a - int(bounds[i]), b - int(bounds[i]), is_base))
    return out


def labelled_rows(table: DataFrame) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """At most LABELLED_ROWS rows of a table (text, spans: array of kind, start, end)."""
    rows = table.where("text is not null").select("text", "spans").orderBy(F.xxhash64("text"), "text").limit(LABELLED_ROWS).collect()
    return [(r.text, [(p.kind, p.start, p.end) for p in r.spans or []]) for r in rows]


def find(docs: DataFrame, labelled: DataFrame | None = None, text: str = "text", to: str = "pii") -> DataFrame:
    """Add ``to``: array of (kind, start, end, base), by kind as in KINDS, then start; the field
    is trained on ``labelled`` or, without it, on generated rows."""
    rows = labelled_rows(labelled) if labelled is not None else examples()
    model = fit(rows)

    @F.arrow_udf("array<struct<kind: string, start: long, end: long, base: boolean>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = Decoder(model) if rows else None
        names = np.array(KINDS, object)
        for batch in batches:
            sizes = pc.binary_length(batch.cast(pa.binary())).fill_null(0).to_numpy(zero_copy_only=False)
            found = []
            for at, end in byte_slices(sizes + 1, SLICE_BYTES):
                found += spans(as_texts(batch[at:end]), decoder)
            flat = [x for f in found for x in f]
            kind, a, b, base = zip(*flat) if flat else ((), (), (), ())
            values = pa.StructArray.from_arrays([pa.array(names[list(kind)].tolist() if kind else [], pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                                                 pa.array(base, pa.bool_())], ["kind", "start", "end", "base"])
            offsets = np.cumsum([0] + [len(f) for f in found]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), values)

    return docs.withColumn(to, run(F.col(text)))


def listed(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


ship(__name__)
