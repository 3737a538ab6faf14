import tracemalloc
import zlib

import numpy as np
import pyarrow as pa

from concordia.llm import langid
from concordia.llm.queries import op8_langid

SF = "/root/testdata/sf0.01"


def brute(emit, trans):
    """Posteriors by enumerating all label sequences."""
    n, k = emit.shape
    post = np.zeros((n, k))
    for code in range(k ** n):
        y = [(code // k ** i) % k for i in range(n)]
        m = np.exp(trans)
        p = np.prod([np.exp(emit[i, y[i]]) for i in range(n)]) * np.full(k, 1 / k) @ m[:, y[0]]
        for a, b in zip(y, y[1:]):
            p *= m[a, b]
        for i in range(n):
            post[i, y[i]] += p
    return post / post.sum(axis=1, keepdims=True)


def test_posteriors_by_enumeration(monkeypatch):
    rng = np.random.default_rng(3)
    trans = rng.normal(size=(3, 3))
    counts = np.array([5, 0, 1, 7, 4])
    emit = rng.normal(size=(int(counts.sum()), 3))
    want = np.concatenate([brute(emit[a:b], trans) for a, b in zip(np.cumsum(counts) - counts, np.cumsum(counts)) if b > a])
    for block in (1, 2, 3, 64):
        monkeypatch.setattr(langid, "BLOCK", block)
        assert np.allclose(langid.posteriors(emit, counts, trans), want)
    got, _ = langid.forward_backward(emit[6:13][None], trans)
    assert np.allclose(got[0], brute(emit[6:13], trans))


def test_held_out_accuracy_and_code_switching(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = op8_langid(spark, SF).collect()
    assert len(out) == len(docs)
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in out)
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) >= 0.97
    model = langid.fit([(d.lang, d.text) for d in docs.values() if zlib.crc32(str(d.doc_id).encode()) % 4 != 2])
    by = {x: [w for d in docs.values() if d.lang == x for w in d.text.split()][:400] for x in ("en", "de", "es")}
    mixed = by["en"][:20] + by["de"][:20] + by["es"][:20]
    e = langid.emissions([langid.trim(w.lower()) for w in mixed], model).astype(float)
    tags = langid.posteriors(e, np.array([60]), model.trans).argmax(axis=1)
    want = [model.langs.index(x) for x in ("en", "de", "es") for _ in range(20)]
    assert np.mean(tags == want) >= 0.85


def test_odd_rows(spark):
    rows = [(1, "the cat and the dog " * 30, "en"), (2, "der hund und die katze " * 30, "de"), (3, None, "en"), (4, "", None),
            (5, "123 $$$ 45", "en"), (6, "der und die", None), (6, "der und die", None), (None, "the and the", None),
            (7, "the " * 20_000, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, language string")
    out = langid.identify(df, df).select("doc_id", "language.*").collect()
    got = sorted(((r.doc_id, r.lang) for r in out), key=repr)
    assert got == sorted([(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (6, "de"), (6, "de"), (None, "en"), (7, "en")], key=repr)
    assert langid.identify(df.limit(0), df).count() == 0
    unlearned = {r.doc_id: r.language.lang for r in langid.identify(df, df.limit(0)).collect()}
    assert unlearned[1] is None and unlearned[3] == unlearned[5] == "und"


def test_arrays_hold_a_slice_of_a_batch():
    rows = [("en", "the cat and the dog " * 30), ("de", "der hund und die katze " * 30)]
    model = langid.fit(rows)
    chars = langid.Characters(rows, model.langs)
    batch = pa.array([" ".join(f"w{i * 250 + j:x}" for j in range(250)) for i in range(1500)])  # 375,000 distinct words, 2.2 MB
    peak, out, own = [], [], langid.SLICE
    try:
        for langid.SLICE in (own, 1 << 30):
            tracemalloc.start()
            out += langid.identify_batches([batch], model, chars)
            peak.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
    finally:
        langid.SLICE = own
    assert peak[0] < 0.5 * peak[1] and len(out[0]) == len(out[1]) == 1500
    for name in ("score", "evidence"):
        assert np.allclose(*(x.field(name).to_numpy() for x in out))
    assert out[0].field("lang") == out[1].field("lang")
