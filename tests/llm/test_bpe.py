import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import zlib

from concordia.llm import bpe
from concordia.llm.queries import op2_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def known():
    ranks = bpe.load_ranks(PATH)
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def parts():
    return np.frombuffer(zlib.decompress(bpe.class_table()), np.uint8), bpe.scanner()


TEXTS = ["", " ", "a", "  a", "a  ", "don't  we'll I've 's 'tis ''s x's's", "\n\n a\t\tb \n", "12 34a5 'd'", "$$$ '''re %%%&",
         "é ñandú  straße’s", "a b 　 c", "日本語 テキスト १२३", "👩‍👩‍👧 ok", "x" * 3000, "ab" * 999, " " * 777 + "z", "'" * 50 + "s",
         "we'r e'l l'v", "\r\n'S 'S'T", "a'", "'", " '", "it's\u0085'm"]


def random_texts(n, seed=1):
    r = random.Random(seed)
    pool = list("abst mdrevl''' \n\t  12é，$%.  ñ日")
    return ["".join(r.choice(pool) for _ in range(r.randrange(0, 60))) for _ in range(n)]


def test_matches_the_library(known, parts):
    ranks, enc = known
    texts = TEXTS + random_texts(3000)
    ids, ends = bpe.encode_texts(texts, *parts, bpe.PieceIds(ranks))
    got = [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends)]
    assert got == [enc.encode_ordinary(t) for t in texts]


def test_every_code_point_has_the_librarys_class(known, parts):
    ranks, enc = known
    odd = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and c % 7 == 0 or c < 0x3100]
    texts = [f"a{chr(c)}1{chr(c)}{chr(c)}. {chr(c)}" for c in odd if not 0xD800 <= c < 0xE000]
    ids, ends = bpe.encode_texts(texts, *parts, bpe.PieceIds(ranks))
    bad = [t for t, a, b in zip(texts, [0, *ends[:-1]], ends) if ids[a:b].tolist() != enc.encode_ordinary(t)]
    assert not bad, (len(bad), bad[:5])


def test_small_windows_give_the_same_slices(parts):
    for text in TEXTS + random_texts(200, 2):
        whole = [p for ps, _ in bpe.slices([text], *parts) for p in ps]
        assert whole == [p for ps, _ in bpe.slices([text], *parts, window=4) for p in ps]
        assert b"".join(whole) == text.encode()


def test_query_round_trip(spark, known, tmp_path):
    _, enc = known
    texts = [None, *TEXTS, *random_texts(50)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, "a", "x"), (None, "b", None)]
    spark.createDataFrame(rows, "doc_id long, text string, bpe string").write.parquet(f"{tmp_path}/documents.parquet")
    out = op2_bpe(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    by = {r[0]: r[1] for r in rows[:len(texts)]}
    for r in out:
        t = "b" if r.doc_id is None else by[r.doc_id] or ""
        ids = enc.encode_ordinary(t)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_offsets_and_empty_table(spark):
    df = spark.createDataFrame([(1, "don't stop"), (2, None)], "doc_id long, text string")
    r = bpe.decode(bpe.encode(df, PATH), PATH).orderBy("doc_id").collect()
    assert r[0].bpe.ends[-1] == 10 and bytes(r[0].decoded) == b"don't stop"
    assert r[1].bpe.ids == [] and bytes(r[1].decoded) == b""
    assert bpe.encode(df.limit(0), PATH).count() == 0


def test_merging_together_equals_one_by_one(known):
    ranks = known[0]
    r, tokens = random.Random(3), list(ranks)
    pieces = {b"".join(r.choice(tokens)[:r.randrange(1, 5)] for _ in range(r.randrange(1, 8)))[:bpe.WIDEST] for _ in range(6000)}
    pieces |= {bytes(r.randrange(256) for _ in range(r.randrange(1, bpe.WIDEST + 1))) for _ in range(3000)}
    pieces |= {bytes([c]) * n for c in b" ab\xc3" for n in range(1, bpe.WIDEST + 1)}
    cache = bpe.PieceIds(ranks)
    cache.learn(list(pieces))
    assert set(cache) == pieces and all(cache[p] == bpe.merge(p, ranks) for p in pieces)
