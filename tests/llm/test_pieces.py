import random

import numpy as np
import pytest
import sentencepiece

from echofold.llm import pieces as pc
from echofold.llm.common import tokenizer_path

PATH = tokenizer_path(pc.MODEL)


@pytest.fixture(scope="module")
def both():
    with open(PATH, "rb") as f:
        return pc.Pieces(f.read()), sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts(n=300):
    rng = random.Random(5)
    words = "the and tion ing er éeau Straße año 東京 데이터 x1y2 == ... \n\t 𝄞 ▁ ﬁ <s> </s> <0x41> aaaa".split(" ")
    out = ["", " ", "  ", "a", "\n", "▁", " ▁a", "<s>", "é" * 50, "a" * 300, " " * 100, "x" + " " * 40 + "y", "\x00", "0123456789" * 20, "thethethe" * 30]
    for _ in range(n):
        out.append("".join(rng.choice(words) + rng.choice(["", " ", " ", "  "]) for _ in range(rng.randrange(1, 25))))
        out.append("".join(rng.choice("abcdeénst ▁\n1") for _ in range(rng.randrange(1, 60))))
    return out


def test_equals_the_library(both):
    mine, lib = both
    for t in texts():
        assert np.frombuffer(mine.encode(t), np.int32).tolist() == lib.encode(t), t
        ids = np.array(lib.encode(t), np.int32)
        assert mine.decode(ids) == lib.decode(ids.tolist()), t


def test_scan_over_chunks_equals_the_library(both):
    mine, lib = both
    rng = random.Random(8)
    cases = [t for t in texts(40) if len(t) > 40] + ["".join(rng.choice("abcdeirnst") for _ in range(2000)), "internationalization" * 60]
    for t in cases:
        text = pc.MARK + t.replace(" ", pc.MARK)
        for size in (37, 64, 500):
            n = max(1, len(text) // size)
            edges = [(k * size, len(text) if k == n - 1 else (k + 1) * size) for k in range(n)]
            cuts = pc.scan([mine.transfer(text, a, b, k == 0, k == n - 1) for k, (a, b) in enumerate(edges)])
            ids = [x for (a, b), s, e in zip(edges, cuts[:-1], cuts[1:], strict=True) for x in mine.trace(text, a, b, s, e).tolist()]
            assert ids == lib.encode(t), (t, size)


def test_product_is_associative(both):
    mine, _ = both
    text = pc.MARK + "associativelycombinedmatricesofalongword" * 8
    m = [mine.transfer(text, a, a + 64, a == 0, False) for a in (0, 64, 128)]
    assert pc.product(pc.product(m[0], m[1]), m[2]) == pc.product(m[0], pc.product(m[1], m[2]))


def test_tables(spark, both):
    _, lib = both
    rows = [(k, t) for k, t in enumerate(texts(20))] + [(900, None), (None, "null id " * 3000), (901, "w " * 40000), (901, "w " * 40000), (902, "q" * 9000), (903, "▁x " * 4000)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_tokens int")
    got = pc.encode(df, chunk=3000, with_ids=True)
    want = sorted(((d, None if t is None else len(lib.encode(t)), None if t is None else np.array(lib.encode(t), np.int32).tobytes()) for d, t in rows), key=str)
    out = got.collect()
    assert sorted(((r.doc_id, r.n_tokens, None if r.ids is None else bytes(r.ids)) for r in out), key=str) == want
    assert all(r.ids_hash == pc.signed(pc.digest(np.frombuffer(bytes(r.ids), np.int32))) for r in out if r.ids is not None)
    marked = {d for d, t in rows if t and pc.MARK in t}
    assert all(r.round_trip == (r.doc_id not in marked) for r in out if r.ids is not None)
    back = {r.doc_id: r.text for r in pc.decode(got).collect()}
    assert all(back[d] == t for d, t in rows if d not in marked)
    assert pc.encode(df.limit(0)).collect() == []
    full = pc.with_encoding(df.withColumnRenamed("n_tokens", "no"), chunk=3000)
    assert full.columns == ["doc_id", "text", "no", "n_tokens", "ids_hash", "round_trip", "ids"]
    assert sorted(((r.doc_id, r.text, r.no) for r in full.collect()), key=str) == sorted(((d, t, 0) for d, t in rows), key=str)
