import random
import zlib

import numpy as np

from echofold.llm import langid, toxicity
from echofold.llm.common import byte_words

DIR = "/root/testdata/sf0.1"


def test_pairs_against_brute_force():
    rng = np.random.default_rng(1)
    w, v = rng.normal(size=9), rng.normal(size=(9, 3))
    rows = [np.array([1, 4, 8]), np.zeros(0, int), np.array([2])]
    got = toxicity.linear_and_pairs(w, v, np.concatenate(rows).astype(int), np.array([3, 0, 1]))
    want = [sum(w[i] for i in r) + sum(v[a] @ v[b] for k, a in enumerate(r) for b in r[:k]) for r in rows]
    assert np.allclose(got, want)


def test_machine_learns_an_interaction():
    """Toxic only where both words meet: no additive weights can say that."""
    rng = random.Random(3)
    rows, y = [], []
    for _ in range(600):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        text = " ".join(rng.choice("klmnopqrst") * 3 for _ in range(20)) + " alpha" * a + " beta" * b
        rows.append(toxicity.terms(text.encode()))
        y.append(a and b)
    m = toxicity.fit(rows, np.array(y))
    assert ((m.score(rows) >= 0.7) == np.array(y)).mean() > 0.99


def pair_texts(seed, toxic=1000, other=5000, both=17, alone=85):
    """Five pairs of words: together toxic, alone clean, each word as frequent in toxic as in other texts."""
    rng = random.Random(seed)
    fill = lambda: [f"w{int(1500 * rng.random() ** 2)}" for _ in range(40)]
    rows = []
    for p in range(5):
        rows += [([f"a{p}a", f"b{p}b"], 1, True) for _ in range(both)]
        rows += [([w], 0, True) for w in (f"a{p}a", f"b{p}b") for _ in range(alone)]
    rows += [(["vile"], 1, False)] * (toxic - 5 * both) + [([], 0, False)] * (other - 10 * alone)
    rows = [(toxicity.terms(" ".join(fill() + w).encode()), y, has) for w, y, has in rows]
    return [r for r, _, _ in rows], np.array([y for _, y, _ in rows]), np.array([h for _, _, h in rows])


def test_machine_learns_pairs_without_marginal_signal():
    rows, y, _ = pair_texts(1)
    m = toxicity.fit(rows, y)
    rows, y, has = pair_texts(2)
    got = m.score(rows) >= 0.7
    assert (got == y)[has].mean() > 0.95 and got[has & (y == 1)].mean() > 0.9 and (got == y).mean() > 0.98


def test_machine_learns_what_weights_cannot():
    """Either word alone is toxic, both together are not."""

    def draw(seed):
        rng = random.Random(seed)
        out = []
        for _ in range(2500):
            u = rng.random()
            extra = ["left"] if u < 0.08 else ["right"] if u < 0.16 else ["left", "right"] if u < 0.32 else []
            words = [f"w{int(800 * rng.random() ** 2)}" for _ in range(40)] + extra
            out.append((toxicity.terms(" ".join(words).encode()), len(extra) == 1, bool(extra)))
        rows, y, has = zip(*out, strict=True)
        return list(rows), np.array(y), np.array(has)

    rows, y, _ = draw(1)
    m = toxicity.fit(rows, y)
    assert m.v.any()
    rows, y, has = draw(2)
    assert ((m.score(rows) >= 0.7) == y)[has].mean() > 0.95


def test_sliced_sums():
    rng = np.random.default_rng(4)
    rows = [np.sort(rng.permutation(50)[: rng.integers(0, 30)]).astype(np.int32) for _ in range(40)]
    before, toxicity.SLICE = toxicity.SLICE, 64
    try:
        t = toxicity.Texts(rows)
    finally:
        toxicity.SLICE = before
    assert len(t.parts) > 3
    w, g = rng.normal(size=50), rng.normal(size=40)
    assert np.allclose(t.sums(w), [w[r].sum() for r in rows])
    assert np.allclose(t.by_term(g, 50), [sum(x for x, r in zip(g, rows, strict=True) if k in r) for k in range(50)])
    at, term = map(np.concatenate, zip(*t.only(np.arange(50) < 9), strict=True))
    assert sorted(zip(at, term, strict=True)) == [(i, k) for i, r in enumerate(rows) for k in r if k < 9]


def test_repeated_ids_are_sampled_once(spark):
    """One id many times, with many texts: the sample stays within its bound."""
    docs = spark.range(20_000).selectExpr("1L as doc_id", "concat('vile ', id % 50) as text")
    docs = docs.unionByName(spark.range(2, 40).selectExpr("id as doc_id", "if(id % 2 = 0, 'fine words', 'vile words') as text"))
    labels = spark.range(1, 40).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    sizes = []
    whole, toxicity.fit = toxicity.fit, lambda rows, y, bits: sizes.append((len(rows.size), int(y.sum()))) or whole(rows, y, bits)
    try:
        toxicity.train(docs, labels, sample=30)
    finally:
        toxicity.fit = whole
    assert sizes[0][0] == 30 and 0 < sizes[0][1] < 30


def test_toxicity_of_repeated_rows_and_ties(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    one = {r.doc_id: tuple(r) for r in toxicity.held_out(docs, labels).collect()}
    for r in toxicity.held_out(docs.union(docs), labels.union(labels)).collect():
        assert one[r.doc_id] == tuple(r)


def test_toxicity_on_the_tables(spark):
    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.held_out(docs, labels).toPandas().merge(labels.select("doc_id", "toxic").toPandas(), on="doc_id")
    assert all(got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id])
    out = got[got.held_out]
    assert (out.predicted == out.toxic).mean() > 0.95
    tp = ((out.predicted == 1) & (out.toxic == 1)).sum()
    assert tp / out.toxic.sum() > 0.8 and tp / out.predicted.sum() > 0.9


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "w " * 200000), (3, "w")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {(r.score < 0.01, r.predicted) for r in toxicity.held_out(docs, none).collect()} == {(True, 0)}
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (3, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    assert toxicity.held_out(docs, labels).count() == 5
    assert toxicity.held_out(docs.limit(0), labels).collect() == []


def test_reject_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "bad bad", 5, "a"), (2, "fine", 6, "b"), (3, None, 7, "c")], "doc_id long, text string, Score int, predicted string")
    rows = [toxicity.terms(t) for t in (b"bad", b"bad", b"bad", b"good", b"nice", b"fine")]
    kept = toxicity.reject(docs, toxicity.fit(rows, np.array([1, 1, 1, 0, 0, 0])))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]


def test_folding_equals_the_kernel():
    texts = [b"der hund und die katze", b"the dog and the cat", "le chien été".encode(), b"a cat", b"die"] * 3
    langs = ["de", "en", "fr", "en", "de"] * 3
    scratch = np.zeros(1 << langid.SLOT_BITS, bool)
    rows = [langid.grams(t, scratch) for t in texts]
    assert not scratch.any()
    k = langid.fit(rows, langs)
    gram = np.array([[len(np.intersect1d(a, b)) / np.sqrt(len(a) * len(b)) for b in rows] for a in rows])
    y = np.array([[1.0 if x == n else -1.0 for n in k.langs] for x in langs])
    f = np.stack([k.table[k.place[r]].sum(0) / np.sqrt(len(r)) for r in rows]) + k.offset
    assert np.abs(k.margins(rows) - f).max() < 1e-5
    # with all texts as landmarks, the fit is kernel ridge regression itself
    full = gram @ np.linalg.solve(gram + langid.RIDGE * len(rows) * np.eye(len(rows)), y - y.mean(0)) + y.mean(0)
    assert np.abs(f - full).max() < 0.05
    assert k.predict([None, b"", b"12 .", "é".encode(), b"the cat"])[0][:3] == ["und"] * 3
    assert k.predict([b"the cat"])[0] == ["en"]


def test_language_on_the_tables(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    got = langid.held_out(docs).toPandas().merge(docs.select("doc_id", "lang", "text").toPandas(), on="doc_id")
    assert all(got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id])
    out = got[got.held_out & got.lang.notna()]
    long = out[[len(byte_words(t.encode())) >= 5 for t in out.text]]
    assert (long.lang_pred == long.lang).mean() > 0.95
    assert got.score.between(0, 1).all()
    assert langid.held_out(docs.limit(0)).collect() == []


def test_every_language_is_learned(spark):
    """A rare language whose one row repeats, beside a common one; null and empty rows; clashing columns."""
    common = spark.range(200).selectExpr("id as doc_id", "'the cat and the dog' as text", "'en' as lang")
    for k in range(6):
        rare = spark.range(5000).selectExpr(f"{1000 + k}L as doc_id", "'zzyx qqorv zzyx vraq' as text", "'xx' as lang")
        odd = spark.createDataFrame([(None, "zz", "qq"), (5000, None, "nn"), (5001, "12 .", "dd"), (5002, "some words", None), (5003, "", "ee")], "doc_id long, text string, lang string")
        docs = common.unionByName(rare).unionByName(odd).selectExpr("*", "1 as lang_pred", "2 as score")
        assert langid.train(docs).langs == ["en", "xx"]
    kernel = langid.train(docs)
    got = {r.doc_id: r for r in langid.predict(docs, kernel).collect()}
    assert got[1005].lang_pred == "xx" and got[3].lang_pred == "en" and got[5000].lang_pred == got[5001].lang_pred == "und"
    assert langid.predict(docs, kernel).count() == 5205 and set(got[3].asDict()) == {"doc_id", "lang_pred", "score"}


def test_many_languages_share_the_sample(spark):
    docs = spark.range(900).selectExpr("id as doc_id", "concat('w', translate(string(id % 300 + 1000), '0123456789', 'abcdefghij'), ' v', translate(string(id % 300 + 1000), '0123456789', 'klmnopqrst')) as text", "concat('l', id % 300) as lang")
    k = langid.train(docs, sample=600)
    assert len(k.langs) == 300
    assert langid.share(600, 400, 300) == 8 and langid.share(40_000, 400, 4) == 400
    got = langid.predict(docs.join(spark.range(300).withColumnRenamed("id", "doc_id"), "doc_id"), k).collect()
    assert sum(r.lang_pred == f"l{r.doc_id % 300}" for r in got) > 290


def test_language_ties_and_long_texts(spark):
    docs = spark.createDataFrame([(1, "same words", "b"), (2, "same words", "a"), (3, "the cat " * 300_000, "c")], "doc_id long, text string, lang string")
    k = langid.train(docs)
    assert k.langs == ["a", "b", "c"] and k.predict([b"same words"])[0] == ["a"]
    assert k.predict([b"the cat " * 300_000])[0] == ["c"]
