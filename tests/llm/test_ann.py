import numpy as np
from pyspark.sql import functions as F

from echofold.llm import ann

SCHEMA = "vec_id long, embedding array<float>, score int"


def brute(rows, every, k=5):
    ok = {}
    for i, v, *_ in rows:
        if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = np.array(v, np.float32).astype(np.float64)
    out = {}
    for i in ok:
        if i % every == 0:
            s = sorted((-round(float((ok[i] * ok[j]).sum() / np.sqrt((ok[i] ** 2).sum()) / np.sqrt((ok[j] ** 2).sum())), 12), j) for j in ok if j != i)
            out[i] = [j for _, j in s[:k]]
    return out


def rows(n=400, same=150):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(12, 8))
    data = [(k, (centre[k % 12] + 0.4 * rng.normal(size=8)).astype(np.float32).tolist(), 0) for k in range(n)]
    hot = data[7][1]
    data += [(1000 + k, hot, 0) for k in range(same)]
    odd = [(2000, None, 0), (2050, [0.0] * 8, 0), (2100, [float("nan")] * 8, 0), (2150, [None] * 8, 0), (None, hot, 0), (2200, [1.0], 0), (2250, [], 0)]
    return data + odd + data[50:52]


def test_full_width_equals_brute_force(spark):
    data = rows()
    got = ann.nearest(spark.createDataFrame(data, SCHEMA), F.col("id") % 50 == 0, target=1.1).collect()
    want = brute(data, 50)
    out = {}
    for r in sorted(got):
        out.setdefault(r.query_id, []).append(r.vec_id)
    assert out == want
    assert sorted({r["rank"] for r in got}) == [1, 2, 3, 4, 5]


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 10)
    data = rows(200, 30)
    got = ann.nearest(spark.createDataFrame(data, SCHEMA), F.col("id") % 10 == 0, target=1.1)
    out = {}
    for r in sorted(got.collect()):
        out.setdefault(r.query_id, []).append(r.vec_id)
    assert out == brute(data, 10)


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    pdf = df.toPandas()
    x = ann.unit(np.stack(pdf.embedding))
    ids = pdf.vec_id.to_numpy()
    got = ann.nearest(df, F.col("id") % 50 == 0).toPandas()
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = x @ x[q]
        s[q] = -2
        true = set(ids[np.argsort(-s)[:5]])
        hits += len(true & set(got[got.query_id == ids[q]].vec_id))
        total += 5
    assert hits / total >= 0.9


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [1.0, 1.0], 1)], SCHEMA)
    assert [(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in ann.nearest(df, F.col("id") % 50 == 0).collect()] == [(0, 1, 1, round(0.5**0.5, 9))]
    assert ann.nearest(df.limit(0), F.col("id") % 50 == 0).collect() == []
    assert ann.nearest(df.limit(1), F.col("id") % 50 == 0).collect() == []


def test_small_leaves_give_k_rows(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(40, 8))
    data = [(k, (centre[k % 40] + 0.01 * rng.normal(size=8)).tolist(), 0) for k in range(120)]
    got = ann.nearest(spark.createDataFrame(data, SCHEMA), F.col("id") % 10 == 0, target=0.3, leaves=40).collect()
    assert sorted((r.query_id, r["rank"]) for r in got) == [(q, r) for q in range(0, 120, 10) for r in range(1, 6)]


def test_every_length_takes_part(spark, monkeypatch):
    """Vectors of three lengths, one too rare for the sample, in small blocks on both sides."""
    monkeypatch.setattr(ann, "BLOCK", 16)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 3)
    monkeypatch.setattr(ann, "LEAST_SAMPLE", 40)
    rng = np.random.default_rng(8)
    data = [(k, rng.normal(size=8 if k % 3 else 5 if k % 2 else 3).astype(np.float32).tolist(), 0) for k in range(300)]
    got = ann.nearest(spark.createDataFrame(data, SCHEMA), F.col("id") % 10 == 0, target=1.1, sample=60)
    out, want = {}, {}
    for r in sorted(got.collect()):
        out.setdefault(r.query_id, []).append(r.vec_id)
    for n in (3, 5, 8):
        mine = {i: np.array(v) for i, v, _ in data if len(v) == n}
        for i in mine:
            if i % 10 == 0:
                s = sorted((-float(mine[i] @ mine[j] / np.linalg.norm(mine[i]) / np.linalg.norm(mine[j])), j) for j in mine if j != i)
                want[i] = [j for _, j in s[:5]]
    assert out == want


def test_packs():
    sizes = {0: 3, 1: 4, 3: 9, 4: 25, 5: 1, 7: 9, 8: 1}
    assert ann.packed(sizes, 10) == {0: 0, 1: 0, 3: 1, 4: 2, 5: 3, 7: 3, 8: 4}
    assert ann.packed({0: 12}, 10) == {0: 0}


def test_a_query_is_sent_once_a_pack(spark, monkeypatch):
    tables = {}
    keep = ann.written
    monkeypatch.setattr(ann, "written", lambda df, name: tables.setdefault(name, keep(df, name)))
    monkeypatch.setattr(ann, "drop_tables", lambda *t: None)
    monkeypatch.setattr(ann, "SENT", 7)
    data = rows(900, 1)
    got = ann.nearest(spark.createDataFrame(data, SCHEMA), F.col("id") % 50 == 0, target=1.1, leaves=64)
    out = {}
    for r in sorted(got.collect()):
        out.setdefault(r.query_id, []).append(r.vec_id)
    assert out == brute(data, 50)
    queries, leaves = tables["queries"].where("dim = 8").count(), tables["leaves"].where("dim = 8").count()
    assert leaves > 16 and tables["visits"].where("dim = 8").count() == queries  # all leaves are in one pack


def test_leaves_in_several_packs(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 100)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 5)
    monkeypatch.setattr(ann, "SCORES", 300)
    data = rows(900, 150)
    got = ann.nearest(spark.createDataFrame(data, SCHEMA), F.col("id") % 50 == 0, target=1.1, leaves=32)
    out = {}
    for r in sorted(got.collect()):
        out.setdefault(r.query_id, []).append(r.vec_id)
    assert out == brute(data, 50)
