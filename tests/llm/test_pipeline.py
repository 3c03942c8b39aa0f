from echofold.llm import decontam, minhash, pii
from echofold.llm.common import byte_words, written

import corpus_pipeline

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near duplicates", "decontamination", "personal data", "sentencepiece"]
    bench = spark.read.parquet(f"{DIR}/benchmark.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, DIR).cache()
        after = {r.doc_id: r for r in docs.collect()}
        sizes.append(len(after))
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
        gone = before.keys() - after.keys()
        if name == "toxicity":
            assert sum(labels.get(d) == 0 for d in gone) <= 1 and sum(labels.get(d) == 1 for d in after) <= 1
        elif name == "near duplicates":
            words = [tuple(byte_words((r.text or "").encode())) for r in after.values()]
            assert len(set(words)) == len(words)
            classes = {r.doc_id: r.class_id for r in minhash.classes(spark.createDataFrame(list(before.values()), "doc_id long, text string, lang string, source string, n_chars long")).collect()}
            assert after.keys() == set(classes.values())
        elif name == "decontamination":
            left = decontam.score(docs, bench).collect()
            assert gone and not any(r.contaminated for r in left)
        elif name == "personal data":
            assert not gone
            for d, r in after.items():
                assert r.text == pii.redacted(before[d].text, pii.spans([before[d].text])[0][1]) and r.n_chars == len(r.text)
        else:
            assert not gone and all(after[d].text == before[d].text and after[d].round_trip for d in after)
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] == sizes[4] == sizes[5] > 0


def test_run(spark):
    """run() gives what the stages give one after another."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, DIR), "stage")
    got = corpus_pipeline.run(spark, DIR)
    assert got.columns == docs.columns
    columns = ["doc_id", "text", "n_tokens", "ids_hash", "round_trip"]
    assert sorted(map(tuple, got.select(columns).collect()), key=str) == sorted(map(tuple, docs.select(columns).collect()), key=str)


def folder(spark, path, rows, labels=(), items=()):
    schema = "doc_id long, text string, lang string, source string, n_chars long, Score int, node string, n_hit int, spans string, ids int"
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder(spark, f"{tmp_path}/none", [])).collect() == []


def test_nulls_repeats_and_clashing_columns(spark, tmp_path):
    passage = " ".join(f"p{k}" for k in range(30))
    text = " ".join(f"w{k}" for k in range(40))
    row = lambda d, t: (d, t, "en", None, len(t or ""), 1, "own", 2, "mine", 3)
    rows = [row(1, text), row(1, text), row(2, text.upper()), row(3, None), row(None, "lost words"), row(4, ""), row(5, "mail a@b.org now"), row(6, passage), row(7, "x " * 40_000)]
    out = corpus_pipeline.run(spark, folder(spark, f"{tmp_path}/some", rows, [(1, 1, 0), (None, None, None)], [(1, passage), (2, None), (None, "")]))
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(got) and got.keys() == {1, 3, None, 4, 5, 7}
    assert got[5].text == "mail <EMAIL> now" and got[3].text is None and got[4].text == ""
    assert all(r.round_trip for r in got.values() if r.text) and (got[1].Score, got[1].node, got[1].n_hit, got[1].spans) == (1, "own", 2, "mine")
