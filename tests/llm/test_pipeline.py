import test_line_dedup
import test_near_dedup
from pyspark.sql import functions as F

import corpus_pipeline
from framewise.llm import cotraining
from framewise.llm.common import shared_dir


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert name == "BPE" or out.columns == docs.columns
        path = shared_dir(spark)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append(docs.count())
    assert seen[0] >= seen[1] > 0.6 * seen[0] and seen[1] > seen[2] >= seen[3] > 0.8 * seen[2] and seen[4] == seen[5]
    assert docs.where(~F.col("round_trip")).count() == 0 and docs.where(F.size("ids") != F.col("n_tokens")).count() == 0


def test_stages_brute_force(spark, sf):
    """The filtering stages' rows, and texts, against plain versions on a part of the table."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("n_chars < 3000").orderBy("doc_id").limit(120).cache()
    rows = {r.doc_id: r for r in docs.collect()}

    views = cotraining.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    good = {r.doc_id for r in cotraining.score(docs, views).collect() if r.probability >= cotraining.KEEP_FROM}
    assert {r.doc_id: r for r in corpus_pipeline.quality(spark, docs, sf).collect()} == {i: rows[i] for i in good}

    ids = sorted(rows)
    texts = dict(zip(ids, test_line_dedup.brute([rows[i].text for i in ids]), strict=True))
    left = {i: t for i, t in texts.items() if t == rows[i].text or t and t.split()}
    lines = {r.doc_id: r for r in corpus_pipeline.lines(spark, docs, sf).collect()}
    assert {i: r.text for i, r in lines.items()} == left
    assert all(r.n_chars == (len(r.text) if r.text is not None else None) and (r.lang, r.source) == (rows[i].lang, rows[i].source) for i, r in lines.items())

    near = test_near_dedup.brute(ids, [rows[i].text for i in ids], 5, 80)
    assert {r.doc_id: r for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()} == {i: rows[i] for i in ids if near[i] == i}


def test_odd_documents(spark, odd, sf):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, sf)
            assert out.count() >= 0
