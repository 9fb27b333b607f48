import math

from framewise.llm import mixing


def test_targets():
    sizes = [10, 100, 40, 1000]
    t = mixing.targets(sizes, [5, 2, 1, 5])
    assert math.isclose(sum(t), 1.5 * sum(sizes)) and all(x <= 2 * s + 1e-9 for x, s in zip(t, sizes, strict=True))
    assert mixing.targets([0, 0], [5, 2]) == [0.0, 0.0]


def brute(rows, target, size):
    """Whole epochs, then documents by key while their middle is within what is left."""
    epochs = int(target // size) if size else 0
    rest, at, taken = target - epochs * size, 0, {}
    for key, doc, n in sorted(rows):
        taken[doc] = epochs + (1 if at + n / 2 <= rest else 0)
        at += n
    return taken


def test_op2_brute_force(spark, docs):
    from pyspark.sql import functions as F

    keyed = {r.doc_id: (r.k, r.source) for r in docs.select("doc_id", "source", mixing.sampling_key(17, F.coalesce(mixing.quality_weight(F.col("text")), F.lit(0.05)), "doc_id", "source", "text").alias("k")).collect()}
    rows = mixing.op2(spark, docs).collect()
    assert rows == mixing.op2(spark, docs.repartition(3)).orderBy("doc_id").collect() or {r.doc_id: r.taken for r in rows} == {r.doc_id: r.taken for r in mixing.op2(spark, docs.repartition(3)).collect()}
    by = {}
    for r in rows:
        by.setdefault(keyed[r.doc_id][1], []).append(r)
    for own in by.values():
        want = brute([(keyed[r.doc_id][0], r.doc_id, r.size) for r in own], own[0].target, own[0].source_size)
        assert {r.doc_id: r.copies for r in own} == want
        assert all(r.taken <= 2 * r.size for r in own)


def test_odd_tables(spark, odd, empty):
    rows = mixing.op2(spark, odd).collect()
    assert len(rows) == odd.count() and all(r.taken <= 2 * r.size for r in rows)
    assert mixing.op2(spark, empty).count() == 0
    from pyspark.sql import functions as F

    out = mixing.mix(odd, mixing.n_words(F.col("text")), F.lit(1.0))
    assert mixing.epochs(out).count() == out.agg(F.sum("copies")).first()[0]
