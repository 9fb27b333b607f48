import random

import numpy as np
from pyspark.sql import functions as F

from framewise.llm import cotraining, quality_rules as q
from framewise.llm.common import mix64, word_hashes


def slow(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {x for x in windows if windows.count(x) > 1}
    covered = {i + j for i, x in enumerate(windows) if x in twice for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_base_statistics():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b", " ", "  ", "\n", "#", "c d e ", "é", "\x1c"]) for _ in range(rng.randint(0, 60)))
        assert q.base_statistics(text) == slow(text)


def plain_features(text):
    """The grams of a text counted one by one."""
    from collections import Counter

    words, _ = word_hashes([text])
    kinds = [[np.uint64(w) for w in words], [w * np.uint64(3) + x for w, x in zip(words[:-1], words[1:], strict=True)]]
    kinds[1] = [mix64(np.array([x]))[0] for x in kinds[1]]
    kinds.append([mix64(np.array([text[i] << 16 | text[i + 1] << 8 | text[i + 2]], np.uint64))[0] for i in range(len(text) - 2)])
    out = Counter()
    for seed, grams in enumerate(kinds):
        count = Counter(int(mix64(np.array([g + np.uint64(seed)]))[0] >> np.uint64(40)) % q.BUCKETS for g in grams)
        for k, n in count.items():
            out[seed, k] += (n / len(grams)) ** 0.5
    return out


def test_features():
    """Slices of many texts give each text its own grams, and the dense score equals the sparse one."""
    rng = np.random.default_rng(3)
    texts = [b"", b"a", b"ab", b"abc", "déjà vu déjà vu".encode(), b"one two three one two", b" \n ", bytes(rng.integers(32, 127, 3000, dtype=np.uint8))]
    model = q.Logistic(q.BUCKETS)
    model.w, model.bias = rng.normal(size=q.BUCKETS), 0.3
    old = np.seterr(over="ignore")
    for text, grams in zip(texts, q.gram_buckets(texts), strict=True):
        want = plain_features(text)
        at, value = q.features(grams)
        assert len(at) == len(want) and np.isclose(value.sum(), sum(want.values()), atol=1e-3)
        slow_score = sum(model.w[k] * v for (_, k), v in want.items()) + model.bias
        assert np.isclose(model.raw(at, value), slow_score, atol=1e-3) and np.isclose(model.raw_of(grams), slow_score)
    np.seterr(**old)


def auc(probability, quality):
    order = np.argsort(probability, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(len(order))
    return (rank[quality == 1].mean() - rank[quality == 0].mean()) / len(order) + 0.5


def test_unseen_labels(spark):
    """Labels of odd ids are hidden from training and stand for the test."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    shown, hidden = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1").select("doc_id", "quality")
    some = docs.join(hidden.select("doc_id"), "doc_id", "left_semi")

    def measured(scored, column="probability"):
        rows = scored.join(hidden, "doc_id").select(column, "quality").collect()
        p, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        return ((p >= 0.5) == (y == 1)).mean(), auc(p, y)

    accuracy, _ = measured(q.score(some, q.train(docs, shown)))
    assert accuracy > 0.93
    alone, both = (cotraining.score(some, cotraining.train(docs, shown, 120, rounds)).select("doc_id", *cotraining.SCORES).cache() for rounds in (0, 2))
    # With few labels the exchange helps: it ranks better than without.
    assert measured(both)[1] > measured(alone)[1] + 0.005
    accuracy, ranks = measured(cotraining.score(some, cotraining.train(docs, shown)))
    assert accuracy > 0.95 and ranks > 0.99


def test_whole_rows(spark, docs, sf):
    """op4's and op9's rows from their parts, for every document."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    texts = {r.doc_id: r for r in docs.collect()}
    model, views = q.train(docs, labels), cotraining.train(docs, labels)
    got = {r.doc_id: r for r in q.op4(spark, sf).collect()}
    two = {r.doc_id: r for r in cotraining.op9(spark, sf).collect()}
    assert got.keys() == two.keys() == texts.keys()
    for i, row in texts.items():
        raw = (row.text or "").encode()
        r, (n, chars, symbols, lines, repeats) = got[i], slow(row.text or "") if len(raw) < 3000 else q.base_statistics(row.text)
        failed = n < 50 or 100 * repeats > 50 * n
        at, value = q.features(q.gram_buckets([raw])[0])
        p = model.probability(model.raw(at, value)) if model else 1.0
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (n, chars, symbols, lines, repeats, failed)
        assert abs(r.probability - p) < 1e-5 and r.kept == (not failed and r.probability >= q.KEEP_FROM)
        if views:
            a = views.text.probability(views.text.raw(at, value))
            b = views.meta.probability(views.meta.raw(*cotraining.metadata_features(raw, [row.lang, row.source])))
            assert np.allclose((two[i].p_text, two[i].p_meta, two[i].probability), (a, b, views.combine(a, b)), atol=1e-5)
        assert two[i].kept == (two[i].probability >= cotraining.KEEP_FROM)


def test_surest(spark, docs, sf):
    """The rows handed over are the surest of all documents without a label, as many of either class."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    views = cotraining.train(docs, labels, rounds=0)
    if views is None:
        return
    known = {r.doc_id for r in labels.collect()}
    rows = [r for r in cotraining.score(docs, views).collect() if r.doc_id not in known]
    got = cotraining.surest(docs, labels, views, [])
    for giver in ("text", "meta"):
        p = {r.doc_id: r[f"p_{giver}"] for r in rows}
        sure = {1: sorted((x for x in p.values() if x >= cotraining.SURE), reverse=True), 0: sorted((1 - x for x in p.values() if 1 - x >= cotraining.SURE), reverse=True)}
        n = min(cotraining.HANDED, len(sure[0]), len(sure[1]))
        for y in (0, 1):
            mine = [p[r.doc_id] if y else 1 - p[r.doc_id] for r in got if (r.giver, r.y) == (giver, y)]
            assert np.allclose(mine, sure[y][:n])


def test_odd_tables(spark, odd, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(17)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    for own in (labels, none):
        assert q.score(odd, q.train(odd, own)).count() == odd.count()
        out = cotraining.score(odd, cotraining.train(odd, own))
        assert out.count() == odd.count() and set(odd.columns) - {"probability"} <= set(out.columns)
    assert q.score(empty, q.train(empty, labels)).count() == 0
    assert cotraining.score(empty, cotraining.train(empty, labels)).count() == 0
    assert q.score(odd, None).where(F.col("n_words") < 0).count() == 0


def test_foreign_labels(spark, docs, sf):
    """Labels of documents that aren't there take no place in the bounded sample; without a model the probability is null."""
    own = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    foreign = spark.range(1_000_000, 1_100_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    alone = {r.doc_id for r in q.labelled_sample(docs, own, q.SAMPLE).collect()}
    both = {r.doc_id for r in q.labelled_sample(docs, own.union(foreign), q.SAMPLE).collect()}
    assert both == alone and len(alone) > 50
    assert q.train(docs, own.union(foreign)) is not None
    assert q.train(docs, foreign) is None
    assert q.score(docs, None).where("probability is not null").count() == 0
