import re
from fractions import Fraction
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from framewise.llm import filter_audit as a


def fails(rows):
    """For each row the filters that it fails, by the rule."""
    out = []
    for r in rows:
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        twin = r.doc_id is not None and any((x.text or "") == t and x.doc_id is not None and x.doc_id < r.doc_id for x in rows)
        bad = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), twin]
        out.append({f for f, b in zip("ABCDE", bad, strict=True) if b})
    return out


def plain(docs, labels):
    rows, good, toxic = docs.collect(), set(), set()
    for r in labels.collect():
        good |= {r.doc_id} if r.quality == 1 and r.doc_id is not None else set()
        toxic |= {r.doc_id} if r.toxic == 1 and r.doc_id is not None else set()
    failed, out = fails(rows), {}
    for part in {r.lang or "" for r in rows}:
        own = [(r.doc_id, f) for r, f in zip(rows, failed, strict=True) if (r.lang or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                before, after = set(order[:k]), set(order[: k + 1])
                gone = [i for i, x in own if f in x and not x & before]
                total[f] += len(gone)
                out[part, order, k + 1] = [sum(not x & after for _, x in own), len(gone), sum(f in x for _, x in own) - len(gone), sum(x == {f} for _, x in own), sum(i in good for i in gone), sum(i in toxic for i in gone)]
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                out[part, order, k + 1].append(total[f])
    return out


def same(docs, labels):
    got = {(r.part, r.filter_order, r.step): [r[c] for c in a.COUNTS] for r in a.audit(docs, labels).collect()}
    assert got == plain(docs, labels)
    return got


def test_documents(spark, docs, sf):
    got = same(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert len(got) == 600 * docs.select("lang").distinct().count() and any(v[4] for v in got.values())


def test_odd(spark, odd, empty):
    """Nulls, repeated rows and labels, empty and long texts, names that clash, labels of other documents."""
    labels = spark.createDataFrame([(0, 1, 1), (0, 0, 0), (1, 1, None), (None, 1, 1), (5, None, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    same(odd, labels)
    same(odd.withColumns({"part": F.lit(1), "mask": F.lit(2), "good": F.lit(3), "key": F.lit("x"), "n": F.lit(4)}), labels)
    same(odd, labels.limit(0))
    assert a.audit(empty, labels).count() == 0


def test_copies(spark):
    """Of a text that a third of the rows have in many languages all but those of the smallest id repeat it."""
    rows = [(i % 400 if i % 3 else 7, "copy" if i % 3 == 0 else f"text {i}", f"l{i % 5}") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    same(docs, spark.createDataFrame([(7, 1, 0), (8, 1, 1)], "doc_id long, quality int, toxic int"))


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_shapley(n):
    """The least squares give the values of the definition, also for games that no filter makes."""
    value = [0] + [(s * 7919 + 13) % 101 for s in range(1, 2**n)]
    want = [Fraction(0)] * n
    orders = list(permutations(range(n)))
    for order in orders:
        s = 0
        for i in order:
            want[i] += Fraction(value[s | 1 << i] - value[s], len(orders))
            s |= 1 << i
    assert a.shapley(value) == want
