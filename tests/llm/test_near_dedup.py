import random

import numpy as np

from framewise.llm import near_dedup as n
from framewise.llm.common import shingles, word_hashes


def sets(texts, k):
    out = []
    for t in texts:
        w, _ = word_hashes([(t or "").encode()])
        out.append(frozenset(shingles(w, k).tolist()))
    return out


def brute(ids, texts, k, percent):
    s, parent = sets(texts, k), list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    return {x: min(g) for g in groups.values() for x in g}


def test_estimate_is_close():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.85):
        got = []
        for _ in range(30):
            a = rng.integers(0, 2**63, 400, dtype=np.uint64)
            m = round(400 * 2 * share / (1 + share))
            b = np.concatenate((a[:m], rng.integers(0, 2**63, 400 - m, dtype=np.uint64)))
            got.append(n.estimate(n.signature(np.unique(a)), n.signature(np.unique(b))))
        assert abs(np.mean(got) - share) < 0.03


def family(rng, base, count, most):
    """Copies with up to `most` words replaced, dropped or added."""
    out = []
    for _ in range(count):
        w = base.split()
        for _ in range(rng.randint(0, most)):
            i = rng.randrange(len(w))
            w[i : i + 1] = rng.choice(([f"n{rng.randint(0, 10**6)}"], [], [w[i], f"n{rng.randint(0, 10**6)}"]))
        out.append(" ".join(w))
    return out


def test_components_brute_force(spark):
    rng = random.Random(5)
    texts = []
    for f in range(4):
        base = " ".join(f"f{f}w{rng.randint(0, 400)}" for _ in range(120))
        texts += family(rng, base, 60, 9) + [base] * 5
    texts += ["a b", "A  B", "a", None, "", "a b c", "c b a"]
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in n.op6(spark, df).collect()}
    want = brute(list(range(len(texts))), texts, 3, 85)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets(texts, 3)]
    kept = {r.doc_id for r in n.keep_first(df, 3, 85).collect()}
    assert kept == set(want.values())


def test_long_chains(spark):
    rng = random.Random(7)
    names = [rng.randbytes(16) for _ in range(1_130)]
    # A chain of 1,000 links, one of 100, and a hub with 25 leaves.
    edges = [(i, i + 1) for i in range(1_000)] + [(i, i + 1) for i in range(1_001, 1_101)] + [(1_102, i) for i in range(1_103, 1_128)]
    edges = [(names[x], names[y]) for x, y in edges]
    rng.shuffle(edges)
    got = {bytes(r.node): bytes(r.component) for r in n.components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    want = {x: min(group) for group in (names[:1_001], names[1_001:1_102], names[1_102:1_128]) for x in group}
    assert got == want


def test_shared_ids(spark):
    """Of rows that share a doc_id only the duplicates go."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (6, b), (7, c), (7, ""), (5, ""), (8, c), (5, None)]
    kept = n.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    # The first row of each text stays, and texts without words all stay.
    assert {(r.doc_id, r.text) for r in kept.collect()} == {(1, a), (5, b), (7, c), (7, ""), (5, ""), (5, None)}


def test_odd_tables(spark, odd, empty):
    assert n.op6(spark, odd).count() == odd.count()
    assert n.op6(spark, empty).count() == 0 and n.keep_first(empty).count() == 0
    kept = n.keep_first(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 0").count() == 1 and kept.where("doc_id = 1").count() == 0
    assert kept.where("doc_id is null").count() == 2


def test_batches_are_taken_in_parts(monkeypatch):
    """A worker holds the texts of a part of a batch, not of all of it, and gives freed memory back when its task ends."""
    import pyarrow as pa

    from framewise.llm import near_dedup

    sizes, given = [], []
    read = near_dedup.text_bytes
    monkeypatch.setattr(near_dedup, "text_bytes", lambda column: sizes.append(len(column)) or read(column))
    monkeypatch.setattr(near_dedup, "give_back", lambda: given.append(1), raising=False)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(2000)), "text": [f"a b c d {i}" for i in range(2000)]})
    out = list(near_dedup._per_document(3, False)(iter([batch])))
    assert [x for b in out for x in b.column(0).to_pylist()] == list(range(2000))
    assert max(sizes) <= 512 and sum(sizes) == 2000 and given == [1]
