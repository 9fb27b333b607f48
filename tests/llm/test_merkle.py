import zlib
from hashlib import sha256

from pyspark.sql import functions as F

from framewise.llm import merkle as m


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(r, add=0):
    values = [r.doc_id, r.source, r.lang, None if r.n_chars is None else r.n_chars + add, r.text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(leaves):
    """The top, and for each leaf the siblings of each level with the side that they stand on."""
    paths, at = [[] for _ in leaves], list(range(len(leaves)))
    level = list(leaves)
    while len(level) > 1:
        for i, k in enumerate(at):
            paths[i].append((level[k ^ 1] if k ^ 1 < len(level) else "", k % 2 == 1))
        level = [h(*level[k : k + 2]) for k in range(0, len(level), 2)]
        at = [k // 2 for k in at]
    return level[0], paths


def plain(rows):
    """doc_id, leaf, subroot, root, proof, folded root and verdict of every row, by the rule."""
    groups = {}
    for r in rows:
        groups.setdefault(b"" if r.lang is None else b":" + r.lang.encode(), []).append(r)
    keys = sorted(groups)
    trees = {}
    for g in keys:
        groups[g].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
        trees[g] = tree([leaf(r) for r in groups[g]])
    root, upper = tree([trees[g][0] for g in keys])
    out = []
    for g, above in zip(keys, upper, strict=True):
        for r, own in zip(groups[g], trees[g][1], strict=True):
            path = own + above
            hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
            x = leaf(r, int(hit))
            for sibling, left in path:
                x = h(sibling, x) if left else h(x, sibling)
            out.append((r.doc_id, leaf(r), trees[g][0], root, h(*[s for s, _ in path]), x, x == root))
    return out


def same(spark, docs):
    got = [tuple(r) for r in m.op11(spark, docs).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]
    assert sorted(got, key=str) == sorted(plain(docs.collect()), key=str)
    return got


def test_documents(spark, docs):
    got = same(spark, docs)
    assert 0 < sum(not r[-1] for r in got) < len(got)


def test_odd(spark, odd, empty):
    """Nulls in every column, repeated rows, long texts and clashing names."""
    same(spark, odd)
    assert m.op11(spark, empty).count() == 0
    assert m.op11(spark, odd.withColumns({"g": F.lit(1), "pos": F.lit(2), "node": F.lit("x"), "n": F.lit(3), "path": F.lit("p"), "levels": F.lit(0)})).count() == odd.count()


def test_shapes(spark):
    """Trees of one, an odd number, a full block, one more, and two tiers; many languages."""
    sizes = {"a": 1, "b": 2, "c": 3, "d": 255, "e": 256, "f": 257, "g": 513, None: 5, "": 2}
    rows = [(i, f"t{i}", lang, "s", i) for lang, n in sizes.items() for i in range(n)]
    rows += [(7, "one", f"x{k}", None, None) for k in range(300)]
    same(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))


def test_manifest(spark, docs):
    """Levels are strings of fixed width, and each parent is the hash of its part of the level below."""
    tiers, heads = m.manifest(docs)
    for r in tiers[0].collect():
        levels = [bytes(x).decode() for x in r.levels]
        for below, above in zip(levels, levels[1:], strict=False):
            assert above == "".join(h(below[k : k + 128]) for k in range(0, len(below), 128))
    assert heads.select("root").distinct().count() == 1 and heads.count() == docs.select("lang").distinct().count()
