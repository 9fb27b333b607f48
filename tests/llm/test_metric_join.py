import numpy as np
import pytest
from pyspark.sql import functions as F

from framewise.llm import metric_join as m

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, least=0.9):
    """n_links and component of every row, from all pairs in double precision."""
    x = [None if v is None or not v or any(c is None or not np.isfinite(c) for c in v) or not np.any(v) else np.array(v, np.float64) for _, v in rows]
    n = len(rows)
    link = [[i != j and x[i] is not None and x[j] is not None and len(x[i]) == len(x[j]) and float(x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j]))) >= least for j in range(n)] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            k = todo.pop()
            new = {j for j in range(n) if link[k][j]} - seen
            seen |= new
            todo += new
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        out.append((rows[i][0], sum(link[i]), min(ids) if ids else None, rows[i][0] == (min(ids) if ids else None)))
    return out


def same(spark, rows, schema=SCHEMA, least=0.9):
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], schema)
    got = [tuple(r) for r in m.range_join(table, least).collect()]
    assert sorted(got, key=str) == sorted(plain(rows, least), key=str)
    return got


def clustered(seed, groups, size, dim=16, spread=0.3):
    rng = np.random.default_rng(seed)
    rows = [c + spread * rng.normal(size=dim) * rng.random() for c in rng.normal(size=(groups, dim)) for _ in range(size)]
    return [(int(i), np.float32(v).tolist()) for i, v in zip(rng.permutation(len(rows)), rows, strict=True)]


def test_clusters(spark):
    got = same(spark, clustered(1, 25, 20))
    assert 25 <= sum(r[3] for r in got) < 400 and max(r[1] for r in got) > 5


def test_odd(spark):
    """Nulls, zeros, non-finite components, other lengths, huge values, repeated ids and rows, exact and scaled copies."""
    a, nan, inf = [1.0, 2.0, 3.0, 4.0], float("nan"), float("inf")
    rows = [(5, a), (5, a), (3, [2.0, 4.0, 6.0, 8.0]), (9, [-1.0, -2.0, -3.0, -4.0]), (1, None), (2, []), (4, [0.0] * 4), (6, [1.0, None, 3.0, 4.0]), (7, [1.0, 2.0, nan, 4.0]), (8, [inf, 1.0, 1.0, 1.0])]
    rows += [(None, a), (None, [0.0, 0.0, 1.0, 0.0]), (10, [1.0, 2.0, 3.0]), (11, [1.0, 2.0, 3.1]), (12, [1.0, 2.0, 3.0, 4.0, 0.0]), (13, [1e30, 2e30, 3e30, 4e30]), (14, [1e-30, 2e-30, 3e-30, 4e-30]), (15, [-0.0, 0.0, 0.0, -0.0])]
    got = same(spark, rows)
    # A null id counts as a link but names no component; alone it is kept.
    assert (5, 6 - 1, 3, False) in got and (None, 0, None, True) in got
    assert m.range_join(spark.createDataFrame([], SCHEMA)).count() == 0
    clash = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], "vec_id long, embedding array<double>, id int, k1 int, links int")
    assert m.range_join(clash).where("n_links > 0").count() == sum(r[1] > 0 for r in got)


def test_threshold(spark):
    """Pairs at the threshold in double precision, and just below it."""
    rows = [(0, [1.0, 0.0])] + [(k, [0.9, float(np.sqrt(1 - 0.81) * (1 + (k - 3) * 1e-12))]) for k in range(1, 6)]
    x = np.array([v for _, v in rows])
    want = {k for k in range(1, 6) if x[0] @ x[k] / (np.linalg.norm(x[0]) * np.linalg.norm(x[k])) >= 0.9}
    got = {r.vec_id: r.n_links for r in m.range_join(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got[0] == len(want) and 0 < len(want) < 5


@pytest.mark.parametrize(("spread", "least"), [(0.01, 0.9), (0.2, 0.9), (1.0, 0.6)])
def test_many_blocks(spark, monkeypatch, spread, least):
    """Small blocks, several slices and parts of rings: one hot group of near copies among others, by the same rule."""
    monkeypatch.setattr(m, "BLOCK_BYTES", 64 * 4 * 8)
    monkeypatch.setattr(m, "TASK_PAIRS", 1)
    monkeypatch.setattr(m, "TILE", (16, 32))
    monkeypatch.setattr(m.Layout, "__doc__", "")
    real = m.layouts

    def small(nodes):
        out = real(nodes)
        for own in out.values():  # as for a large table: more parts and slices
            own.slices = np.full(len(own.cell), 3)
            k = 2
            own.cell, own.low, own.high = (np.repeat(v, k) for v in (own.cell, own.low, own.high))
            own.part, own.parts, own.slices = np.tile(np.arange(k), len(own.part)), np.full(len(own.cell), k), np.repeat(own.slices, k)
        return out

    monkeypatch.setattr(m, "layouts", small)
    rng = np.random.default_rng(3)
    hot = rng.normal(size=8)
    rows = [(i, np.float32(hot + spread * rng.normal(size=8)).tolist()) for i in range(120)]
    rows += [(1000 + i, v) for i, v in clustered(4, 20, 9, 8)]
    same(spark, rows, least=least)


def test_tiles_settled_by_angles():
    """Without any product: what lies near a pivot is linked, what lies apart is not; counts equal those of all products."""
    rng = np.random.default_rng(5)
    p = m.unit(rng.normal(size=(1, 12)))
    x = np.concatenate((p + 0.05 * rng.normal(size=(300, 12)), rng.normal(size=(200, 12)), -p + 0.01 * rng.normal(size=(100, 12))))
    side, weight = (np.arange(600) % 3 == 0).astype(np.int32), np.arange(600) % 4 + 1
    angle = m.angles(m.unit(x), p)[:, 0]
    got, first = m.join_block(x, side, angle, weight, True, 0.9)
    u = m.unit(x)
    link = (u @ u.T >= 0.9) & ~((side[:, None] == 1) & (side[None, :] == 1))
    np.fill_diagonal(link, False)
    assert (got == link @ weight).all()
    assert (m.roots(600, np.arange(600), first) == m.roots(600, *np.nonzero(link))).all()


def test_whole_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = m.op12(spark, sf)
    assert got.count() == rows.count() and got.where("kept != (vec_id = component_id)").count() == 0
    assert got.agg(F.countDistinct("vec_id")).first()[0] == rows.count()
