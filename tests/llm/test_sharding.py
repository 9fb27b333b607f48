import itertools
import random

from pyspark.sql import functions as F

from framewise.llm import sharding


def cost(flow):
    return sum(v for (i, j), v in flow.items() if i != j)


def test_flow_moves_least():
    rng = random.Random(1)
    for _ in range(40):
        n, m, total = rng.randint(1, 4), rng.randint(1, 4), rng.randint(0, 9)
        sizes = [0] * n
        for _ in range(total):
            sizes[rng.randrange(n)] += 1
        capacities = [0] * m
        for _ in range(total):
            capacities[rng.randrange(m)] += 1
        flow = sharding.min_cost_flow(sizes, capacities)
        assert [sum(v for (i, _), v in flow.items() if i == k) for k in range(n)] == sizes
        assert [sum(v for (_, j), v in flow.items() if j == k) for k in range(m)] == capacities
        units = [i for i, s in enumerate(sizes) for _ in range(s)]
        slots = [j for j, c in enumerate(capacities) for _ in range(c)]
        best = min((sum(i != j for i, j in zip(units, p, strict=True)) for p in set(itertools.permutations(slots[:7]))), default=0) if total <= 7 else cost(flow)
        assert cost(flow) == best


def check(rows, shards, tolerance):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    sizes = [sum(r.size for r in by.get(j, [])) for j in range(shards)]
    assert max(sizes) - min(sizes) <= tolerance


def test_op1(spark, docs):
    rows = sharding.op1(spark, docs).collect()
    assert len(rows) == docs.count()
    assert {r.shard for r in rows} <= set(range(24))
    check(rows, 24, max(r.size for r in rows))
    whole, old = sum(r.size for r in rows), {}
    for r in rows:
        old[r.old_shard] = old.get(r.old_shard, 0) + r.size
    least = whole - sum(min(old.get(j, 0), whole // 24) for j in range(24))
    assert sum(r.size for r in rows if r.moved) <= least + 24 * max(r.size for r in rows) / 2


def test_odd_tables(spark, odd, empty):
    rows = sharding.reshard(odd, F.col("doc_id") % 3, 3, [2, 1, 1]).collect()
    assert len(rows) == odd.count()
    assert sharding.reshard(empty, F.lit(0), 2, 3).count() == 0
    assert sharding.op1(spark, odd).count() == odd.count()


def test_write(spark, docs, tmp_path):
    out = sharding.reshard(docs, F.pmod("doc_id", F.lit(2)), 2, 3)
    written = sharding.write_shards(out, f"{tmp_path}/s")
    assert sorted(r.doc_id for r in written.select("doc_id").collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())
