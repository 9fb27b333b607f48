"""Near-duplicate embeddings by an exact metric range join over angles.

Pivots, a sample of the vectors, part the sphere: a vector is at home in the cell of its nearest pivot. A cell is
cut into rings by the angle to its pivot, and large rings into blocks. By the triangle inequality a vector y can
have a partner in a ring only if its angle to the pivot lies within theta of the ring's, and only if it is at
most theta beyond the plane between the cell's pivot and its own. Such vectors, and no others, are copied to the
ring's blocks, each pair of blocks one way round. Blocks are then joined independently: tiles whose angles
to the pivot settle all their pairs (sum at most theta: all linked; difference above theta: none) need no
products; the rest are multiplied in single precision, and what is near the threshold again in double.

Equal vectors are one node that counts its rows, so exact copies are no hot group. A group of near copies is
spread over blocks and pairs of blocks, and gives counts and one edge a node for each pair of blocks, never its
pairs. Where the vectors have no clusters, as random ones of many dimensions, the inequality excludes nothing and
every pair is multiplied once; that is the price of an exact answer.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing; nor do vectors
of different lengths. Rows that share a vec_id are rows of their own; a null vec_id counts as a link of others but names
no component (null where no other is reachable). An empty table gives no rows. Only vec_id and embedding are
read, so other columns can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, cut, stored, table
from .near_dedup import components

#: Most pivots, and most bytes of them; a block's home vectors stay below BLOCK_BYTES in single precision.
PIVOTS, PIVOT_BYTES, BLOCK_BYTES = 1024, 8 << 20, 16 << 20
#: Pairs that one task multiplies at least, where there are as many.
TASK_PAIRS = 1 << 24
#: Rows and columns of a tile.
TILE = (512, 2048)
#: Slack of angles in radians, far above the error of an arc cosine in double precision.
SLACK = 1e-6


@dataclass
class Layout:
    """Blocks of one vector length: pivots (unit rows), and of each block its cell, its range of angles, part of parts and slices."""

    pivots: np.ndarray
    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray
    part: np.ndarray
    parts: np.ndarray
    slices: np.ndarray
    first: int  # number of the first block among those of all lengths


def unit(values: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, without overflow."""
    x = values / np.abs(values).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1, 1))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length."""
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def nodes_of(rows: DataFrame) -> DataFrame:
    """id, v, weight, least (smallest vec_id), k1, k2 of each distinct vector that can link. Stored."""
    kind = "array<float>" if dict(rows.dtypes)["embedding"] == "array<float>" else "array<double>"
    v = F.col("embedding").cast(kind)
    length = F.aggregate(v, F.lit(0.0), lambda a, x: a + F.abs(x.cast("double")))  # null and NaN stay what they are
    good = rows.select("vec_id", v.alias("v"), "k1", "k2", length.alias("_l")).where("_l > 0 and not isnan(_l)").where(F.size(F.filter("v", lambda x: F.abs(x) == float("inf"))) == 0)
    one = good.groupBy("k1", "k2").agg(F.first("v").alias("v"), F.count("*").alias("weight"), F.min("vec_id").alias("least"))
    return stored(one.withColumn("id", F.monotonically_increasing_id()).withColumn("dim", F.size("v")))


def _home(pivots: dict[int, np.ndarray]):
    """Counts of home vectors: dim, cell, degree (of the angle to the pivot, rounded down)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims):
                own = batch.filter(pa.array(dims == d))
                a = angles(unit(matrix(own.column("v"))), pivots[int(d)])
                cell = a.argmin(axis=1)
                degree = np.degrees(a[np.arange(len(a)), cell]).astype(np.int64)
                pairs, n = np.unique(np.stack((cell, degree)), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), d, np.int64)), pa.array(pairs[0]), pa.array(pairs[1]), pa.array(n)], names=["dim", "cell", "degree", "n"])

    return run


def layouts(nodes: DataFrame) -> dict[int, Layout]:
    """Pivots and blocks for each vector length. The driver sees at most PIVOTS pivots, and counts by cell and degree."""
    total = {r["dim"]: r["n"] for r in bounded(nodes.groupBy("dim").agg(F.count("*").alias("n")), 4096, "lengths of vectors")}
    pivots = {}
    for d in total:
        most = max(1, min(PIVOTS, PIVOT_BYTES // (8 * d), math.ceil(math.sqrt(total[d]) / 8)))
        picked = nodes.where(F.col("dim") == d).orderBy(F.xxhash64("k1", "k2")).limit(most).select("v").collect()
        pivots[d] = unit(np.array([r["v"] for r in picked], np.float64))
    found = nodes.select("dim", "v").mapInArrow(_home(pivots), "dim long, cell long, degree long, n long")
    counts = found.groupBy("dim", "cell", "degree").agg(F.sum("n").alias("n")).orderBy("dim", "cell", "degree")
    rings: dict[int, list] = {d: [] for d in total}
    size = {d: max(1024, min(8 * math.isqrt(total[d]), BLOCK_BYTES // (4 * d))) for d in total}
    for r in bounded(counts, 181 * PIVOTS * 4, "cells and degrees"):
        own = rings[r["dim"]]
        if own and own[-1][0] == r["cell"] and own[-1][3] + r["n"] <= size[r["dim"]]:
            own[-1][2:] = [r["degree"], own[-1][3] + r["n"]]
        else:
            own.append([r["cell"], r["degree"], r["degree"], r["n"]])
    out, first = {}, 0
    for d, own in rings.items():
        rows = [(c, lo, hi, p, k) for c, lo, hi, n in own for k in [-(-n // size[d])] for p in range(k)]
        cell, lo, hi, part, parts = (np.array(x) for x in zip(*rows, strict=True))
        slices = np.full(len(rows), -(-total[d] // (2 * max(size[d], TASK_PAIRS // size[d]))))
        out[d] = Layout(pivots[d], cell, np.radians(lo) - SLACK, np.radians(hi + 1) + SLACK, part, parts, slices, first)
        first += len(rows)
    return out


def homes(x: np.ndarray, ids: np.ndarray, own: Layout) -> tuple[np.ndarray, np.ndarray]:
    """Angles to all pivots and the home block of each vector."""
    a = angles(x, own.pivots)
    cell = a.argmin(axis=1)
    angle = a[np.arange(len(a)), cell]
    degree = np.degrees(angle).astype(np.int64)
    at = (own.cell[None, :] == cell[:, None]) & (np.radians(degree)[:, None] >= own.low) & (np.radians(degree + 1)[:, None] <= own.high)
    return a, np.argmax(at & (own.part == ids[:, None] * 7919 % own.parts), axis=1)


def visits(x: np.ndarray, a: np.ndarray, home: np.ndarray, own: Layout, theta: float) -> np.ndarray:
    """Of each vector and block whether the vector can have a partner there, one way round of each pair of blocks."""
    there = a[:, own.cell]
    near = (there >= own.low - theta) & (there <= own.high + theta)
    # The plane between the home pivot q and the block's pivot p: y (q - p) / |q - p| is the sine of y's angle beyond it.
    q = own.cell[home]
    cos = np.cos(a)
    gap = np.sqrt(np.maximum(2 - 2 * own.pivots[q] @ own.pivots[own.cell].T, 1e-12))
    beyond = (cos[np.arange(len(x)), q][:, None] - cos[:, own.cell]) / gap
    near &= (own.cell[None, :] == q[:, None]) | (beyond <= math.sin(theta) + SLACK)
    n = len(own.cell)
    ahead = (home[:, None] - np.arange(n)) % n
    return near & (ahead > 0) & ((2 * ahead < n) | ((2 * ahead == n) & (home[:, None] > np.arange(n))))


def _deal(layout: dict[int, Layout], theta: float):
    """Rows of nodes for the tasks that join them: block, slice, side (0: at home), the angle to the block's pivot, id, weight, v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims):
                rows, own = batch.filter(pa.array(dims == d)), layout[int(d)]
                ids = rows.column("id").to_numpy()
                x = unit(matrix(rows.column("v")))
                a, home = homes(x, ids, own)
                y, b = np.nonzero(visits(x, a, home, own, theta))
                # A home vector goes to all slices of its block, a visitor to one.
                k = own.slices[home]
                at_home = np.repeat(np.arange(len(ids)), k)
                nth = np.arange(len(at_home)) - np.repeat(np.cumsum(k) - k, k)
                row = np.concatenate((at_home, y))
                block = np.concatenate((home[at_home], b))
                part = np.concatenate((nth, (ids[y] * 104729 + 1) % 1299709 % own.slices[b]))
                side = np.concatenate((np.zeros(len(at_home), np.int32), np.ones(len(y), np.int32)))
                angle = a[row, own.cell[block]]
                for lo in range(0, len(row), 4096):
                    s = slice(lo, lo + 4096)
                    taken = rows.take(pa.array(row[s]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(block[s] + own.first), pa.array(part[s]), pa.array(side[s]), pa.array(angle[s]), taken.column("id"), taken.column("weight"), taken.column("v")],
                        names=["block", "slice", "side", "angle", "id", "weight", "v"],
                    )

    return run


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes reaches over the edges a, b."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        for end in (label[a], label[b], a, b):
            np.minimum.at(label, end, low)
        label = label[label]
        if (label == before).all():
            return label


def join_block(x: np.ndarray, side: np.ndarray, angle: np.ndarray, weight: np.ndarray, inner: bool, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Summed weight of each vector's partners, and the first vector that it reaches, in one block and slice.

    Home vectors (side 0) are compared with visitors and, if inner, with each other. x are raw rows.
    """
    theta = math.acos(least)
    u = unit(x)
    small, slack = u.astype(np.float32), (x.shape[1] + 8) * 2.0**-23
    # The cosine as it is defined, on the vectors as they are, where their lengths allow it.
    with np.errstate(over="ignore", invalid="ignore"):
        lengths = np.sqrt(np.einsum("ij,ij->i", x, x))
    if not ((lengths > 1e-140) & (lengths < 1e140)).all():
        x, lengths = u, np.ones(len(x))
    order = np.argsort(angle, kind="stable")
    mine, guests = order[side[order] == 0], order[side[order] == 1]
    links, edges_a, edges_b = np.zeros(len(x), np.int64), [], []

    def settle(rows: np.ndarray, cols: np.ndarray, same: bool) -> None:
        low_r, high_r, low_c, high_c = angle[rows[0]], angle[rows[-1]], angle[cols[0]], angle[cols[-1]]
        if low_r - high_c > theta + SLACK or low_c - high_r > theta + SLACK:
            return
        if high_r + high_c < theta - SLACK:  # by the way over the pivot all are near enough
            links[rows] += weight[cols].sum()
            if same:
                links[rows] -= weight[rows]
            else:
                links[cols] += weight[rows].sum()
            edges_a.extend((rows, cols))
            edges_b.extend((np.full(len(rows), cols[0]), np.full(len(cols), rows[0])))
            return
        s = small[rows] @ small[cols].T
        if s.max() < least - slack:
            return
        hit = s >= least - slack
        i, j = np.nonzero(hit & (s <= least + slack))
        if len(i):
            p, q = rows[i], cols[j]
            hit[i, j] = np.einsum("ij,ij->i", x[p], x[q]) / (lengths[p] * lengths[q]) >= least
        if same:
            np.fill_diagonal(hit, False)
        links[rows] += hit @ weight[cols]
        if not same:
            links[cols] += weight[rows] @ hit
        i, j = np.nonzero(hit)
        if len(i):
            tile = np.concatenate((rows, cols))
            star = roots(len(tile), i, len(rows) + j)
            moved = np.flatnonzero(star != np.arange(len(tile)))
            edges_a.append(tile[moved])
            edges_b.append(tile[star[moved]])

    step, wide = TILE
    for lo in range(0, len(mine), step):
        rows = mine[lo : lo + step]
        for at in range(0, len(guests), wide):
            settle(rows, guests[at : at + wide], False)
        if inner:
            settle(rows, rows, True)
            for at in range(lo + step, len(mine), wide):
                settle(rows, mine[at : at + wide], False)
    if not edges_a:
        return links, np.arange(len(x))
    return links, roots(len(x), np.concatenate(edges_a), np.concatenate(edges_b))


def partial_links(nodes: DataFrame, layout: dict[int, Layout], least: float) -> DataFrame:
    """id, links, root: from each block and slice the weight of a vector's partners, and a vector that it reaches."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        ids = pdf["id"].to_numpy()
        links, first = join_block(x, pdf["side"].to_numpy(), pdf["angle"].to_numpy(), pdf["weight"].to_numpy(), int(pdf["slice"].iloc[0]) == 0, least)
        some = links > 0
        return pd.DataFrame({"id": ids[some], "links": links[some], "root": ids[first[some]]})

    kind = dict(nodes.dtypes)["v"]
    dealt = nodes.select("dim", "id", "weight", "v").mapInArrow(_deal(layout, math.acos(least)), f"block long, slice long, side int, angle double, id long, weight long, v {kind}")
    return dealt.groupBy("block", "slice").applyInPandas(run, "id long, links long, root long")


def range_join(rows: DataFrame, least: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of rows (vec_id, embedding): links at a cosine of `least` or more, 0 < least < 1."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(1), F.reverse("embedding")).alias("k2"))
    nodes = nodes_of(rows)
    found = cut(partial_links(nodes, layouts(nodes), least))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    edges = found.where("id != root").select(F.col("id").alias("a"), F.col("root").alias("b"))
    named = nodes.select("id", "k1", "k2", "weight", "least").join(components(edges).toDF("id", "c"), "id", "left").join(links, "id", "left").withColumn("c", F.coalesce("c", "id"))
    named = cut(named)
    smallest = named.groupBy("c").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "c").select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "k1", "k2").join(named, ["k1", "k2"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_join(table(spark, sf_dir, "embeddings"))


#: For small tables: all pairs, then the closure of the links.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (
  SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS len FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.len * b.len) >= 0.9),
r AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, m.c AS component_id, v.vec_id = m.c AS kept
FROM v LEFT JOIN (SELECT x, count(*) AS n FROM l GROUP BY x) n ON n.x = v.vec_id JOIN (SELECT x, min(y) AS c FROM r GROUP BY x) m ON m.x = v.vec_id
"""
