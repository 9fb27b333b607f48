"""Resharding by minimum-cost flow: move the fewest bytes from old shards to new capacities.

The flow runs between shards, so its size follows the number of shards and never the data. Each old
shard is laid out as blocks of rows in a fixed order. What stays and what moves are stretches of that
order; their ends are snapped to row borders so that the new shards' sizes come out near equal. Only
shards that give or take rows are written again.

Nulls and empty texts have size 8; a null old shard counts as shard 0. Rows that repeat are separate
rows. An empty table gives an empty result. Columns that clash with shard or slot are replaced. A text of any
length is one row of its size: it moves whole, and a shard may be larger than its capacity by it. Rows that tie in
key and content lie side by side, in one block, in no order of their own.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, cut, shared_dir

#: Bytes of a row besides its text.
ROW_BYTES = 8
#: Old and new shards whose flow the driver may solve at once.
MAX_SHARDS = 4096
#: Bytes of a block: the most that one task sorts together.
BLOCK_BYTES = 8 << 20


def size_of(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) plus ROW_BYTES."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def text_crc(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def min_cost_flow(sizes: list[int], capacities: list[int]) -> dict[tuple[int, int], int]:
    """Bytes from old shard i to new shard j at the least cost, where a byte that changes shards costs 1.

    Successive shortest paths over source, old shards, a hub that every moved byte passes, new shards and
    sink. An old shard i and the new shard i are one place. The capacities must sum to the sizes.
    """
    if sum(sizes) != sum(capacities):
        raise ValueError("capacities must sum to the old shards' sizes")
    n, m = len(sizes), len(capacities)
    source, hub, sink = n + m, n + m + 1, n + m + 2
    graph: list[list[int]] = [[] for _ in range(n + m + 3)]
    to, room, cost = [], [], []

    def arc(a: int, b: int, most: int, price: int) -> None:
        for x, y, r, c in ((a, b, most, price), (b, a, 0, -price)):
            graph[x].append(len(to))
            to.append(y)
            room.append(r)
            cost.append(c)

    total = sum(sizes)
    keep = {}
    for i, s in enumerate(sizes):
        arc(source, i, s, 0)
        if i < m:
            keep[i] = len(to)
            arc(i, n + i, total, 0)
        arc(i, hub, total, 1)
    for j, c in enumerate(capacities):
        arc(hub, n + j, total, 0)
        arc(n + j, sink, c, 0)
    while True:
        far, via, queue, waiting = {source: 0}, {}, deque([source]), {source}
        while queue:
            x = queue.popleft()
            waiting.discard(x)
            for e in graph[x]:
                if room[e] and far[x] + cost[e] < far.get(to[e], 1 << 60):
                    far[to[e]], via[to[e]] = far[x] + cost[e], e
                    if to[e] not in waiting:
                        queue.append(to[e])
                        waiting.add(to[e])
        if sink not in far:
            break
        path, x = [], sink
        while x != source:
            path.append(via[x])
            x = to[via[x] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push
    flow = {(i, i): room[e ^ 1] for i, e in keep.items()}
    surplus = deque([i, s - flow.get((i, i), 0)] for i, s in enumerate(sizes))
    for j, c in enumerate(capacities):
        need = c - flow.get((j, j), 0)
        while need:
            i, left = surplus[0]
            take = min(left, need)
            if take:
                flow[i, j] = flow.get((i, j), 0) + take
                need -= take
                surplus[0][1] -= take
            if not surplus[0][1]:
                surplus.popleft()
    return {k: v for k, v in flow.items() if v}


def stretches(flow: dict[tuple[int, int], int]) -> list[tuple[int, int, int, int]]:
    """(old, first byte, end byte, new) of each transfer in the old shard's order; what stays comes first."""
    out, at = [], {}
    for i, j in sorted(flow, key=lambda p: (p[0], p[0] != p[1], p[1])):
        out.append((i, at.get(i, 0), at.get(i, 0) + flow[i, j], j))
        at[i] = out[-1][2]
    return out


def snap(parts: list[tuple[int, int, int, int]], rows: dict[tuple[int, int], list[tuple[int, int]]], capacities: list[int]) -> list[tuple[int, int, int, int]]:
    """The stretches with each inner border at one of its candidate row borders, sizes nearest capacities.

    rows: for each inner border (old, byte) the (byte, row number) of row borders around it.
    """
    borders = sorted(rows)
    chosen = {b: min(rows[b], key=lambda r: abs(r[0] - b[1])) for b in borders}
    sides = {b: (next(p[3] for p in parts if p[0] == b[0] and p[2] == b[1]), next(p[3] for p in parts if p[0] == b[0] and p[1] == b[1])) for b in borders}
    off = [0] * len(capacities)
    for b in borders:
        off[sides[b][0]] += chosen[b][0] - b[1]
        off[sides[b][1]] -= chosen[b][0] - b[1]
    for _ in range(50):
        before = dict(chosen)
        for b in borders:
            left, right = sides[b]
            if left == right:
                continue
            now = chosen[b][0]
            best = min(rows[b], key=lambda r: ((off[left] + r[0] - now) ** 2 + (off[right] - r[0] + now) ** 2, r))
            off[left] += best[0] - now
            off[right] -= best[0] - now
            chosen[b] = best
        if chosen == before:
            break
    at = lambda i, byte, default: chosen.get((i, byte), default)
    out = []
    for i, lo, hi, j in parts:
        a, row = at(i, lo, (0, 0))
        b, _ = at(i, hi, (1 << 62, 0))
        if a < b:
            out.append((i, a, row, j))
    return out


def reshard(docs: DataFrame, old: Column, n_old: int, capacities: list[int] | int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with old_shard, shard, slot (from 0 without gaps in each shard) and moved.

    old: each row's shard today, 0 to n_old - 1. capacities: bytes of each new shard, scaled to the data's
    size, or a number of equal shards. Two passes over row sizes and one shuffle of the rows themselves;
    the driver sees shard totals and the few rows at the borders of transfers.
    """
    spark = docs.sparkSession
    weights = [1] * capacities if isinstance(capacities, int) else capacities
    if max(n_old, len(weights)) > MAX_SHARDS:
        raise ValueError(f"more than {MAX_SHARDS} shards")
    names = [c for c in docs.columns if c not in ("shard", "slot", "moved", "old_shard")]
    order = ["_key", "_tie"]
    keyed = docs.select(*names, F.coalesce(old.cast("int"), F.lit(0)).alias("old_shard"), size_of(F.col(text)).alias("_size"), F.col(key).alias("_key"), F.xxhash64(text, *[F.col(c) for c, t in docs.dtypes if c in names and c != text and not t.startswith("map")]).alias("_tie"))
    narrow = cut(keyed.select("old_shard", "_size", "_key", "_tie"))
    totals = {r[0]: (r[1], r[2]) for r in bounded(narrow.groupBy("old_shard").agg(F.sum("_size"), F.count("*")), MAX_SHARDS, "old shards")}
    if any(not 0 <= i < n_old for i in totals):
        raise ValueError(f"old shards must be 0 to {n_old - 1}")
    sizes = [totals.get(i, (0, 0))[0] for i in range(n_old)]
    whole = sum(sizes)
    shares = [whole * w // sum(weights) for w in weights]
    for j in range(whole - sum(shares)):
        shares[j % len(shares)] += 1
    parts = stretches(min_cost_flow(sizes, shares))

    # Blocks deal a shard's rows by hash; a block's place is the running size of those before it.
    blocks = max(1, -(-max(sizes, default=0) // BLOCK_BYTES), min(64, -(-max((n for _, n in totals.values()), default=0) // 200)))
    block = F.pmod(F.xxhash64("_key", "_tie"), F.lit(blocks)).cast("int").alias("_block")
    before = Window.partitionBy("old_shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = cut(
        narrow.select("old_shard", block, "_size")
        .groupBy("old_shard", "_block")
        .agg(F.sum("_size").alias("_bytes"), F.count("*").alias("_rows"))
        .select("old_shard", "_block", "_bytes", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_base"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_row_base"))
    )
    inside = Window.partitionBy("old_shard", "_block").orderBy(*order)
    run = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def placed(df: DataFrame) -> DataFrame:
        return df.withColumns({"_end": F.col("_base") + F.sum("_size").over(run), "_row": F.col("_row_base") + F.row_number().over(inside) - 1})

    inner = [(i, lo) for i, lo, _, _ in parts if lo]
    candidates: dict[tuple[int, int], list[tuple[int, int]]] = {b: [] for b in inner}
    if inner:
        ends = spark.createDataFrame(inner, "old_shard int, _border long")
        near = bases.join(F.broadcast(ends), "old_shard").where((F.col("_base") <= F.col("_border")) & (F.col("_border") < F.col("_base") + F.col("_bytes")))
        found = placed(narrow.withColumn("_block", block).join(F.broadcast(near.drop("_border").distinct()), ["old_shard", "_block"]))
        found = found.join(F.broadcast(near.select("old_shard", "_block", "_border")), ["old_shard", "_block"])
        gap = F.abs(F.col("_end") - F.col("_border"))
        close = found.withColumn("_nth", F.row_number().over(Window.partitionBy("old_shard", "_border").orderBy(gap, "_end"))).where("_nth <= 9")
        for i, border, end, row, size in bounded(close.select("old_shard", "_border", "_end", "_row", "_size"), 20 * MAX_SHARDS, "rows at borders"):
            candidates[i, border] += [(end, row + 1), (end - size, row)]
        candidates = {b: sorted(set(v)) for b, v in candidates.items()}
        candidates = _apart(candidates)
    parts = snap(parts, candidates, shares)

    # Slots follow old shard, block and row: a stretch begins where the one before it in its new shard ends.
    counts = {p: nxt - p[2] for p, nxt in ((p, next((q[2] for q in parts[k + 1 : k + 2] if q[0] == p[0]), totals[p[0]][1])) for k, p in enumerate(parts))}
    used = [0] * len(weights)
    arms = []
    for p in parts:
        i, first, row, j = p
        arms.append((i, first, j, used[j] - row))
        used[j] += counts[p]
    starts = {}
    for i, first, j, shift in arms:
        starts.setdefault(i, []).append((first, j, shift))
    moves = spark.createDataFrame([(i, starts.get(i, [])) for i in range(n_old)], "old_shard int, _starts array<struct<first:long,shard:int,shift:long>>")
    rows = keyed.withColumn("_block", block).join(bases.select("old_shard", "_block", "_base", "_row_base"), ["old_shard", "_block"])
    begin = F.col("_end") - F.col("_size")
    arm = F.element_at(F.filter("_starts", lambda s: s["first"] <= begin), -1)
    return (
        placed(rows)
        .join(F.broadcast(moves), "old_shard")
        .withColumn("_arm", arm)
        .select(*names, "old_shard", F.col("_arm.shard").alias("shard"), (F.col("_row") + F.col("_arm.shift")).alias("slot"), (F.col("_arm.shard") != F.col("old_shard")).alias("moved"))
    )


def _apart(candidates: dict[tuple[int, int], list[tuple[int, int]]]) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """Of each border the candidates that lie nearer to it than to its neighbours, so borders keep their order."""
    by: dict[int, list[int]] = {}
    for i, at in sorted(candidates):
        by.setdefault(i, []).append(at)
    out = {}
    for i, borders in by.items():
        floor = 0
        for k, at in enumerate(borders):
            ceiling = (at + borders[k + 1]) // 2 if k + 1 < len(borders) else 1 << 62
            fit = [c for c in candidates[i, at] if floor <= c[0] <= ceiling]
            out[i, at] = fit or [max(candidates[i, at], key=lambda c: (c[0] >= floor, -abs(c[0] - at)))]
            floor = max(c[0] for c in out[i, at]) if fit else out[i, at][0][0]
    return out


def write_shards(resharded: DataFrame, path: str) -> DataFrame:
    """Writes every shard that gave or took rows under path/shard=N, and returns what was written.

    Files of shards that neither gave nor took rows stay where they are; the caller keeps them.
    """
    touched = resharded.where("moved").select(F.explode(F.array("old_shard", "shard")).alias("shard")).distinct()
    resharded.join(F.broadcast(touched), "shard", "left_semi").write.partitionBy("shard").parquet(path)
    return resharded.sparkSession.read.parquet(path)


def op1(spark: SparkSession, docs: DataFrame, old_shards: int = 16, new_shards: int = 24) -> DataFrame:
    """All documents, from shards by source to equal shards by bytes."""
    sized = docs.select("doc_id", "text", "source", size_of(F.col("text")).alias("size"), text_crc(F.col("text")).alias("text_crc32"))
    old = F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(old_shards))
    out = reshard(sized, old, old_shards, new_shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "old_shard", "moved")
