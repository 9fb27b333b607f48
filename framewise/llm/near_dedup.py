"""Near-duplicate documents by min-max hashing.

Each permutation of a document's shingles keeps both its minimum and its maximum, so a signature of 2p
values costs p hash evaluations. Bands of the signature propose links; links are confirmed on the full
shingle sets; components are found over the confirmed links.

A band bucket never turns into all its pairs. Every member is compared with the bucket's hub, the member
that meets most others. In buckets whose members are still in several components, each member is written
as its set's difference from a root (a hub's hub), and what may still link is found by a prefix join on
these differences, rarest elements first, which is exact and makes few pairs. Equal word sequences are one
node from the start. Components of the second step are found over those of the first.

Null and empty texts have no shingles and link with nothing. Rows that repeat are copies of one node. An
empty table gives an empty result. A text with fewer words than a shingle is one shingle. A very long text
is worked through in pieces of its shingles; its set goes whole into one row. Ties between hubs and between
components go to the smallest number. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, give_back, mix64, parts, shingles, slices, stored, text_bytes, word_hashes

#: 48 permutations give 96 values: 24 bands of 4. Two sets of similarity 0.85 miss all bands once in 5e7.
PERMUTATIONS, ROWS = 48, 4
#: Most ids, of at most 32 bytes each, that are broadcast to pick rows; more are joined by a shuffle.
BROADCAST_IDS = 300_000
_SEEDS = np.random.default_rng(20240607)
_ODD = _SEEDS.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _SEEDS.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)


def signature(items: np.ndarray) -> np.ndarray:
    """Minimum and maximum of a set under each permutation, minima first."""
    low = np.full(PERMUTATIONS, np.uint64(2**64 - 1))
    high = np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(items), 1024):
        grid = items[None, at : at + 1024] * _ODD[:, None] + _ADD[:, None]
        np.minimum(low, grid.min(axis=1), out=low)
        np.maximum(high, grid.max(axis=1), out=high)
    return np.concatenate((low, high))


def bands(values: np.ndarray) -> np.ndarray:
    """One hash for each band of ROWS values; a band takes minima or maxima of different permutations."""
    grid = mix64(values).reshape(-1, ROWS)
    out = np.arange(len(grid), dtype=np.uint64)
    for r in range(ROWS):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + grid[:, r])
    return out


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity from two signatures: unbiased, with less variance than as many minima alone."""
    return float((a == b).mean())


def _per_document(k: int, wanted: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (doc_id, node, n_shingles, band hashes) of (doc_id, text); if wanted, (id, set) of (id, text, node).

    Where the nodes are given, rows of other words are left out: they only share a wanted row's doc_id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts(whole)):
            texts = text_bytes(batch.column(1))
            asked = batch.column(2).to_pylist() if wanted else None
            for lo, hi in slices(texts):
                words, starts = word_hashes(texts[lo:hi])
                rows, nodes, lists = [], [], []
                counts = []
                for i in range(hi - lo):
                    own = words[starts[i] : starts[i + 1]]
                    node = hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None
                    if asked and asked[lo + i] != node:
                        continue
                    items = np.unique(shingles(own, k))
                    rows.append(lo + i)
                    nodes.append(node)
                    counts.append(len(items))
                    if wanted:
                        lists.append(items.view(np.int64))
                    else:
                        lists.append(bands(signature(items)).view(np.int64) if len(items) else np.zeros(0, np.int64))
                sizes = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
                values = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int64)))
                key = batch.column(0).take(pa.array(rows, pa.int64()))
                if wanted:
                    yield pa.RecordBatch.from_arrays([key, values], names=["id", "items"])
                else:
                    yield pa.RecordBatch.from_arrays([key, pa.array(nodes, pa.binary()), pa.array(counts, pa.int64()), values], names=["doc_id", "node", "n_shingles", "items"])
        give_back()

    return run


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, node (a hash of the word sequence), n_shingles and the band hashes of every row."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_per_document(k, False), "doc_id long, node binary, n_shingles long, items array<long>")


def picked(rows: DataFrame, few: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """rows joined with few, which is broadcast up to BROADCAST_IDS rows; few is cheap to read twice."""
    return rows.join(F.broadcast(few) if few.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else few, on, how)


def shingle_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """id and shingle set (items) of each wanted node (id, doc_id, node); stored."""
    rows = picked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), wanted, "doc_id")
    sets = stored(rows.select("id", "text", "node").mapInArrow(_per_document(k, True), "id long, items array<long>"))
    if sets.count() == wanted.count():
        return sets
    return stored(sets.dropDuplicates(["id"]))  # rows that repeat


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node of the undirected edges (a, b).

    Each round passes labels over the edges, lowers with them the row of the label held so far (so a tree joins
    its neighbour's tree whole), and then takes the label's own label. Labels only fall, and the rounds go on
    until none does; on chains in random order their number grows with the logarithm of the length.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("component")))
    kind = labels.schema["component"].dataType
    while True:
        heard = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("_heard"))
        told = labels.join(heard, labels["node"] == heard["a"]).select("node", "component", "_heard")
        mine = F.struct("node", F.least("component", "_heard").alias("next"), F.col("component").alias("old"))
        roots = F.struct(F.col("component").alias("node"), F.col("_heard").alias("next"), F.lit(None).cast(kind).alias("old"))
        offers = told.select(F.explode(F.array(mine, roots)).alias("_to"))
        step = offers.groupBy(F.col("_to.node").alias("node")).agg(F.min("_to.next").alias("_next"), F.max("_to.old").alias("component"))
        up = step.select(F.col("node").alias("_up"), F.col("_next").alias("_up_next"))
        jumped = step.join(up, step["_next"] == up["_up"])
        jumped = cut(jumped.select("node", F.col("_up_next").alias("component"), (F.col("_up_next") != F.col("component")).alias("_changed")))
        labels = jumped.select("node", "component")
        if not jumped.where("_changed").limit(1).count():
            return labels


def _sets_of(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """sets of the nodes given."""
    return picked(sets, cut(nodes.distinct()), "id", "left_semi")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of which 100 x intersection >= percent x union on full sets (id, items)."""
    some = _sets_of(sets, pairs.select(F.explode(F.array("a", "b")).alias("id")))
    both = pairs.join(some.toDF("a", "_one"), "a").join(some.toDF("b", "_two"), "b")
    shared = F.size(F.array_intersect("_one", "_two"))
    return both.where(100 * shared >= percent * (F.size("_one") + F.size("_two") - shared)).select(*pairs.columns)


def _fit(n: Column, m: Column, percent: int) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _outsiders(groups: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links of members (id, component c) with their root, and pairs of members that may link, across components.

    With D the difference of a set from the root's, d its size and n the set's, two sets x, y link only if
    D_x and D_y share need = (d_x + d_y - c (n_x + n_y)) / 2 elements, c = (1 - t) / (1 + t). One of a pair
    at least is far (does not link with the root, else the root joins both), and then need is positive. So in
    one order of the elements both begin with a shared one that leaves need elements in either. Elements that
    no pair can share count as read first; the others follow, rarest first. Of an element's rows those go
    that no row on the other side can meet by these bounds, so that elements which most members have make
    no pairs unless they decide.
    """
    tau = percent / 100
    c = (1 - tau) / (1 + tau)
    some = _sets_of(sets, groups.select(F.explode(F.array("root", "id")).alias("id")))
    known = groups.join(some.toDF("id", "_own"), "id").join(some.toDF("root", "_root"), "root")
    away = F.concat(F.array_except("_own", "_root"), F.array_except("_root", "_own"))
    parts = stored(known.select("root", "id", "c", "root_c", F.size("_own").alias("n"), F.size("_root").alias("h"), away.alias("d")))
    parts = parts.withColumns({"d_size": F.size("d"), "far": F.size("d") > c * (F.col("n") + F.col("h")) + 1e-9})
    near = parts.where("not far and c != root_c").select(F.col("c").alias("a"), F.col("root_c").alias("b"))

    each = parts.select("root", "id", "c", "far", F.explode("d").alias("element"))
    df = each.groupBy("root", "element").agg(F.count("*").alias("df"), F.bool_or("far").alias("far"), F.min("c").alias("c1"), F.max("c").alias("c2"))
    df = df.where("df > 1 and far and c1 != c2").select("root", "element", "df")
    ranked = each.join(df, ["root", "element"]).groupBy("root", "id").agg(F.sort_array(F.collect_list(F.struct("df", "element"))).alias("es"))
    placed = ranked.join(parts.drop("d"), ["root", "id"]).select("root", "id", "c", "n", "d_size", "far", (F.col("d_size") - F.size("es")).alias("_first"), F.posexplode("es").alias("_at", "_e"))
    # A pair meets at an element only if low <= high of the other, both ways: that is need <= what is left.
    place, d, n = F.col("_first") + F.col("_at"), F.col("d_size"), F.col("n")
    rows = placed.select("root", "id", "c", "n", "far", F.col("_e.element").alias("element"), (d - c * n - 1e-6).alias("low"), (d - 2 * place + c * n).alias("high"))
    rows = cut(rows.where(F.col("high") >= -c * n / tau))
    by = ["root", "element"]
    least = rows.where("far").groupBy(*by).agg(F.min("low").alias("_far_low"))
    open_ = rows.join(least, by).where("far or high >= _far_low").drop("_far_low")  # near rows only meet far ones
    least = open_.groupBy(*by).agg(F.min("low").alias("_low"), F.min("c").alias("_c1"), F.max("c").alias("_c2")).where("_c1 != _c2")
    open_ = cut(open_.join(least, by).where("high >= _low").drop("_low", "_c1", "_c2"))
    x = open_.where("far").select(*by, *[F.col(k).alias(f"{k}_x") for k in ("id", "c", "n", "low", "high")])
    y = open_.select(*by, *[F.col(k).alias(f"{k}_y") for k in ("id", "c", "n", "low", "high", "far")])
    apart = (F.col("c_x") != F.col("c_y")) & (~F.col("far_y") | (F.col("id_x") < F.col("id_y")))
    meet = (F.col("low_x") <= F.col("high_y")) & (F.col("low_y") <= F.col("high_x")) & _fit(F.col("n_x"), F.col("n_y"), percent)
    pairs = x.join(y, [x[k] == y[k] for k in by] + [apart, meet]).select(F.col("id_x").alias("a"), F.col("id_y").alias("b"), F.col("c_x").alias("ca"), F.col("c_y").alias("cb"))
    return near, pairs.distinct()


def link_components(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, node, n_shingles, component_id and head (the component's first node) of every row of docs (doc_id, text)."""
    rows = cut(signatures(docs, k))
    # The smallest doc_id stands for a node; rows of null ids alone stay by themselves.
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n"), F.first("items").alias("items")).where("doc is not null")
    nodes = cut(nodes.withColumn("id", F.monotonically_increasing_id()))  # fixed from here on, as it is written
    members = nodes.select(F.explode("items").alias("bucket"), "id", "n")
    counts = members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = cut(members.join(counts, "bucket"))
    # A bucket's hub is the member that meets most others in all its buckets: the middle of a group of copies.
    met = shared.groupBy("id").agg(F.sum("size").alias("met"))
    ranked = shared.select("bucket", "id", "n").join(met, "id")
    hubs = ranked.groupBy("bucket").agg(F.max(F.struct("met", "id", "n")).alias("_hub")).select("bucket", F.col("_hub.id").alias("hub"), F.col("_hub.n").alias("hub_n"), F.col("_hub.met").alias("hub_met"))
    ranked = cut(ranked.drop("met").join(hubs, "bucket"))
    wanted = cut(nodes.join(met.select("id"), "id", "left_semi").select("id", F.col("doc").alias("doc_id"), "node"))
    sets = shingle_sets(docs, wanted, k)

    stars = ranked.where((F.col("id") != F.col("hub")) & _fit(F.col("n"), F.col("hub_n"), percent)).select(F.col("hub").alias("a"), F.col("id").alias("b"))
    labels = components(cut(confirm(cut(stars.distinct()), sets, percent)))

    # Buckets with members of several components, by the root of the hub: the hub that its hub meets.
    mine = ranked.select("bucket", "id", "hub").join(labels.toDF("id", "_c"), "id", "left").select("bucket", "id", "hub", F.coalesce("_c", "id").alias("c"))
    odd = mine.groupBy("bucket").agg(F.min("c").alias("_c1"), F.max("c").alias("_c2")).where("_c1 != _c2").select("bucket")
    mine = cut(mine.join(odd, "bucket").select("id", "hub", "c").distinct())
    up = cut(ranked.groupBy("id").agg(F.max(F.struct("hub_met", "hub")).alias("_up")).select("id", F.col("_up.hub").alias("up")))
    root = up.toDF("hub", "_one").join(up.toDF("_one", "root"), "_one").select("hub", "root")
    groups = mine.join(root, "hub").select("root", "id", "c").where("root != id").distinct()
    groups = groups.join(labels.toDF("root", "_c"), "root", "left").select("root", "id", "c", F.coalesce("_c", "root").alias("root_c"))
    mixed = groups.groupBy("root").agg(F.bool_or(F.col("c") != F.col("root_c")).alias("_mixed")).where("_mixed").select("root")
    near, pairs = _outsiders(cut(groups.join(mixed, "root", "left_semi")), sets, percent)
    more = cut(near.union(confirm(cut(pairs), sets, percent).select(F.col("ca").alias("a"), F.col("cb").alias("b"))).distinct())
    if more.limit(1).count():
        joined = components(more).toDF("component", "_to")
        labels = labels.toDF("id", "component").join(joined, "component", "left").select("id", F.coalesce("_to", "component").alias("component"))
        # Nodes that had no link before carry their own number.
        alone = joined.join(labels.select(F.col("id").alias("component")), "component", "left_anti").toDF("id", "component")
        labels = labels.union(alone)
    else:
        labels = labels.toDF("id", "component")

    own = nodes.select("id", "node", "doc").join(labels, "id", "left").select("node", "doc", F.coalesce("component", "id").alias("c"))
    own = cut(own)
    firsts = own.groupBy("c").agg(F.min(F.struct("doc", "node")).alias("_first"))
    named = own.join(firsts, "c").select("node", F.col("_first.doc").alias("component_id"), F.col("_first.node").alias("head"))
    return rows.select("doc_id", "node", "n_shingles").join(named, "node", "left").select("doc_id", "node", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "head")


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component, the one of the smallest doc_id; columns and texts stay as they are.

    Where texts of a component share that doc_id, the text of the smallest node hash stays. Rows without words
    are kept, but of rows with the same doc_id and the same text one stays. Rows with a null doc_id are kept.
    """
    found = cut(link_components(docs.select("doc_id", "text"), k, percent).where("doc_id is not null").select("doc_id", "node", (F.col("doc_id").eqNullSafe(F.col("component_id")) & F.col("node").eqNullSafe(F.coalesce("head", "node"))).alias("stays")))
    repeated = cut(found.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id"))
    gone = cut(found.where("not stays").select("doc_id").union(repeated).distinct())
    kept = picked(docs, gone, "doc_id", "left_anti")
    if not repeated.limit(1).count():
        return kept
    once = Window.partitionBy("doc_id", "_text").orderBy(F.lit(0))
    some = picked(docs, repeated, "doc_id", "left_semi").withColumn("_text", F.xxhash64("text"))
    nodes = signatures(some.select(F.col("_text").alias("doc_id"), "text"), k).select(F.col("doc_id").alias("_text"), F.col("node").alias("_node")).distinct()
    drop = found.where("not stays").select(F.col("doc_id").alias("_gone"), F.col("node").alias("_gone_node")).distinct()
    named = some.join(nodes, "_text")
    stay = named.join(drop, (named["doc_id"] == drop["_gone"]) & (named["_node"] == drop["_gone_node"]), "left_anti")
    # Spellings of one node that differ in blanks or case are one text.
    stay = stay.withColumn("_text", F.coalesce(F.hex("_node"), F.hex("_text"))).withColumn("_nth", F.row_number().over(once)).where("_nth = 1")
    return kept.unionByName(stay.select(*docs.columns))


def op6(spark: SparkSession, docs: DataFrame) -> DataFrame:
    found = link_components(docs.select("doc_id", "text"), 3, 85)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


#: For small tables: all pairs that share a shingle, then the closure of the links.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
         ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: concat_ws(' ', words[i], words[i + 1], words[i + 2]))) END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * shared >= 85 * (nx.n + ny.n - shared)),
r AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, w.doc_id = m.c AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS c FROM r GROUP BY x) m ON m.x = w.doc_id
"""
