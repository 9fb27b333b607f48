"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the key -ln(u) / w, with u from a keyed hash of the document and w its quality
weight. A source's target is met by whole epochs first; the rest is the documents of smallest key whose
running size reaches what is left of the target. The order by key is never materialised: a histogram of
keys finds the bucket that the budget ends in, and only that bucket's documents are sorted. So a source
may hold any share of the rows, and the documents' texts are not shuffled at all.

Null texts have size 0. A null source is a source of its own, last in order. Rows equal in id, source and
text share a key and are taken or left together. An empty table gives an empty result. Columns that clash with
size, source_size, target or copies are replaced. A text of any length is one row of its size, taken whole or not, so a
source of few, long documents misses its target by up to half of the one where its budget ends. Ties of keys between
different rows have no order and are taken or left together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, cut, n_words

#: Sources whose totals the driver may hold.
MAX_SOURCES = 100_000
#: The weights of sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
BUDGET, MOST_EPOCHS = 1.5, 2.0
#: Buckets for each unit of the key's natural logarithm.
BUCKETS = 1024


def targets(sizes: list[int], weights: list[float], budget: float = BUDGET, most: float = MOST_EPOCHS) -> list[float]:
    """Shares of budget x all sizes by weight; what passes most x its size is reshared until none is above."""
    left, open_ = budget * sum(sizes), set(range(len(sizes)))
    out = [0.0] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in sorted(full):
            out[i] = most * sizes[i]
            left -= out[i]
            open_.discard(i)
        left = max(left, 0.0)
    return out


def quality_weight(text: Column) -> Column:
    """Share of letters among the characters that aren't blank, from 0.05 to 1: markup and symbols weigh less."""
    solid = F.length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))
    odd = F.regexp_count(text, F.lit(r"[\x21-\x40\x5B-\x60\x7B-\x7E]"))
    return F.greatest(F.lit(0.05), F.coalesce(1 - odd / F.nullif(solid, F.lit(0)), F.lit(0.05)))


def sampling_key(seed: int, weight: Column, *identity: str) -> Column:
    unit = (F.pmod(F.xxhash64(F.lit(seed), *identity), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(unit) / weight


def mix(docs: DataFrame, size: Column, weight: Column, seed: int = 17, source: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with size, source_size, target and copies, the times that the mix takes each row."""
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies")]
    keyed = docs.select(*names, size.cast("long").alias("size"), sampling_key(seed, weight, key, source, text).alias("_es"))
    narrow = cut(keyed.select(F.col(source).alias("_source"), F.col("size").alias("_size"), "_es"))
    rows = sorted(bounded(narrow.groupBy("_source").agg(F.sum("_size"), F.count("*")), MAX_SOURCES, "sources"), key=lambda r: (r[0] is None, [ord(c) for c in r[0] or ""]))
    sizes = [r[1] or 0 for r in rows]
    wanted = targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(rows))])
    plan = []
    for (name, *_), s, t in zip(rows, sizes, wanted, strict=True):
        epochs = min(int(t // s), int(MOST_EPOCHS)) if s else 0
        plan.append((name, s, float(t), epochs, float(t - epochs * s)))
    schema = "_source string, source_size long, target double, _epochs int, _rest double"
    budget = spark.createDataFrame(plan, schema)
    same = narrow["_source"].eqNullSafe(budget["_source"])
    part = narrow.join(F.broadcast(budget.where("_rest > 0")), same).drop(budget["_source"])
    part = part.withColumn("_bucket", F.floor(F.log(F.greatest("_es", F.lit(1e-300))) * BUCKETS))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        part.groupBy("_source", "_bucket", "_rest")
        .agg(F.sum("_size").alias("_bytes"))
        .withColumn("_base", F.coalesce(F.sum("_bytes").over(before), F.lit(0)))
        .where("_base < _rest and _base + _bytes >= _rest")
    )
    ends = spark.createDataFrame(bounded(ends.select("_source", "_bucket", "_base"), MAX_SOURCES, "sources"), "_in string, _last long, _base long")
    last = part.join(F.broadcast(ends), part["_source"].eqNullSafe(ends["_in"]) & (part["_bucket"] == ends["_last"]))
    by_key = Window.partitionBy("_source").orderBy("_es").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tied = last.groupBy("_source", "_es", "_rest", "_base").agg(F.sum("_size").alias("_sum"))
    taken = tied.withColumn("_end", F.col("_base") + F.sum("_sum").over(by_key)).where(F.col("_end") - F.col("_sum") / 2 <= F.col("_rest"))
    cuts = {r[0]: r[1] for r in bounded(taken.groupBy("_source").agg(F.max("_es")), MAX_SOURCES, "sources")}
    floor = {r[0]: r[1] for r in ends.select("_in", "_last").collect()}
    # Where the last bucket gives none, all earlier buckets still count: the cut is the bucket's lower end.
    final = [(n, s, t, e, cuts.get(n, float("-inf")), floor.get(n, 1 << 60) if r > 0 else -(1 << 60)) for n, s, t, e, r in plan]
    cutoffs = spark.createDataFrame(final, "_name string, source_size long, target double, _epochs int, _cut double, _last long")
    bucket = F.floor(F.log(F.greatest("_es", F.lit(1e-300))) * BUCKETS)
    extra = (bucket < F.col("_last")) | ((bucket == F.col("_last")) & (F.col("_es") <= F.col("_cut")))
    # One row for each of at most MAX_SOURCES sources.
    joined = keyed.join(F.broadcast(cutoffs), keyed[source].eqNullSafe(cutoffs["_name"]), "left")
    return joined.select(*[keyed[c] for c in names], "size", "source_size", "target", (F.col("_epochs") + extra.cast("int")).alias("copies"))


def epochs(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row as often as it is taken."""
    return mixed.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("_copy")


def op2(spark: SparkSession, docs: DataFrame) -> DataFrame:
    text = F.col("text")
    out = mix(docs.select("doc_id", "text", "source"), n_words(text), F.coalesce(quality_weight(text), F.lit(0.05)))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
