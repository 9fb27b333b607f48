"""How five text filters act together: what each removes in every order, and each filter's Shapley value.

Every document gets one mask of the filters it fails. The counts of the 32 masks of a part tell what any coalition
of filters removes; differences of coalitions are the counts of each step of all 120 orders. The Shapley values
are the exact solution of the kernel-weighted least squares over the coalitions under the constraint that they
add up to what all filters remove, solved in rationals.

A null text is empty. Rows without a doc_id count, never repeat a smaller doc_id and are none for others; rows that
share doc_id and text don't repeat each other. A doc_id with several labels is good or toxic if any row says so.
Texts of any length are taken whole. An empty table gives no rows. Only doc_id, text, lang and the labels' doc_id,
quality and toxic are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import comb

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, table

FILTERS = "ABCDE"
ALL = 2 ** len(FILTERS) - 1
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: the text fails A, B, C, D."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))[0]
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    fails = [n["n"] < 100, 100 * n["d"] < 80 * n["n"], 100 * capitals > 10 * F.length(text), text.rlike(r"[#$%&*|]")]
    mask = F.lit(0)
    for i, bad in enumerate(fails):
        mask = mask.bitwiseOR(F.when(bad, F.lit(1 << i)).otherwise(F.lit(0)))
    return mask


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents by the set of filters that they fail.

    Copies are counted before they meet: a text's rows become one row for each part and label, so that a text
    that a third of the table has is no hot group. A row repeats a smaller doc_id unless its own is the smallest.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang"), F.lit("")).alias("part"), text_mask(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("key"))
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = rows.join(known, "doc_id", "left").select("doc_id", "part", "mask", "key", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    kinds = ["key", "part", "mask", "good", "toxic"]
    by_id = rows.groupBy("doc_id", *kinds).agg(F.count("*").alias("n"))
    groups = by_id.groupBy(*kinds).agg(F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("at_least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"))
    first = F.min("least").over(Window.partitionBy("key"))
    groups = groups.withColumn("passing", F.when(F.col("least") == first, F.col("at_least")).otherwise(0) + F.col("nameless"))
    sides = F.array(F.struct("mask", F.col("passing").alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(16)).alias("mask"), (F.col("n") - F.col("passing")).alias("n")))
    each = groups.select("part", "good", "toxic", F.explode(sides).alias("s")).select("part", "good", "toxic", "s.mask", "s.n").where("n > 0")
    return each.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))


def solve(rows: list[list[Fraction]]) -> list[Fraction]:
    """The solution of square linear equations, each row with its right side at the end, in rationals."""
    rows = [list(r) for r in rows]
    for i in range(len(rows)):
        at = next(k for k in range(i, len(rows)) if rows[k][i])
        rows[i], rows[at] = rows[at], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for k in range(len(rows)):
            if k != i and rows[k][i]:
                rows[k] = [x - rows[k][i] * y for x, y in zip(rows[k], rows[i], strict=True)]
    return [r[-1] for r in rows]


def shapley(value: list[int]) -> list[Fraction]:
    """Shapley values of a game of n players given by the values of its 2^n coalitions, that of none being 0.

    Least squares over all coalitions but none and all, weighted by the Shapley kernel, with a multiplier for the
    constraint that the values add up to that of all.
    """
    n = len(value).bit_length() - 1
    if n == 1:
        return [Fraction(value[1])]
    normal = [[Fraction(0)] * (n + 2) for _ in range(n + 1)]
    for s in range(1, len(value) - 1):
        inside = [i for i in range(n) if s >> i & 1]
        weight = Fraction(n - 1, comb(n, len(inside)) * len(inside) * (n - len(inside)))
        for i in inside:
            for j in inside:
                normal[i][j] += weight
            normal[i][-1] += weight * value[s]
    for i in range(n):
        normal[i][n] = normal[n][i] = Fraction(1)
    normal[n][-1] = Fraction(value[-1])
    return solve(normal)[:n]


def steps(part: str, counts: dict[int, tuple[int, int, int]]) -> list[tuple]:
    """Rows of SCHEMA from a part's mask -> (n, good, toxic)."""
    lost = [[sum(c[k] for m, c in counts.items() if m & s) for s in range(ALL + 1)] for k in range(3)]
    total, orders = sum(c[0] for c in counts.values()), list(permutations(range(len(FILTERS))))
    share = [int(x * len(orders)) for x in shapley(lost[0])]
    out = []
    for order in orders:
        before = 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed, good, toxic = (x[after] - x[before] for x in lost)
            alone = counts.get(1 << i, (0,))[0]
            out.append((part, "".join(FILTERS[k] for k in order), step, total - lost[0][after], removed, lost[0][1 << i] - removed, alone, good, toxic, share[i]))
            before = after
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of that step, for every part, order and step."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, entries in zip(batch["part"], batch["entries"], strict=True):
                counts = {e["mask"]: (e["n"], e["good"], e["toxic"]) for e in entries}
                yield pd.DataFrame(steps(part, counts), columns=["part", "filter_order", "step", *COUNTS])

    parts = mask_counts(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("entries"))
    return parts.mapInPandas(run, SCHEMA)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CAST(len(ws) < 100 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 80 * len(ws) AS INT)
    + 4 * CAST(100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) AS INT) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
    + 16 * CAST(coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false) AS INT) AS mask
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
m AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (
  SELECT filter_order, CAST(step AS INT) AS step, 1 << (ascii(substr(filter_order, step, 1)) - 65) AS own,
    CAST(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(substr(filter_order, i, 1)) - 65))) AS BIGINT) AS done
  FROM o, (SELECT unnest(range(1, 6)) AS step)),
c AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN mask & (coalesce(done, 0) | own) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & own > 0 AND mask & coalesce(done, 0) = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & own > 0 AND mask & coalesce(done, 0) > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & own > 0 AND mask & coalesce(done, 0) = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & own > 0 AND mask & coalesce(done, 0) = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM m, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM c
"""
