"""Line dedup by a deletion-neighbourhood join, in DataFrame functions alone.

Lines are compared by their words. A line goes if an earlier line (by doc_id, then
place) of the whole table has the same words, or if it has NEAR_WORDS words or more and an earlier line is
within one word edit: a word replaced, inserted or deleted. Lines of fewer than MIN_WORDS words stay.

Near lines are found in three steps. (1) Two lines within one edit share all words before or all words
after it, so they share a hash of about their first or last half: only lines with such a partner go on,
which a bitmap lets a second scan recognise. (2) Each of these emits its deletion variants as hashed keys:
for every place, the line without that word, and the line itself with a gap there. Lines that share a key
agree everywhere but in that place, so all lines of a key are within one edit of each other and the
earliest stands for all: no pairs are formed. (3) The edit distance to it is verified.

Null texts stay null; empty texts stay. Rows equal in doc_id and text count as one document and come out
alike. Null ids come first in order. Texts whose lines all go become empty. An empty table gives an empty
result. A line of very many words is one row with all its words; the hashes of its beginnings and ends are
found block by block. Columns that clash with the counts are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, stored
from .winnowing import let

MIN_WORDS, NEAR_WORDS = 3, 8
#: Bits of the bitmap of half lines with a partner: BITS_EACH for each, rounded up to a power of two within these
#: bounds. It is broadcast, as 128 MB at most; from some 10 million half lines on more lines than need be emit variants.
BITS_EACH, LEAST_BITS, MOST_BITS = 256, 1 << 22, 1 << 29
#: Half lengths from here on are rounded down to multiples of it, so that lines of m and m + 1 words mostly agree.
ROUND = 8
#: The blanks of the word rule besides the space and the end of a line.
_BLANKS = "\t\x0b\x0c\r"


def lines(docs: DataFrame, least: int) -> DataFrame:
    """id, hash, place and words of every line with `least` words or more."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"), "text").where("text is not null")
    text = F.when(F.col("text").rlike(f"[{_BLANKS}]"), F.translate("text", _BLANKS, " " * len(_BLANKS))).otherwise(F.col("text"))
    words = lambda line: F.array_remove(F.split(line, " "), "")
    # Filtered inside the array: a filter after it would be pushed down and split the text twice.
    found = F.filter(F.transform(F.split(text, "\n"), lambda line, i: F.struct(i.alias("place"), words(line).alias("words"))), lambda x: F.size(x["words"]) >= least)
    return keyed.select("id", "hash", F.inline(found))


def _half(m: Column) -> Column:
    """Words that two lines surely share on one side of an edit, if the shorter has m words."""
    c = F.floor((m - 1) / 2).cast("int")
    return F.when(c < ROUND, c).otherwise(c - c % ROUND)


def half_keys(words: Column, side: int) -> list[Column]:
    """Hashes of the first (side 0) or last half, for the line as the shorter and as the longer of a pair.

    The second is null where it equals the first, both are where the line is too short to be near any.
    """
    m = F.size(words)
    one, two = _half(m), _half(m - 1)
    key = lambda h: F.xxhash64(F.slice(words, 1 if side == 0 else m - h + 1, h), h, F.lit(side))
    return [F.when(m >= NEAR_WORDS - 1, key(one)), F.when((m >= NEAR_WORDS - 1) & (one != two), key(two))]


def _running(values: Column) -> Column:
    """0 and, after each value, the exclusive or of all values so far; quadratic, so for short arrays."""
    return F.aggregate(values, F.array(F.lit(0).cast("long")), lambda done, x: F.concat(done, F.array(F.element_at(done, -1).bitwiseXOR(x))))


def with_beginnings(hashes: Column, use) -> Column:
    """use(at), where at(i) is the exclusive or of the first i hashes: found in blocks of the root of their number."""
    def sized(h: Column, size: Column) -> Column:
        def known(inner: Column) -> Column:
            before = _running(F.transform(inner, lambda b: F.element_at(b, -1)))
            return let(before, lambda b: use(lambda i: F.get(b, F.floor(i / size).cast("int")).bitwiseXOR(F.get(F.get(inner, F.floor(i / size).cast("int")), (i % size).cast("int")))))

        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(h) / size).cast("int")), lambda k: _running(F.slice(h, k * size + 1, size)))
        return let(blocks, known)

    # Each step is a variable of its own: an expression would be computed again at each use.
    return let(hashes, lambda h: let(F.greatest(F.lit(8), F.ceil(F.sqrt(F.size(h))).cast("int")), lambda size: sized(h, size)))


def variants(words: Column, first: Column, last: Column) -> Column:
    """Keys of the line without word i, and of the line with a gap before word i, for i from first to last.

    A word before the gap is hashed with its distance from the line's begin, one after it with that from its end.
    """
    m = F.size(words)  # words and the bounds are columns, read in place
    begins = F.transform(words, lambda w, j: F.xxhash64(w, j))
    ends = F.transform(F.reverse(words), lambda w, j: F.xxhash64(w, j, F.lit(1)))

    def keys(before) -> Column:
        def both(after) -> Column:  # after(i): of the last i words
            without = F.transform(F.sequence(first, F.least(last, m - 1)), lambda i: F.xxhash64(i, m - 1, before(i), after(m - 1 - i)))
            gaps = F.transform(F.sequence(first, last), lambda i: F.xxhash64(i, m, before(i), after(m - i)))
            return F.concat(without, gaps)

        return with_beginnings(ends, both)

    return with_beginnings(begins, keys)


def within_one(a: Column, b: Column) -> Column:
    """Whether two word arrays differ by one replaced, inserted or deleted word at most."""
    short, long = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    gap = F.size(long) - F.size(short)
    other = F.filter(F.sequence(F.lit(0), F.size(short) - 1), lambda i: F.get(short, i) != F.get(long, i))
    first = F.coalesce(F.get(other, 0), F.size(short))  # where they part
    tail = lambda x, n: F.slice(x, n + 1, F.greatest(F.lit(0), F.size(x) - n))
    return (gap == 0) & (F.size(other) <= 1) | (gap == 1) & (tail(short, first) == tail(long, first + 1))


def _bitmap(keys: DataFrame, bits: int) -> DataFrame:
    """bucket, cells: bit sets of the keys (side), 32 bits in each cell."""
    place = F.pmod("side", F.lit(bits)) + 1
    cell = F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda i: F.conv(F.hex(F.substring("bitmap", i * 4 + 1, F.lit(4))), 16, 10).cast("long"))
    made = keys.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bitmap"))
    return cut(made.select("bucket", cell.alias("cells")))


def _marked(rows: DataFrame, keys: list[str], bitmap: DataFrame, bits: int) -> DataFrame:
    """rows with <key>_met: whether the bitmap has the key; null keys it never has."""
    for k in keys:
        place = F.pmod(k, F.lit(bits)) + 1
        rows = rows.withColumns({"_bucket": F.bitmap_bucket_number(place), "_at": F.bitmap_bit_position(place).cast("int")})
        # At most MOST_BITS / 32768 rows of 8 KB.
        rows = rows.join(F.broadcast(bitmap.withColumnRenamed("bucket", "_bucket")), "_bucket", "left")
        bit = F.expr("shiftright(get(cells, _at div 32), cast((3 - (_at div 8) % 4) * 8 + _at % 8 as int)) & 1 = 1")
        rows = rows.withColumn(f"{k}_met", F.coalesce(bit, F.lit(False))).drop("_bucket", "_at", "cells")
    return rows


def duplicates(docs: DataFrame) -> DataFrame:
    """id, hash, place and near (false: same words) of every line to drop, once for equal rows."""
    words = F.col("words")
    halves = {f"s{side}{n}": key for side in (0, 1) for n, key in enumerate(half_keys(words, side))}
    k1, k2 = F.xxhash64("words"), F.xxhash64("words", F.lit(1))
    narrow = stored(lines(docs, MIN_WORDS).select("id", "hash", "place", k1.alias("k1"), k2.alias("k2"), *[v.alias(k) for k, v in halves.items()]))
    order = F.struct("id", "hash", "place")
    again = narrow.groupBy("k1", "k2").agg(F.min(order).alias("ord"), F.count("*").alias("n")).where("n > 1").select("k1", "k2", "ord")
    exact = narrow.select("id", "hash", "place", "k1", "k2").join(again, ["k1", "k2"]).where(order != F.col("ord")).select("id", "hash", "place")

    sides = narrow.select(F.explode(F.array_compact(F.array(*halves))).alias("side"), "k1")
    paired = cut(sides.groupBy("side").agg(F.min("k1").alias("least"), F.max("k1").alias("most")).where("least != most").select("side"))
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * paired.count()).bit_length()))
    tried = lines(docs, NEAR_WORDS - 1).select("id", "hash", "place", "words", *[v.alias(k) for k, v in halves.items()])
    begins, ends = F.col("s00_met") | F.col("s01_met"), F.col("s10_met") | F.col("s11_met")
    met = _marked(tried, list(halves), _bitmap(paired, bits), bits).where(begins | ends)
    near = met.groupBy(k1.alias("k1"), k2.alias("k2")).agg(F.min(order).alias("ord"), F.first("words").alias("words"), F.first(begins).alias("begins"), F.first(ends).alias("ends"))
    # Numbers that rise with the order, as partitions follow it: the least number of a key is its earliest line.
    near = stored(near.orderBy("ord").select("ord", "words", "begins", "ends", F.monotonically_increasing_id().alias("line")))
    # A partner by the first half differs after it, one by the last half before it.
    m = F.size("words")
    least = F.least(_half(m), _half(m - 1))
    from_, to = F.when(F.col("ends"), F.lit(0)).otherwise(least), F.when(F.col("begins"), m).otherwise(m - least)
    keys = near.select("line", F.explode(variants(words, from_, to)).alias("key"))
    heads = keys.groupBy("key").agg(F.min("line").alias("head"), F.max("line").alias("_most")).where("head != _most").drop("_most")
    pairs = keys.join(heads, "key").where("head < line").select("line", "head").distinct()
    known = near.select("line", "ord", "words")
    checked = pairs.join(known, "line").join(known.select(F.col("line").alias("head"), F.col("words").alias("head_words")), "head")
    checked = checked.where(F.size("words") >= NEAR_WORDS).where(within_one(F.col("words"), F.col("head_words")))
    # The first of equal lines goes for being near; the others go as its copies.
    return exact.select("id", "hash", "place", F.lit(False).alias("near")).distinct().union(checked.select("ord.id", "ord.hash", "ord.place", F.lit(True)).distinct())


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with repeated lines taken out of text, and n_lines, n_exact, n_near."""
    names = [c for c in docs.columns if c not in ("n_lines", "n_exact", "n_near")]
    drops = duplicates(docs.select("doc_id", "text")).groupBy("id", "hash").agg(F.collect_set(F.when(~F.col("near"), F.col("place"))).alias("_exact"), F.collect_set(F.when(F.col("near"), F.col("place"))).alias("_near"))
    keyed = docs.select(*names).withColumns({"_id": F.col("doc_id").cast("long"), "_hash": F.xxhash64("text")})
    joined = keyed.join(drops, keyed["_id"].eqNullSafe(drops["id"]) & (keyed["_hash"] == drops["hash"]), "left")
    gone = F.array_union("_exact", "_near")
    parts = F.split("text", "\n")
    # One hashed difference of places, however many lines go.
    kept = let(parts, lambda p: F.transform(F.array_except(F.sequence(F.lit(0), F.size(p) - 1), gone), lambda i: F.get(p, i)))
    text = F.when(F.col("_exact").isNull() | F.col("text").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    counts = {"n_lines": F.coalesce(F.size(parts), F.lit(0)).cast("long"), "n_exact": F.coalesce(F.size("_exact"), F.lit(0)).cast("long"), "n_near": F.coalesce(F.size("_near"), F.lit(0)).cast("long")}
    return joined.select(*[(text if c == "text" else keyed[c]).alias(c) for c in names], *[F.greatest(v, F.lit(0).cast("long")).alias(c) for c, v in counts.items()])


def op10(spark: SparkSession, docs: DataFrame) -> DataFrame:
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_exact", "n_near", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


#: For small tables, with the lines' words in place of hashes; doc_id must be distinct.
ORACLE = rf"""
WITH l AS (
  SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS place, unnest(string_split(text, chr(10))) AS line FROM documents),
w AS (SELECT doc_id, place, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS words FROM l),
f AS (SELECT words, min((doc_id, place)) AS ord FROM w WHERE len(words) >= {MIN_WORDS} GROUP BY words),
i AS (SELECT words, ord, unnest(range(0, len(words) + 1)) AS p FROM f WHERE len(words) >= {NEAR_WORDS} - 1),
v AS (
  SELECT words, ord, p, array_to_string(words[:p], ' ') || ' _ ' || array_to_string(words[p + 1:], ' ') AS k FROM i
  UNION ALL
  SELECT words, ord, p, array_to_string(words[:p], ' ') || ' _ ' || array_to_string(words[p + 2:], ' ') FROM i WHERE p < len(words)),
g AS (SELECT p, k, min(ord) AS head, max(len(words)) AS longest FROM v GROUP BY p, k HAVING count(*) > 1),
n AS (SELECT DISTINCT v.ord FROM v JOIN g ON v.p = g.p AND v.k = g.k AND g.head < v.ord WHERE len(v.words) >= {NEAR_WORDS}),
d AS (
  SELECT w.doc_id, w.place, line, len(w.words) >= {MIN_WORDS} AND (w.doc_id, w.place) <> f.ord AS exact, n.ord IS NOT NULL AND (w.doc_id, w.place) = f.ord AS near
  FROM w LEFT JOIN f ON f.words = w.words LEFT JOIN n ON n.ord = f.ord)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (exact) AS n_exact, count(*) FILTER (near) AS n_near,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT coalesce(exact, false) AND NOT coalesce(near, false)), '')) AS text_sha256
FROM d GROUP BY doc_id
"""
