"""Document fingerprints by winnowing, in DataFrame functions alone.

A text is a run of tokens: stretches of at most 8 characters of its words. The window of K tokens rolls over
the text; its hash is the cyclic polynomial of its tokens' hashes (each token further from the end is rotated
by one more bit, all are joined by XOR), which is put together from hashes of shorter windows, so that no
token is hashed again for each window. Of each W successive hashes the least is kept, the rightmost of equals,
together with its position. Any run of K + W - 1 tokens that two texts share leaves at least one common hash.

Null is an empty text, which has no hashes; two texts without hashes are alike (1.0). A text with fewer
than K tokens has one hash, of all of them; with fewer than W hashes it keeps the least. Documents of null
id come first in order, those of equal id by their text's hash. Copies of a row follow each other. An empty
table gives an empty result. A text of any length is one row, with some 50 bytes of arrays for each token
while it is winnowed. K and W are small, so that a text of 60 characters still shares a hash with its copy of
which a quarter was replaced. Only doc_id and text are read, so further columns may have any names.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K, W = 3, 4
TOKEN = r"[^\x20\x09-\x0D]{1,8}"
#: A kept value is 36 bits of hash above 27 bits of position, which count down so that the rightmost is least.
HASH_BITS, PLACE_BITS = 36, 27
#: Documents in a stretch of ids that one task orders, and the most stretches.
STRETCH, MOST_STRETCHES, FAN = 512, 16_384, 128


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def turned(value: Column, bits: int) -> Column:
    """64 bits, rotated to the left."""
    bits %= 64
    return F.shiftleft(value, bits).bitwiseOR(F.shiftrightunsigned(value, 64 - bits)) if bits else value


def gram_hashes(text: Column, k: int = K) -> Column:
    """Hashes of the runs of k tokens in order; of a shorter text the one hash of all; of an empty text none.

    A window's hash is that of its first part, turned by the length of the rest, XOR that of the rest.
    """

    def windows(h: Column, n: int, use: Callable[[Column], Column]) -> Column:
        """use(hashes of the windows of n); those that reach past the end are null."""
        if n == 1:
            return use(h)
        if n % 2:
            grown = lambda g: F.transform(g, lambda x, i: turned(x, 1).bitwiseXOR(F.get(h, i + (n - 1))))
            return windows(h, n - 1, lambda g: let(grown(g), use))
        double = lambda g: F.transform(g, lambda x, i: turned(x, n // 2).bitwiseXOR(F.get(g, i + n // 2)))
        return windows(h, n // 2, lambda g: let(double(g), use))

    def grams(h: Column) -> Column:
        rolled = windows(h, k, lambda g: F.slice(g, 1, F.greatest(F.lit(0), F.size(g) - k + 1)))
        return F.when(F.size(h) >= k, rolled).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    return let(F.transform(tokens, lambda t: F.xxhash64(t)), grams)


def winnow(text: Column, k: int = K, w: int = W) -> Column:
    """Kept values in order of position: hash above position, both recovered by hashes() and places()."""
    mask, last = (1 << HASH_BITS) - 1, (1 << PLACE_BITS) - 1
    packed = F.transform(gram_hashes(text, k), lambda h, i: F.shiftleft(h.bitwiseAND(F.lit(mask)), PLACE_BITS).bitwiseOR(F.lit(last) - i.cast("long")))

    def least(values: Column, reach: int) -> Column:
        """Minimum over `reach` values from each place on, by doubling; at the end over those that are left."""
        if reach >= w:
            return F.array_distinct(F.slice(values, 1, F.greatest(F.lit(1), F.size(values) - w + 1)))
        step = min(reach, w - reach)
        return let(F.transform(values, lambda x, i: F.least(x, F.get(values, i + step))), lambda v: least(v, reach + step))

    return let(packed, lambda p: F.when(F.size(p) == 0, p).otherwise(least(p, 1)))


def hashes(kept: Column) -> Column:
    return F.array_distinct(F.transform(kept, lambda x: F.shiftrightunsigned(x, PLACE_BITS)))


def places(kept: Column) -> Column:
    last = (1 << PLACE_BITS) - 1
    return F.transform(kept, lambda x: F.lit(last) - x.bitwiseAND(F.lit(last)))


def written(kept: Column) -> Column:
    """hash@position of each kept value, in hexadecimal, by position."""
    last = (1 << PLACE_BITS) - 1
    return F.array_join(F.transform(kept, lambda x: F.concat(F.lower(F.hex(F.shiftrightunsigned(x, PLACE_BITS))), F.lit("@"), F.lower(F.hex(F.lit(last) - x.bitwiseAND(F.lit(last)))))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two fingerprints' hashes."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every == 0, F.lit(1.0)).otherwise(both / F.greatest(every, F.lit(1)))


def with_next(docs: DataFrame, key: str, tie: str, carry: list[str]) -> DataFrame:
    """docs with next_<c> of each carried column: from the next row by key, of the last row from the first.

    Rows are dealt by stretches of the key's quantiles. The first row of a stretch also goes to the stretch
    before it, so one shuffle of the rows is enough.
    """
    ids = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("_k"))
    n = min(MOST_STRETCHES, max(1, docs.count() // STRETCH))
    found = ids.agg(F.percentile_approx("_k", [i / n for i in range(n)], max(10_000, 10 * n)), F.min("_k")).first()
    starts = sorted({*(found[0] or []), found[1] if found[1] is not None else 0})
    groups = [starts[i : i + FAN] for i in range(0, len(starts), FAN)]
    heads, nested = F.from_json(F.lit(json.dumps([g[0] for g in groups])), "array<bigint>"), F.from_json(F.lit(json.dumps(groups)), "array<array<bigint>>")
    k = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    upto = lambda array, value: F.size(F.filter(array, lambda s: s <= value))
    placed = docs.withColumn("_k", k).withColumn("_group", upto(heads, F.col("_k"))).withColumn("_inside", upto(F.element_at(nested, F.col("_group")), F.col("_k")))
    is_head = F.element_at(F.element_at(nested, F.col("_group")), F.col("_inside")) == F.col("_k")
    stretch = (F.col("_group") - 1) * FAN + F.col("_inside") - 1
    own = F.struct(stretch.alias("stretch"), F.lit(0).alias("guest"))
    before = F.struct((stretch - 1).alias("stretch"), F.lit(1).alias("guest"))
    around = F.struct(F.lit(len(starts) - 1).alias("stretch"), F.lit(2).alias("guest"))
    spots = F.when(is_head & (stretch == 0), F.array(own, around)).when(is_head, F.array(own, before)).otherwise(F.array(own))
    spread = placed.select(*docs.columns, "_k", F.explode(spots).alias("_spot"))
    order = Window.partitionBy("_spot.stretch").orderBy("_spot.guest", "_k", tie)
    follows = spread.withColumns({f"next_{c}": F.lead(c).over(order) for c in carry})
    return follows.where("_spot.guest = 0").select(*docs.columns, *[f"next_{c}" for c in carry])


def op3(spark: SparkSession, docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    made = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("_tie"), winnow(text).alias("kept"))
    pairs = with_next(made, "doc_id", "_tie", ["text", "kept"])
    n, part = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    edited = pairs.select("doc_id", n.cast("long").alias("n_chars"), "kept", "next_kept", F.concat(F.substring("text", F.lit(1), n - part), F.substring("next_text", F.lit(1), part)).alias("edited"))
    again = edited.withColumn("edited_kept", winnow(F.col("edited")))
    both = again.withColumns({"_own": hashes(F.col("kept")), "_edited": hashes(F.col("edited_kept")), "_next": hashes(F.col("next_kept"))})
    return both.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), written(F.col("kept")).alias("fingerprint"), written(F.col("edited_kept")).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_edited")).alias("near_edited"), likeness(F.col("_own"), F.col("_next")).alias("near_next"),
    )
