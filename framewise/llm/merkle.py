"""A Merkle manifest of documents: leaves by language and doc_id, subroots, a root, proofs and their check.

A tree is built in blocks of 256 aligned nodes. A block keeps each of its levels as one hex string: the digests
side by side, 64 characters each. A parent is the hash of a substring of 128 characters (64 at an odd end), and a
node's sibling is the substring beside its own, so a whole level is made and read without a row for each node.
The blocks' tops are the nodes of the next tier, and so on up to one; the tops of the languages form a last tree
in the same way. Positions come from a range sort and the sizes of its partitions, so no language is sorted or
gathered in one task.

A null field is hashed as '-'. Rows of a null language form their own tree, before all others. Null doc_ids come
first in it; rows that share a doc_id are ordered by leaf. A repeated row is a leaf of its own. Texts of any
length are hashed whole. A language of one row is its own subroot. An empty table gives no rows. Only the columns
named in FIELDS are read, so other columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels in a block: 256 nodes, a string of 16,384 characters. A digest has 64 hex characters.
BITS = 8
_PARENTS = "encode(array_join(transform(sequence(0, (length(x) - 1) div 128), i -> sha2(substring(x, cast(i * 128 + 1 as int), 128), 256)), ''), 'UTF-8')"
#: Levels in which a tree of n leaves ends in one node.
_DEPTH = "if(n > 1, length(bin(n - 1)), 0)"


def field(value: Column) -> Column:
    """One field of a leaf: its length in bytes, a colon and the value, or a dash."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(n_chars: Column) -> Column:
    """The digest of a row."""
    return F.sha2(F.concat(*[field(n_chars if c == "n_chars" else F.col(c)) for c in FIELDS]), 256)


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with pos, their place from 0 among the rows of their g, and n, how many those are. Stored."""
    ranged = rows.repartitionByRange(*[F.asc(c) for c in ("g", *order)]).sortWithinPartitions("g", *order)
    rows = stored(ranged.withColumn("_at", F.monotonically_increasing_id()))
    # The upper bits of _at are the partition, so a g has one run of numbers in each.
    runs = rows.groupBy("g", F.shiftright("_at", 33).alias("_run")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("g").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("g", "_run", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(Window.partitionBy("g")).alias("n"))
    placed = rows.withColumn("_run", F.shiftright("_at", 33)).join(runs, ["g", "_run"])
    return placed.withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_run", "_shift")


def climb(nodes: DataFrame, *carried: str) -> list[DataFrame]:
    """The tiers of the trees of nodes (g, pos, n, node, carried columns), from the leaves up.

    A tier has a row for each block: g, block, n (nodes of its g in this tier), members in order (i and what was
    carried) and levels, the hex strings from the members' own up to the block's top. Each tier is stored.
    """
    most, tiers = nodes.agg(F.max("n")).first()[0] or 1, []
    while True:
        member = F.struct(F.col("pos").bitwiseAND(F.lit((1 << BITS) - 1)).alias("i"), "node", *carried)
        blocks = nodes.groupBy("g", F.shiftright("pos", BITS).alias("block")).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(member)).alias("members"))
        blocks = blocks.withColumn("_own", F.expr("encode(array_join(transform(members, m -> m.node), ''), 'UTF-8')"))
        levels = f"aggregate(sequence(0, least({BITS}, {_DEPTH})), array(_own), (ls, k) -> if(k = 0, ls, concat(ls, transform(array(element_at(ls, -1)), x -> {_PARENTS}))))"
        tiers.append(stored(blocks.withColumn("levels", F.expr(levels)).drop("_own")))
        if most <= 1 << BITS:
            return tiers
        top = F.expr("decode(element_at(levels, -1), 'UTF-8')")
        nodes = tiers[-1].select("g", F.col("block").alias("pos"), F.expr(f"(n + {(1 << BITS) - 1}) div {1 << BITS}").alias("n"), top.alias("node"))
        most, carried = -(-most >> BITS), ()


def descend(tiers: list[DataFrame], heads: DataFrame) -> DataFrame:
    """For every leaf of the trees: g, its member m, path, and what heads (g, path above the tree, more) tells of g.

    path: of each level, from the leaf up, the sibling's digest ('' if none) and whether the sibling is on the left.
    """
    more = [c for c in heads.columns if c not in ("g", "path")]
    above = heads.withColumn("block", F.lit(0).cast("long"))
    for k, blocks in enumerate(reversed(tiers)):
        steps = "sequence(0, size(levels) - 1)"
        sibling = "decode(substring(levels[l], cast(((shiftright(m.i, l) ^ 1) * 64 + 1) as int), 64), 'UTF-8')"
        own = f"transform(filter({steps}, l -> l < size(levels) - 1), l -> struct({sibling} as sibling, shiftright(m.i, l) & 1 = 1 as on_left))"
        rows = blocks.join(above, ["g", "block"]).select("g", "block", "levels", F.col("path").alias("_above"), *more, F.explode("members").alias("m"))
        rows = rows.select("g", "block", "m", *more, F.concat(F.expr(own), "_above").alias("path"))
        if k == len(tiers) - 1:
            return rows.drop("block")
        above = rows.select("g", (F.shiftleft("block", BITS) + F.col("m.i")).alias("block"), "path", *more)
    return above


def manifest(docs: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The tiers over all leaves, and of each language (g: '' for null, else ':' and the language) its subroot, the root and the path between them."""
    text_leaf, n = leaf(F.col("n_chars")), F.col("n_chars")
    hit = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & n.isNotNull()
    rows = docs.select(
        F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit(":"), "lang")).alias("g"), F.col("doc_id"),
        text_leaf.alias("node"), F.when(hit, leaf(n.cast("long") + 1)).alias("tampered"),
    )
    tiers = climb(numbered(stored(rows), "doc_id", "node"), "doc_id", "tampered")
    subroots = tiers[-1].select(F.lit("").alias("g"), F.col("g").alias("lang_key"), F.expr("decode(element_at(levels, -1), 'UTF-8')").alias("node"))
    upper = climb(numbered(stored(subroots), "lang_key"), "lang_key")
    top = upper[-1].select("g", F.expr("decode(element_at(levels, -1), 'UTF-8')").alias("root"), F.expr("cast(array() as array<struct<sibling: string, on_left: boolean>>)").alias("path"))
    heads = descend(upper, top).select(F.col("m.lang_key").alias("g"), F.col("m.node").alias("subroot"), "root", "path")
    return tiers, stored(heads)


def proofs(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, tampered (the digest after tampering, or null), subroot, root and path of every row."""
    tiers, heads = manifest(docs)
    return descend(tiers, heads).select("m.doc_id", F.col("m.node").alias("leaf"), "m.tampered", "subroot", "root", "path")


def folded(start: Column, path: Column) -> Column:
    """The root that a digest leads to along a path."""
    step = lambda h, x: F.sha2(F.when(x["on_left"], F.concat(x["sibling"], h)).otherwise(F.concat(h, x["sibling"])), 256)
    return F.aggregate(path, start, step)


def op11(spark: SparkSession, docs: DataFrame) -> DataFrame:
    found = proofs(docs)
    proof = F.sha2(F.array_join(F.transform("path", lambda x: x["sibling"]), ""), 256)
    found = found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


#: crc32 bit by bit: a byte is taken in by xor, and each -1 is one shift by the reversed polynomial.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, n_chars,
    concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-')) AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail,
    list_reduce(flatten(list_transform(range(1, strlen(CAST(doc_id AS VARCHAR)) + 1), lambda i: [CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
      lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, 4294967295) AS crc
  FROM documents),
f AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN xor(crc, 4294967295) % 7 = 0 AND n_chars IS NOT NULL THEN sha256(head || strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1) || tail) END AS tampered
  FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM f),
t AS (
  SELECT coalesce(':' || lang, '') AS g, 0 AS lvl, pos, leaf AS h, n FROM p
  UNION ALL SELECT g, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 1) // 2 FROM t WHERE n > 1 GROUP BY g, lvl, pos // 2),
s AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (
  SELECT 0 AS lvl, pos, subroot AS h, n FROM s
  UNION ALL SELECT lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 1) // 2 FROM u WHERE n > 1 GROUP BY lvl, pos // 2),
k AS (
  SELECT p.doc_id, p.leaf, p.tampered, p.pos, p.n, coalesce(':' || p.lang, '') AS g, s.subroot, s.pos AS g_pos, (SELECT h FROM u WHERE n = 1) AS root
  FROM p JOIN s ON s.g = coalesce(':' || p.lang, '')),
q AS (
  SELECT k.g, k.pos, t.lvl, any_value((k.pos >> t.lvl) & 1) AS bit, string_agg(CASE WHEN t.pos = xor(k.pos >> t.lvl, 1) THEN t.h END, '') AS sib
  FROM k JOIN t ON t.g = k.g AND t.n > 1 AND t.pos >> 1 = k.pos >> (t.lvl + 1) GROUP BY k.g, k.pos, t.lvl
  UNION ALL
  SELECT k.g, k.pos, 100 + u.lvl, any_value((k.g_pos >> u.lvl) & 1), string_agg(CASE WHEN u.pos = xor(k.g_pos >> u.lvl, 1) THEN u.h END, '')
  FROM k JOIN u ON u.n > 1 AND u.pos >> 1 = k.g_pos >> (u.lvl + 1) GROUP BY k.g, k.pos, u.lvl),
r AS (SELECT g, pos, string_agg(coalesce(sib, ''), '' ORDER BY lvl) AS proof, list({'b': bit, 's': coalesce(sib, '')} ORDER BY lvl) AS path FROM q GROUP BY g, pos),
v AS (SELECT k.*, coalesce(r.proof, '') AS proof, coalesce(r.path, []) AS path FROM k LEFT JOIN r ON r.g = k.g AND r.pos = k.pos),
z AS (
  SELECT g, pos, 1 AS i, coalesce(tampered, leaf) AS h, path FROM v
  UNION ALL SELECT g, pos, i + 1, sha256(CASE WHEN path[i].b = 1 THEN path[i].s || h ELSE h || path[i].s END), path FROM z WHERE i <= len(path))
SELECT v.doc_id, v.leaf, v.subroot, v.root, sha256(v.proof) AS proof_sha256, z.h AS folded_root, z.h = v.root AS verified
FROM v JOIN z ON z.g = v.g AND z.pos = v.pos AND z.i = len(v.path) + 1
"""
