"""Merkle manifest of a table of documents: nested-struct rollup by rank digits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ranked, stored

#: Nodes that become one, and levels of the tree that a block spans: 243 leaves.
FANOUT, LEVELS = 3, 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def framed(*values: Column) -> Column:
    """Each value as its UTF-8 byte count, ``:`` and itself, ``-`` for null, one behind the other."""
    texts = [v.cast("string") for v in values]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def leaf_hash(*values: Column) -> Column:
    return F.sha2(framed(*values), 256)


def tampered_text(doc_id: Column, text: Column) -> Column:
    """``text`` without its line ends where 2 divides the CRC-32 of the decimal id; a null id changes nothing."""
    even = F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def _above(nodes: DataFrame) -> DataFrame:
    """Blocks of ``nodes(g, r, n, h, x)`` with the nested struct of each: ``g, block, n, top``.

    The digits of rank ``r`` inside a block are grouped away one after the other, lowest first, each time nesting the children
    below their parent's hash. A group ``g`` of ``n`` nodes stops where one is left: from there on a node is its only child.
    One shuffle by group and block serves all the groupings.
    """
    size = FANOUT ** LEVELS
    digits = [F.expr(f"cast(r div {FANOUT ** k} % {FANOUT} as int)").alias(f"d{k}") for k in range(LEVELS)]
    now = nodes.select("g", F.expr(f"r div {size}").alias("block"), "n", *digits, F.struct("h", "x").alias("node")).repartition("g", "block")
    for k in range(LEVELS):
        keep = ["g", "block", "n", *[f"d{j}" for j in range(k + 1, LEVELS)]]
        kids = F.sort_array(F.collect_list(F.struct(F.col(f"d{k}").alias("d"), "node")))
        below = now.groupBy(*keep).agg(kids.alias("kids"))
        joined = F.sha2(F.array_join(F.transform("kids", lambda c: c["node"]["h"]), ""), 256)
        h = F.when(F.col("n") > FANOUT ** k, joined).otherwise(F.col("kids")[0]["node"]["h"])
        now = below.select(*keep, F.struct(h.alias("h"), F.transform("kids", lambda c: c["node"]).alias("kids")).alias("node"))
    return now.select("g", "block", "n", F.col("node").alias("top"))


STEP = "array<struct<left: string, right: string, hashed: boolean>>"


def _child(k: int):
    """Of the level that hashes nodes of ``3 ** k`` leaves: a child and its place become the child with its path."""

    def child(c: Column, i: Column) -> Column:
        before = F.array_join(F.transform(F.slice(F.col("node.kids"), F.lit(1), i), lambda s: s["h"]), "")
        after = F.array_join(F.transform(F.slice(F.col("node.kids"), i + 2, F.lit(FANOUT)), lambda s: s["h"]), "")
        step = F.struct(before.alias("left"), after.alias("right"), (F.col("n") > FANOUT ** k).alias("hashed"))
        return F.struct(c.alias("node"), F.concat(F.array(step), F.col("path")).alias("path"))

    return child


def _paths(blocks: DataFrame) -> DataFrame:
    """``g, h, x, path, root`` of every node inside ``blocks(g, n, top, path, root)``: its siblings level by level, before those of the block.

    A transform turns a node into its children, each with its siblings, and an explode sets them out; no join is needed.
    """
    now = blocks.select("g", "n", F.col("top").alias("node"), "path", "root")
    for k in reversed(range(LEVELS)):
        now = now.select("g", "n", "root", F.explode(F.transform("node.kids", _child(k))).alias("e")).select("g", "n", "e.node", "e.path", "root")
    return now.select("g", F.col("node.h").alias("h"), F.col("node.x").alias("x"), "path", "root")


def tree(nodes: DataFrame, most: int) -> list[DataFrame]:
    """Tiers of blocks over ``nodes(g, r, n, h, x)``, lowest first, until every group is one block; ``most`` is the largest group.

    The tops of a tier's blocks are the nodes of the next one, a 243rd as many; each tier is stored.
    """
    tiers = []
    while True:
        tiers.append(stored(_above(nodes)))
        if most <= FANOUT ** LEVELS:
            return tiers
        most = -(-most // FANOUT ** LEVELS)
        nodes = tiers[-1].select("g", F.col("block").alias("r"), F.expr(f"cast(ceil(n / {FANOUT ** LEVELS}) as long)").alias("n"), F.col("top.h").alias("h"), F.col("block").alias("x"))


def proofs(tiers: list[DataFrame], roots: DataFrame) -> DataFrame:
    """``g, h, x, path, root`` of every lowest node; ``roots(g, path, root)`` names each group's root and how it goes on above.

    Paths are set out from the top tier down. Inside a block no join takes part; a block meets the path above it by one join of
    one row a block and tier.
    """
    above = tiers[-1].join(roots, "g").select("g", "n", "top", "path", "root")
    for tier in reversed(tiers[:-1]):
        known = _paths(above).select("g", F.col("x").alias("block"), "path", "root")
        above = tier.join(known, ["g", "block"]).select("g", "n", "top", "path", "root")
    return _paths(above)


def _placed(leaves: DataFrame) -> DataFrame:
    """``leaves(g, doc_id, h, ...)`` with ``r``, the rank in the group by id, null first, then hash, and ``n``, the group's size.

    Rows are sorted into ranges over group and id together, so a large group is many ranges; a range counts on from the sizes of
    the group's earlier ones.
    """
    parts = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.asc_nulls_first("doc_id"), F.asc("h")]
    ranges = stored(leaves.repartitionByRange(parts, F.asc("g"), *order).withColumn("_range", F.spark_partition_id()))
    sizes = ranges.groupBy("g", "_range").agg(F.count("*").alias("_c"))
    whole = W.partitionBy("g")
    starts = sizes.select("g", "_range", F.sum("_c").over(whole).alias("n"),
                          (F.sum("_c").over(whole.orderBy("_range").rowsBetween(W.unboundedPreceding, 0)) - F.col("_c")).alias("_b"))
    inside = F.row_number().over(W.partitionBy("g", "_range").orderBy(*order)) - 1
    return ranges.withColumn("_i", inside).join(starts, ["g", "_range"]).withColumn("r", F.col("_b") + F.col("_i")).drop("_i", "_b", "_range")


def group_key(source: Column) -> Column:
    """A string that is never null and sorts like ``source``, null first."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def manifest(docs: DataFrame) -> DataFrame:
    """``doc_id, g, leaf, changed, subroot, root, path`` of every row of ``docs`` with the columns of documents.

    ``leaf`` hashes the row's fields, ``changed`` those of the row with :func:`tampered_text`; ``path`` holds the siblings of every
    level as ``left`` and ``right`` of the own node, and whether the level is hashed at all. ``g`` is :func:`group_key`.

    Nulls count as such in the leaf; null ids come first in their source, and a null source is a source of its own, the first.
    Rows that share an id are ordered by their leaf; repeated rows are leaves like any other. Empty texts are values of no bytes;
    texts are hashed whole where they are read, and only hashes are shuffled. An empty table gives no rows. Other columns are not
    looked at.
    """
    own = [F.col(c) for c in FIELDS]
    changed = [tampered_text(F.col("doc_id"), c) if name == "text" else c for name, c in zip(FIELDS, own, strict=True)]
    leaves = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), group_key(F.col("source")).alias("g"),
                                leaf_hash(*own).alias("h"), leaf_hash(*changed).alias("changed")))
    nodes = stored(_placed(leaves).select("g", "r", "n", "h", F.struct("doc_id", "changed").alias("x")))
    most = nodes.agg(F.max("n")).first()[0] or 0
    tiers = tree(nodes, most)
    subroots = stored(ranked(tiers[-1].select("g", F.col("top.h").alias("h")), "g"))
    groups = subroots.count()
    lifted = subroots.select(F.lit(0).alias("g"), F.col("rank").alias("r"), F.lit(groups).cast("long").alias("n"), "h", F.struct("g").alias("x"))
    upper = tree(lifted, groups)
    top = upper[-1].select(F.col("g"), F.array().cast(STEP).alias("path"), F.col("top.h").alias("root"))
    tops = proofs(upper, top).select(F.col("x.g").alias("g"), "path", F.struct(F.col("h").alias("sub"), "root").alias("root"))
    return proofs(tiers, tops).select(F.col("x.doc_id").alias("doc_id"), "g", F.col("h").alias("leaf"), F.col("x.changed").alias("changed"),
                                      F.col("root.sub").alias("subroot"), "root.root", "path")


def siblings(path: Column) -> Column:
    """All hashes of a path, left to right, level by level."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` and its path give."""
    return F.aggregate(path, leaf, lambda h, s: F.when(s["hashed"], F.sha2(F.concat(s["left"], h, s["right"]), 256)).otherwise(h))


def proof_digest(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of :func:`manifest`: does the changed row still lead to the root?"""
    found = manifest(docs).withColumn("folded_root", folded(F.col("changed"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root",
                        (F.col("folded_root") == F.col("root")).alias("verified"))
