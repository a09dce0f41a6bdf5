"""Near copies by exact set similarity: fingerprints join the bulk, a prefix join finds every other pair."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_bytes, components, document_key, pieces, shuffles_let_go, stored, text_hash, unused
from .simhash import SEED, links, majority, shingle_hashes

#: Words in a shingle, and the Jaccard similarity that two documents need.
SHINGLE, SIMILARITY = 5, 0.8
#: A shingle that more sets' prefixes hold than this comes last in the order, those of fewer sets first.
HEAVY = 64
#: Rounds in which every set is compared with one other per shingle, before all pairs still apart are.
ROUNDS = 2
#: Sets compared with one centre, and sets of a bucket joined with others of it, in one row group.
SLICE = 64
#: Words of 64 bits in a set's sketch of parities.
SKETCH = 16
#: Rows that a broadcast side may have; a larger one is shuffled.
BROADCAST_ROWS = 1_000_000


def needed(n: int, similarity: float) -> int:
    """The least number of shingles that a set of ``n`` shares with any set as similar as that."""
    return math.ceil(similarity * n - 1e-9)


def prefix_length(n: int, similarity: float) -> int:
    return n - needed(n, similarity) + 1


def shingle_sets(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``d, t, fp, w, n, prefix, sk`` for every row: fingerprint, a hash ``w`` of the set of shingles, its size, its least shingle hashes, a sketch.

    A bit of the sketch is the parity of how many shingles fall on it. Two sketches differ in no more bits than their sets in
    shingles, so a pair that is further apart than similar sets can be is known without its texts. The prefix holds one shingle more than the set may miss; two sets as similar as ``similarity`` share one of each other's.
    """
    import xxhash

    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                rows = []
                for data in as_bytes(part.column("text")):
                    h = shingle_hashes(data, shingle)
                    each = np.unique(h)
                    rows.append((majority(h), xxhash.xxh64_intdigest(each.tobytes(), SEED) - (1 << 63), len(each), each[:prefix_length(len(each), similarity)].view("<i8"),
                                 np.packbits(np.bincount((each & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH).astype(np.uint8) & 1).view("<i8")))
                fp, w, n, prefix, sketch = zip(*rows, strict=True) if rows else ((), (), (), (), ())
                ends = pa.array(np.cumsum([0, *map(len, prefix)]), pa.int32())
                flat = pa.array(np.concatenate([*prefix, np.empty(0, np.int64)]).astype(np.int64))
                columns = [pa.array(c, pa.int64()) for c in (fp, w, n)]
                bits = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * SKETCH, pa.int32()), pa.array(np.concatenate([*sketch, np.empty(0, np.int64)]).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("d"), part.column("t"), *columns, pa.ListArray.from_arrays(ends, flat), bits], ["d", "t", "fp", "w", "n", "prefix", "sk"])

    named = docs.select(document_key().alias("d"), "text", text_hash().alias("t"))
    return named.mapInArrow(computed, "d long, t long, fp long, w long, n long, prefix array<long>, sk array<long>")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``w, text`` for ``wanted(w, d, t)``, which is broadcast if it was counted and is small."""
    ids = wanted.select("w", F.col("d").alias("_d"), F.col("t").alias("_t"))
    ids = F.broadcast(ids) if wanted.count() <= BROADCAST_ROWS else ids
    named = docs.select(document_key().alias("d"), text_hash().alias("t"), "text")
    return named.join(ids, (F.col("d") == F.col("_d")) & (F.col("t") == F.col("_t"))).select("w", "text").dropDuplicates(["w"])


def _whole_order(docs: DataFrame, wanted: DataFrame, heavy: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``s, w, n`` of the prefixes of ``wanted(w, d, t)`` in the order in which shingles of ``heavy(s, c)`` come last, by ``c``."""
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1 << 20):
                sets = [np.unique(shingle_hashes(t, shingle)).view("<i8") for t in as_bytes(part.column("text"))]
                sizes = np.array([len(s) for s in sets], np.int64)
                w = np.repeat(np.asarray(part.column("w")), sizes)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*sets, np.empty(0, np.int64)]).astype(np.int64)), pa.array(w), pa.array(np.repeat(sizes, sizes))], ["s", "w", "n"])

    each = _texts(docs, wanted).mapInArrow(listed, "s long, w long, n long")
    placed = each.join(heavy, "s", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    # the hashes are unsigned
    rank = F.row_number().over(W.partitionBy("w").orderBy("c", F.col("s") < 0, "s"))
    return placed.withColumn("_r", rank).where(F.col("_r") <= F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1).select("s", "w", "n")


def prefix_entries(docs: DataFrame, sets: DataFrame, shingle: int, similarity: float, heavy_from: int) -> DataFrame:
    """``s, w, n`` for every shingle ``s`` of a set's prefix that another set's prefix has too.

    Any order of all shingles loses no pair, if every set takes its prefix by it. Shingles go by their hash, so most prefixes
    are known where a text is read; only those that the first count finds in over ``heavy_from`` prefixes come last, the more
    frequent the later, and only sets with such a one take their prefix anew.
    """
    first = sets.select(F.explode("prefix").alias("s"), "w", "n")
    counts = first.groupBy("s").agg(F.count("*").alias("_k")).where(F.col("_k") > heavy_from)
    heavy = stored(counts.select("s", F.floor(F.log2("_k")).cast("int").alias("c")))
    few = F.broadcast(heavy) if heavy.count() <= BROADCAST_ROWS else heavy
    anew = stored(first.join(few, "s", "left_semi").select("w").distinct())
    small = F.broadcast(anew) if anew.count() <= BROADCAST_ROWS else anew
    wanted = sets.join(small, "w", "left_semi").select("w", "d", "t")
    others = sets.join(small, "w", "left_anti").select(F.explode("prefix").alias("s"), "w", "n")
    both = others.union(_whole_order(docs, wanted, few, shingle, similarity))
    return stored(both.withColumn("k", F.count("*").over(W.partitionBy("s"))).where("k > 1"))


def _compared(pairs: DataFrame, docs: DataFrame, sets: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of ``pairs(a, b)`` whose sets are similar.

    The set of a pair that has more pairs is the centre: its text travels once for every ``SLICE`` partners, the other's once a pair.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("_e")).groupBy("_e").agg(F.count("*").alias("_n"))
    known = pairs.join(ends.toDF("a", "_na"), "a").join(ends.toDF("b", "_nb"), "b")
    turned = known.select(F.when(F.col("_na") >= F.col("_nb"), F.col("a")).otherwise(F.col("b")).alias("a"), F.when(F.col("_na") >= F.col("_nb"), F.col("b")).otherwise(F.col("a")).alias("b"),
                          F.greatest("_na", "_nb").alias("_n"))
    sliced = turned.select("a", F.pmod(F.xxhash64("b"), F.ceil(F.col("_n") / SLICE)).alias("part"), "b")
    roles = sliced.select("a", "part", F.col("b").alias("w"), F.lit(True).alias("asked")).union(
        sliced.select("a", "part", F.col("a").alias("w"), F.lit(False).alias("asked")).distinct())
    roles = stored(roles)
    wanted = roles.select("w").distinct().join(sets.select("w", "d", "t"), "w")
    met = roles.join(_texts(docs, stored(wanted)), "w").repartition("a", "part").sortWithinPartitions("a", "part", "asked")

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, key = np.empty(0, np.uint64), None
        for batch in batches:
            found = []
            a, part, w, asked = (batch.column(c).to_pylist() for c in ("a", "part", "w", "asked"))
            for i, text in enumerate(as_bytes(batch.column("text"))):
                own = np.unique(shingle_hashes(text, shingle))
                if not asked[i]:
                    centre, key = own, (a[i], part[i])
                elif key == (a[i], part[i]):
                    both = len(np.intersect1d(centre, own, assume_unique=True))
                    if both >= similarity * (len(centre) + len(own) - both) - 1e-9:
                        found.append((a[i], w[i]))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return stored(met.select("a", "part", "w", "asked", "text").mapInArrow(checked, "a long, b long"))


def _by_fingerprint(sets: DataFrame) -> DataFrame:
    """Candidate pairs ``a, b``: sets of one fingerprint with the first of it, and the first ones of fingerprints linked in BK-trees."""
    first = stored(sets.groupBy("fp").agg(F.min("w").alias("a")))
    same = sets.join(first, "fp").where("w <> a").select("a", F.col("w").alias("b"))
    linked = links(first.select("fp")).toDF("x", "y").distinct()
    named = linked.join(first.toDF("x", "a"), "x").join(first.toDF("y", "b"), "y")
    return same.union(named.select("a", "b"))


def _grouped(entries: DataFrame, found: DataFrame, sets: DataFrame) -> DataFrame:
    """``s, w, n, k, root, sk`` of the shingles that still have sets of several groups."""
    placed = entries.join(found, entries.w == found.node, "left").select("s", "w", "n", "k", F.coalesce("root", "w").alias("root"))
    bucket = W.partitionBy("s")
    ends = placed.withColumns({"_x": F.min("root").over(bucket), "_y": F.max("root").over(bucket)})
    return stored(ends.where("_x < _y").drop("_x", "_y").join(sets.select("w", "sk"), "w"))


def _may_be_similar(similarity: float):
    """Whether sets of ``n`` and ``m`` shingles with sketches ``sk`` and ``_sk`` may be: by size, and by how many shingles they differ in at least."""
    apart = F.expr(" + ".join(f"bit_count(sk[{i}] ^ _sk[{i}])" for i in range(SKETCH)))
    return (F.least("n", "m") >= F.greatest("n", "m") * similarity - 1e-9) & (apart <= (F.col("n") + F.col("m")) * (1 - similarity) / (1 + similarity) + 1e-9)


def _starred(placed: DataFrame, turn: int, similarity: float) -> DataFrame:
    """Pairs of each set with the one first set of a shingle that it shares most of: the order of sets is the same in all buckets."""
    order = F.xxhash64("w", F.lit(turn))
    first = F.struct(order.alias("o"), F.col("w").alias("a"), F.col("n").alias("m"), F.col("root").alias("_r"), F.col("sk").alias("_sk"))
    centre = placed.groupBy("s").agg(F.min(first).alias("c")).select("s", "c.*")
    pairs = placed.join(centre, "s").where((F.col("root") != F.col("_r")) & _may_be_similar(similarity))
    shared = pairs.groupBy("a", F.col("w").alias("b")).agg(F.count("*").alias("k"))
    return shared.groupBy("b").agg(F.max(F.struct("k", "a")).alias("c")).select("c.a", "b")


def _all_apart(placed: DataFrame, similarity: float) -> DataFrame:
    """All pairs of sets in different groups that share a shingle of their prefixes and, by sketch and by how many they share, may be similar.

    A bucket of many sets is cut: each set has a part of its own on one side and meets every part on the other.
    """
    parts = F.ceil(F.col("k") / (4 * SLICE))
    left = placed.select("s", F.pmod(F.xxhash64("w"), parts).alias("part"), F.col("w").alias("a"), F.col("n").alias("m"), F.col("root").alias("_r"), F.col("sk").alias("_sk"))
    right = placed.select("s", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), F.col("w").alias("b"), "n", "root", "sk")
    met = left.join(right, ["s", "part"]).where((F.col("a") < F.col("b")) & (F.col("_r") != F.col("root")) & _may_be_similar(similarity))
    shared = met.groupBy("a", "b").agg(F.count("*").alias("k"), F.any_value("n").alias("n"), F.any_value("m").alias("m"))
    total = F.ceil((F.col("n") + F.col("m")) * similarity / (1 + similarity) - 1e-9)
    rest = F.ceil(F.greatest("n", "m") * similarity - 1e-9) - 1  # shingles behind the prefix
    return shared.where(F.col("k") + rest >= total).select("a", "b")


def similar_sets(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, heavy_from: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``d, t, w`` for all rows of ``docs(doc_id, text)``, and ``node, root`` for the shingle sets that are like another.

    Equal sets are one. Sets whose SimHash fingerprints BK-trees link at two bits are compared first. Then every set is compared
    with one per shingle of its prefix, twice, and the sets found alike make groups; last, every two sets of different groups
    that share a shingle of their prefixes and may be similar are compared. Nothing is left out: two sets as similar as
    ``similarity`` share such a shingle, and end in one group. A large group of near copies is joined by its stars, so that its
    pairs are never listed, and the shingles of a passage that many documents share come last in the order and hardly ever
    stand in a prefix.
    """
    with shuffles_let_go(docs.sparkSession):
        prints = shingle_sets(docs, shingle, similarity)
        least = int(1 / (1 - similarity) + 1e-9) - 1  # smaller sets are like none but themselves
        first = F.min(F.struct("d", "t", "n", "fp", "prefix", "sk")).alias("first")
        sets = stored(prints.where(F.col("n") >= least).groupBy("w").agg(first).select("w", "first.*"))
        # prefixes and sketches are on disk once: the rows' own table does without and takes another pass over the texts
        named = stored(prints.select("d", "t", "w"))
        entries = prefix_entries(docs, sets, shingle, similarity, HEAVY if heavy_from is None else heavy_from)
        known = _compared(stored(_by_fingerprint(sets)), docs, sets, shingle, similarity)
        found = stored(components(known, stored))
        for turn in range(ROUNDS + 1):
            placed = _grouped(entries, found, sets)
            pairs = stored(_starred(placed, turn, similarity) if turn < ROUNDS else _all_apart(placed, similarity))
            known = known.union(_compared(pairs, docs, sets, shingle, similarity))
            found = stored(components(known, stored))
    return named, found


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, all columns, less all but one of each group of near copies: that of the smallest id, null last.

    Two documents are near copies if the sets of their ``shingle``-word shingles have a Jaccard similarity of ``similarity`` or
    more; groups are what such pairs connect. A-Z are lower-cased; a text of fewer words is one shingle. Texts without words,
    null ones among them, are one group. Of rows that share the id, the one with the smallest text hash stays, and of rows equal
    in both any one. An empty table gives no rows.
    """
    prints, roots = similar_sets(docs, shingle, similarity)
    own = unused(docs, "_d", "_t")
    first = prints.groupBy("w").agg(F.min(F.struct("d", "t")).alias("first"))
    joined = first.join(roots, first.w == roots.node, "left").select("first", F.coalesce("root", "w").alias("root"))
    kept = joined.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.d").alias(own[0]), F.col("first.t").alias(own[1]))
    keyed = docs.withColumns(dict(zip(own, (document_key(), text_hash()), strict=True)))
    return keyed.join(kept, own, "left_semi").dropDuplicates(own).drop(*own)
