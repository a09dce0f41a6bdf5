"""SimHash fingerprints and near-duplicate components found with BK-trees."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, components, durable, pieces, text_hash

#: op5's contract: words in a shingle, hash seed, differing bits that still link, and blocks that the 64 bits are cut into.
SHINGLE, SEED, RADIUS, BLOCKS = 3, 42, 2, 4
#: The same for wide links.
NEAR_RADIUS, NEAR_BLOCKS = 10, 12
#: Most fingerprints in one tree, and most asked of it in one task.
TREE = 2048


def shingle_hashes(data: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """One hash a shingle, in order; a text of fewer words is one shingle, one without words has none."""
    import xxhash

    words = data.lower().split()  # bytes.lower() changes A-Z only
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        h = [digest(b" ".join(words), SEED)] if words else []
    else:
        h = [digest(b" ".join(t), SEED) for t in zip(*(words[i:] for i in range(shingle)), strict=False)]
    return np.array(h, "<u8")


def majority(packed: np.ndarray) -> int:
    """64 bits: a bit is set if it is set in over half of the hashes. No hashes: zero."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(packed), 1 << 16):
        ones += np.unpackbits(packed[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(packed), bitorder="little").view("<i8")[0])


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    return majority(shingle_hashes(data, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, t, fp`` for every row of ``docs(doc_id, text)``, with the hash ``t`` of the text; null text counts as empty."""

    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                prints = pa.array([fingerprint(d, shingle) for d in as_bytes(part.column("text"))], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("t"), prints], ["doc_id", "t", "fp"])

    return docs.select("doc_id", "text", text_hash().alias("t")).mapInArrow(computed, "doc_id long, t long, fp long")


class BKTree:
    """Fingerprints, each a child of its parent by their Hamming distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        new, at = len(self.values), 0
        self.values.append(value)
        self.children.append({})
        if new:
            while True:
                d = (value ^ self.values[at]).bit_count()
                if (below := self.children[at].get(d)) is None:
                    self.children[at][d] = new
                    return
                at = below

    def within(self, value: int, radius: int) -> list[int]:
        """Indices of the stored values at most ``radius`` bits away; only edges that can lead there are followed."""
        found, todo = [], [0] if self.values else []
        values, children = self.values, self.children
        while todo:
            at = todo.pop()
            d = (value ^ values[at]).bit_count()
            if d <= radius:
                found.append(at)
            below = children[at]
            if len(below) <= 2 * radius + 1:
                todo += [c for k, c in below.items() if d - radius <= k <= d + radius]
            else:
                todo += [below[k] for k in range(d - radius, d + radius + 1) if k in below]
        return found


def _search(rows: Iterator[tuple]) -> Iterator[tuple[int, int]]:
    """Links of one unit, whose stored fingerprints come first: one per asked fingerprint, and a forest over the stored ones."""
    tree = BKTree()
    parent: list[int] = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for asked, value in rows:
        if not asked:
            tree.add(value)
            parent.append(len(parent))
        elif near := tree.within(value, RADIUS):
            first = root(near[0])
            for other in near[1:]:
                if (r := root(other)) != first:
                    parent[r] = first
            if tree.values[near[0]] != value or len(near) > 1:
                yield value, next(tree.values[i] for i in near if tree.values[i] != value)
    for i, up in enumerate(parent):
        if up != i:
            yield tree.values[i], tree.values[up]


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for b in batches:
            fp = np.asarray(b.column("fp")).view(np.uint64).tolist()
            yield from zip(*(b.column(c).to_pylist() for c in ("bucket", "shard", "part", "asked")), fp, strict=True)

    def arrow(links: list[tuple[int, int]]) -> pa.RecordBatch:
        both = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["a", "b"])

    links: list[tuple[int, int]] = []
    for _, unit in groupby(rows(), key=lambda r: r[:3]):
        links.extend(_search((r[3], r[4]) for r in unit))
        if len(links) >= 50_000:
            yield arrow(links)
            links = []
    yield arrow(links)


def links(prints: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints at most two bits apart: enough of them to connect every such pair.

    Of four 16-bit quarters of two such fingerprints, two are equal, so the six pairs of quarters are bucket keys that lose
    nothing. A bucket's fingerprints form BK-trees of about ``TREE`` values, and every tree is asked for every value of its
    bucket, ``TREE`` at a time; a large bucket is so many tasks' work. A tree travels with its bucket through the shuffle: all
    trees together grow with the corpus and cannot be broadcast.
    """
    quarter = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(0xFFFF) for i in range(4)]
    keys = [F.lit(k << 32) + F.shiftleft(quarter[i], 16) + quarter[j]
            for k, (i, j) in enumerate((i, j) for i in range(4) for j in range(i + 1, 4))]
    keyed = prints.select("fp", F.explode(F.array(*keys)).alias("bucket"))
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").selectExpr("bucket", f"cast(ceil(n / {TREE}) AS int) AS shards")
    placed = keyed.join(sizes, "bucket").select(
        "bucket", "fp", F.sequence(F.lit(0), F.col("shards") - 1).alias("all"),
        F.pmod(F.xxhash64("fp"), "shards").cast("int").alias("own"))
    stored = placed.select("bucket", F.col("own").alias("shard"), F.explode("all").alias("part"), F.lit(False).alias("asked"), "fp")
    asked = placed.select("bucket", F.explode("all").alias("shard"), F.col("own").alias("part"), F.lit(True).alias("asked"), "fp")
    units = stored.union(asked).repartition("bucket", "shard", "part").sortWithinPartitions("bucket", "shard", "part", "asked", "fp")
    return units.mapInArrow(_units, "a long, b long")


def _pairs(own: np.ndarray, other: np.ndarray | None, radius: int) -> np.ndarray:
    """Rows ``a, b`` that connect all fingerprints of ``own`` (and ``other``) at most ``radius`` bits apart that meet here."""
    near = np.bitwise_count(own[:, None] ^ (own if other is None else other)[None, :]) <= radius
    if other is None:
        np.fill_diagonal(near, False)
        other = own
    i, j = np.nonzero(near)
    if len(i) > len(own) + len(other):  # a large group: every value with the least one that it reaches, instead of all pairs
        left, right = np.full(len(own), len(own) + len(other)), np.arange(len(other))
        while True:
            np.minimum.at(left, i, right[j])
            before = right.copy()
            np.minimum.at(right, j, left[i])
            if (before == right).all():
                break
        met = np.unique(i)
        return np.concatenate([np.stack([own[met], other[left[met]]], 1), np.stack([other, other[right]], 1)[right != np.arange(len(other))]])
    return np.stack([own[i], other[j]], 1)


def wide_links(prints: DataFrame, radius: int = NEAR_RADIUS, blocks: int = NEAR_BLOCKS) -> DataFrame:
    """Links ``(a, b)`` that connect every two distinct fingerprints at most ``radius`` bits apart.

    Of ``blocks`` blocks at least ``blocks - radius`` are equal in two such fingerprints, so the choices of so many are bucket
    keys that lose nothing. At a wide radius a BK-tree's edges rule out next to nothing (two fingerprints differ in 32 bits, give
    or take 4), so a bucket's fingerprints are compared as arrays, ``TREE`` by ``TREE``: a large bucket is many tasks' work. The
    buckets that are cut are at most as many as there are keys, however large the corpus, and are broadcast.
    """
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [F.shiftrightunsigned("fp", lo).bitwiseAND((1 << hi - lo) - 1) for lo, hi in zip(edges, edges[1:], strict=False)]
    width = max(hi - lo for lo, hi in zip(edges, edges[1:], strict=False))
    keys = []
    for k, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        key = F.lit(k).cast("long")
        for c in chosen:
            key = F.shiftleft(key, width) + block[c]
        keys.append(key)
    keyed = prints.select("fp", F.explode(F.array(*keys)).alias("bucket"))
    large = keyed.groupBy("bucket").agg(F.count("*").alias("n")).where(f"n > {TREE}").selectExpr("bucket", f"cast(ceil(n / {TREE}) AS int) AS shards")
    placed = keyed.join(F.broadcast(large), "bucket", "left").withColumn("own", F.coalesce(F.pmod(F.xxhash64("fp"), "shards").cast("int"), F.lit(0)))
    # unit (i, j) compares shard i with shard j, and (i, i) a shard with itself
    each = placed.select("bucket", "fp", "own", F.explode(F.sequence(F.lit(0), F.coalesce("shards", F.lit(1)) - 1)).alias("with"))
    units = each.select("bucket", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), (F.col("own") > F.col("with")).alias("right"), "fp")
    found = units.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "right")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def arrow(rows: np.ndarray) -> pa.RecordBatch:
            both = np.unique(rows, axis=0).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["a", "b"])

        def solved(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            """``rows`` are whole units: bucket, i, j, right, fp."""
            if not len(rows):
                return
            out, starts = [], np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(1)) + 1
            for lo, hi in zip([0, *starts], [*starts, len(rows)], strict=True):
                unit = rows[lo:hi]
                fp, split = unit[:, 4].copy().view(np.uint64), int(np.searchsorted(unit[:, 3], 1))
                if unit[0, 1] == unit[0, 2]:
                    pairs = _pairs(fp, None, radius) if len(fp) > 1 else []
                else:
                    pairs = _pairs(fp[:split], fp[split:], radius)
                if len(pairs):
                    out.append(pairs)
            if out:
                yield arrow(np.concatenate(out))

        for b in batches:
            rows = np.stack([np.asarray(b.column(c).cast(pa.int64())) for c in ("bucket", "i", "j", "right", "fp")], 1)
            held.append(rows)
            last = rows[-1, :3] if len(rows) else None
            if last is not None and (held[0][0, :3] != last).any():
                all_rows = np.concatenate(held)
                cut = int(np.flatnonzero((all_rows[:, :3] != last).any(1))[-1]) + 1
                yield from solved(all_rows[:cut])
                held = [all_rows[cut:]]
        if held:
            yield from solved(np.concatenate(held))

    return found.mapInArrow(searched, "a long, b long")


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of all rows, and ``fp, root``: the component of each distinct one."""
    prints = durable(fingerprints(docs))
    values = durable(prints.select("fp").distinct())
    found = durable(components(links(values)))
    return prints, values.join(found, values.fp == found.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs(doc_id, text)``.

    Equal fingerprints collapse first, so a group of copies of any size is one value. Links come from :func:`links`, components
    from star rounds; ``component_id`` is the smallest document id that links reach.

    A null text is empty; texts without words have fingerprint zero and link like any other. Null ids are kept and never name a
    component unless it has no other. Repeated rows are each answered. An empty table gives no rows. Other columns are not
    looked at.
    """
    prints, roots = _grouped(docs)
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("first")).join(roots, "fp").groupBy("root").agg(F.min("first").alias("component_id"))
    named = roots.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` less all but one of each group of near copies; see :func:`ledgerlark.llm.nearsets.one_of_each`."""
    from .nearsets import one_of_each as exact  # which builds on this module

    return exact(docs, **options)
