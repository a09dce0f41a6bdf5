"""Stupid-backoff language-model scores: n-gram count tables partitioned by hash, joined to each block's n-grams, summed per document."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, as_bytes, mixed, ngram_hashes, stored, word_hashes

#: Words in the longest n-gram, and the factor for each word of it that is given up.
ORDER, BACKOFF = 3, 0.4
#: Bytes of text in a block of documents, and of text whose n-grams one bucket counts.
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 32 << 20


def planes(values: np.ndarray) -> bytes:
    """64-bit values byte plane by byte plane, compressed: high bytes that are all alike, and counts that are mostly one, take next to nothing."""
    raw = values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(values).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def from_planes(data: bytes) -> np.ndarray:
    raw = pa.Codec("zstd").decompress(data[8:], 8 * int.from_bytes(data[:8], "little"), asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel()


class Counts:
    """Distinct n-grams of a block: ``grams`` holds their hashes in order, ``counts`` how often each occurs."""

    def __init__(self, hashes: list[np.ndarray]) -> None:
        self.grams, index, self.counts = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        self.index = np.split(index, np.cumsum([len(h) for h in hashes])[:-1])

    def parts(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The buckets that hold any of the n-grams, in order, and where each starts: a bucket is an equal range of hashes."""
        bucket = (self.grams >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        return np.unique(bucket, return_index=True)


class Block:
    """The words of a block of texts, and the n-grams that end at each."""

    def __init__(self, texts: list[bytes]) -> None:
        hashes = [mixed(word_hashes(t.split())) for t in texts]
        self.sizes = np.array([len(h) for h in hashes], np.int64)
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)
        self.words = np.concatenate([*hashes, np.empty(0, np.uint64)])
        #: Words of the same text up to and with this one
        self.place = np.arange(len(self.words)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes) + 1

    def ends(self, n: int) -> np.ndarray:
        """Where an n-gram of one text ends."""
        return np.flatnonzero(self.place >= n)

    def hashes(self, n: int, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            g = mixed(ngram_hashes(self.words, n) + np.uint64(n * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        return g[ends - n + 1]

    def elsewhere(self, index: np.ndarray, ends: np.ndarray, totals: np.ndarray) -> np.ndarray:
        """Per word how often the n-gram that ends there stands in other texts: totals less the text's own."""
        pair = self.doc[ends] * np.int64(max(len(totals), 1)) + index
        _, inverse, own = np.unique(pair, return_inverse=True, return_counts=True)
        count = np.zeros(len(self.words), np.int64)
        count[ends] = totals[index] - own[inverse]
        return count

    def likely(self, n: int, below: np.ndarray) -> np.ndarray:
        """Ends of the n-grams that another text may have: those whose two shorter ones, by ``below``, other texts have."""
        ends = self.ends(n)
        return ends[(below[ends] > 0) & (below[ends - 1] > 0)]

    def scores(self, left: list[np.ndarray], words: int) -> tuple[np.ndarray, np.ndarray]:
        """Per text: the sum of log scores, and how many words its longest n-gram was found for, by the counts in other texts."""
        n_words = np.repeat(words - self.sizes, self.sizes)
        longest = np.minimum(self.place, len(left))
        # a word not met elsewhere counts as met once
        score = (longest - 1) * np.log(BACKOFF) + np.log(np.maximum(left[0], 1) / np.maximum(n_words, 1))
        used = np.ones(len(self.doc), np.int64)
        for n in range(2, len(left) + 1):
            at = np.flatnonzero((self.place >= n) & (left[n - 1] > 0))
            score[at] = (longest[at] - n) * np.log(BACKOFF) + np.log(left[n - 1][at] / left[n - 2][at - 1])
            used[at] = n
        found = (used == longest) & (left[0] > 0)
        full = np.flatnonzero(self.sizes)
        starts = (np.cumsum(self.sizes) - self.sizes)[full]
        total, hits = np.zeros(len(self.sizes)), np.zeros(len(self.sizes), np.int64)
        if len(full):
            total[full], hits[full] = np.add.reduceat(score, starts), np.add.reduceat(found.astype(np.int64), starts)
        return total, hits


def _entries(block: int, counts: Counts, buckets: int) -> pa.Table:
    """A block's n-grams and counts, one row a bucket."""
    held, starts = counts.parts(buckets)
    grams, each = (np.split(v, starts[1:]) if len(held) else [] for v in (counts.grams, counts.counts))
    return pa.table({
        "bucket": pa.array(held.astype(np.int32)), "block": pa.array([block] * len(held), pa.int32()),
        "grams": pa.array([planes(np.diff(g, prepend=np.uint64(0))) for g in grams], pa.binary()), "counts": pa.array([planes(c) for c in each], pa.binary())})


def _added(table: pa.Table) -> pa.Table:
    """Per block of a bucket what other blocks count of its n-grams: which of them any other has, and how often. Blocks alone get no row."""
    with np.errstate(over="ignore"):
        grams = [np.cumsum(from_planes(g), dtype=np.uint64) for g in table.column("grams").to_pylist()]
    counts = np.concatenate([from_planes(c) for c in table.column("counts").to_pylist()])
    _, index = np.unique(np.concatenate(grams), return_inverse=True)
    totals = np.zeros(index.max() + 1 if len(index) else 0, np.uint64)
    np.add.at(totals, index, counts)
    parts = np.split(totals[index] - counts, np.cumsum([len(g) for g in grams])[:-1])
    met = [i for i, p in enumerate(parts) if p.any()]
    codec = pa.Codec("zstd", 1)
    masks = [np.packbits(parts[i] > 0).tobytes() for i in met]
    return pa.table({
        "bucket": table.column("bucket").take(pa.array(met, pa.int64())), "block": table.column("block").take(pa.array(met, pa.int64())),
        "mask": pa.array([codec.compress(m, asbytes=True) for m in masks], pa.binary()), "more": pa.array([planes(parts[i][parts[i] > 0]) for i in met], pa.binary())})


def _totals(counts: Counts, told: list[tuple[int, bytes, bytes]], buckets: int) -> np.ndarray:
    """The counts of a block's n-grams in all blocks: its own, and what buckets tell of the others."""
    held, starts = counts.parts(buckets)
    stops = np.append(starts[1:], len(counts.grams))
    out, codec = counts.counts.astype(np.int64), pa.Codec("zstd")
    for bucket, mask, more in told:
        k = int(np.searchsorted(held, bucket))
        n = int(stops[k] - starts[k])
        met = np.unpackbits(np.frombuffer(codec.decompress(mask, -(-n // 8), asbytes=True), np.uint8), count=n).astype(bool)
        out[starts[k]:stops[k]][met] += from_planes(more).astype(np.int64)
    return out


def lm_scores(docs: DataFrame, order: int = ORDER, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``doc_id, n_words, log_score, mean_log, n_found`` for every row of ``docs(doc_id, text)``, scored by all the other documents.

    A word's score is the count of its n-gram over that of the n-gram without it, and ``BACKOFF`` times the next shorter one's
    where the n-gram is not met elsewhere; the counts are those of all documents less the document's own. ``n_found`` counts words
    whose longest n-gram was met.

    Documents meet in hash blocks of about ``block_bytes``. A block's distinct n-grams and their counts go to hash buckets, as
    many as ``bucket_bytes`` asks for, one row for each bucket it has any for; there all blocks' counts of an n-gram add up, and
    what other blocks count returns to each block that has it, where it is joined to the documents' n-grams. Words and pairs are
    counted first. An n-gram can stand in another document only if both n-grams that it has one word more than do, so of each
    longer order only those travel; nothing is lost, since a document's own counts are left out. N-grams are known by 64-bit hashes.

    Words are split at ASCII white space. Null and empty texts have no words, score 0 and have no mean. Ids may be null or repeat;
    each row is a document of its own. An empty table gives no rows. Other columns are not looked at.
    """
    size, words = docs.agg(F.sum(F.octet_length("text")), F.sum(F.expr(f"regexp_count(text, r'{WORD}')"))).first()
    blocks, buckets, words = max(1, -(-(size or 0) // block_bytes)), max(1, -(-(size or 0) // bucket_bytes)), words or 0
    named = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"))
    steps = [tuple(range(1, min(order, 2) + 1)), *[(n,) for n in range(3, order + 1)]]

    def met(texts: pa.Table, told: pa.Table | None, known: int) -> tuple[Block, list[np.ndarray], Counts | None]:
        """The block, the counts elsewhere of the orders of the first ``known`` steps, and the n-grams of the next step."""
        block, left = Block(as_bytes(texts.column("text").combine_chunks())), []
        rows = list(zip(*(told.column(c).to_pylist() for c in ("step", "bucket", "mask", "more")), strict=True)) if told is not None else []
        for k, orders in enumerate(steps[:known + 1]):
            ends = [block.ends(n) if k == 0 else block.likely(n, left[-1]) for n in orders]
            counts = Counts([block.hashes(n, e) for n, e in zip(orders, ends, strict=True)])
            if k == known:
                return block, left, counts
            totals = _totals(counts, [r[1:] for r in rows if r[0] == k], buckets)
            left += [block.elsewhere(i, e, totals) for i, e in zip(counts.index, ends, strict=True)]
        return block, left, None

    def first(texts: pa.Table) -> pa.Table:
        return _entries(texts.column("block")[0].as_py(), met(texts, None, 0)[2], buckets)

    def next_step(known: int):
        def fn(texts: pa.Table, told: pa.Table) -> pa.Table:
            if not texts.num_rows:
                return _entries(0, Counts([np.empty(0, np.uint64)]), buckets)
            return _entries(texts.column("block")[0].as_py(), met(texts, told, known)[2], buckets)

        return fn

    def scored(texts: pa.Table, told: pa.Table) -> pa.Table:
        block, left, _ = met(texts, told, len(steps))
        score, found = block.scores(left, words)
        mean = pa.array(score / np.maximum(block.sizes, 1), mask=block.sizes == 0)
        return pa.table({"doc_id": texts.column("doc_id").cast(pa.int64()), "n_words": pa.array(block.sizes), "log_score": pa.array(score), "mean_log": mean, "n_found": pa.array(found)})

    shape, told = "bucket int, block int, grams binary, counts binary", None
    for k in range(len(steps)):
        entries = named.groupBy("block").applyInArrow(first, shape) if k == 0 else named.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(next_step(k), shape)
        totals = stored(entries.groupBy("bucket").applyInArrow(_added, "bucket int, block int, mask binary, more binary").withColumn("step", F.lit(k)))
        told = totals if told is None else told.union(totals)
    return named.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(scored, "doc_id long, n_words long, log_score double, mean_log double, n_found long")
