"""Vector code compression: product codes whose nearest entries are found by equal-average search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from .common import stored

#: Parts of a vector, entries of a codebook, rounds of the fit, and steps that one unit is cut into.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors whose parts are searched together.
SLICE = 4096


def limit(dims: int, parts: int) -> int:
    """Components are held within this, so that squared distances of vectors and squared gaps of a part's sums fit 64 bits."""
    return 1 << min(61 - dims.bit_length(), 61 - 2 * (-(-dims // parts)).bit_length()) // 2


def usable(vector: Column, dims: int) -> Column:
    """Whether ``vector`` has ``dims`` components, none of them null, NaN or infinite."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce((F.size(vector) == dims) & sound, F.lit(False))


def scaled(vectors: np.ndarray, parts: int) -> np.ndarray:
    """``floor(256 * x)`` of every component, as ``rows, parts, components of a part``; the last part is filled up with zeros."""
    rows, dims = vectors.shape
    most = limit(dims, parts)
    whole = np.clip(np.floor(vectors.astype(np.float64) * SCALE), -most, most).astype(np.int64)
    return np.pad(whole, ((0, 0), (0, -dims % parts))).reshape(rows, parts, -1)


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of every point, ties to the lower index, and the squared distance.

    Equal-average search. Entries are sorted by the sum of their components and a point starts between the sums around its
    own. Both ways outward it takes the next entry as long as the squared gap of the sums, over the dimension, is not above
    its best distance: by Cauchy's inequality no entry behind that can be as near. All points of the array go step by step
    together, and those that are done drop out.
    """
    n, dims = points.shape
    total = entries.sum(1)
    order = np.lexsort((np.arange(len(entries)), total))
    ranked, rank_sum = entries[order], total[order]
    own = points.sum(1)
    best, index = np.full(n, np.iinfo(np.int64).max), np.full(n, len(entries))
    start = np.searchsorted(rank_sum, own)
    for step, first in ((1, start), (-1, start - 1)):
        # the upper way first; the lower one then profits from what it found
        active, at = np.arange(n), first
        while True:
            inside = (at >= 0) & (at < len(ranked))
            active, at = active[inside], at[inside]
            gap = rank_sum[at] - own[active]
            # the distance is whole, so "gap * gap / dims > best" is the same as its floor being above best or equal with a rest
            reach = -(-(gap * gap) // dims) <= best[active]
            active, at = active[reach], at[reach]
            if not len(active):
                break
            d = ((points[active] - ranked[at]) ** 2).sum(1)
            better = (d < best[active]) | (d == best[active]) & (order[at] < index[active])
            best[active[better]], index[active[better]] = d[better], order[at[better]]
            at = at + step
    return index, best


def _slices(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            piece = batch.slice(at, SLICE)
            flat = np.asarray(piece.column("v").flatten(), np.float64)
            yield piece, scaled(flat.reshape(piece.num_rows, -1), parts)


class Codebooks:
    """Codebooks of every part, ``entries[part, entry, component]``, fitted on the kept rows of a table of vectors."""

    def __init__(self, entries: np.ndarray, dims: int) -> None:
        self.entries, self.dims = entries, dims

    @classmethod
    def fit(cls, vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding",
            parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
        """Start from the parts of the kept rows with the smallest ids; then ``rounds`` times assign all parts and take the means.

        A round sends one sum per task, part and used entry through a shuffle; what the driver collects is the size of the
        codebooks, whatever the table. The vector length is that of the smallest id with any usable vector.
        """
        whole = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
        some = vectors.where((F.size(embedding) > 0) & whole)
        order = [F.asc_nulls_last(vec_id), F.col(embedding)]
        sample = some.orderBy(*order).select(F.size(embedding).alias("n")).first()
        if sample is None:
            return cls(np.zeros((parts, 0, 0), np.int64), 0)
        dims = sample["n"]
        kept = vectors.where(usable(F.col(embedding), dims)).select(F.col(vec_id).alias("i"), F.col(embedding).cast("array<double>").alias("v"))
        first = np.array([r["v"] for r in kept.orderBy(F.asc_nulls_last("i"), "v").limit(entries).collect()], np.float64)
        book = np.ascontiguousarray(scaled(first, parts).transpose(1, 0, 2))
        for _ in range(rounds):
            book = cls._round(kept.select("v"), book)
        return cls(book, dims)

    @staticmethod
    def _round(kept: DataFrame, book: np.ndarray) -> np.ndarray:
        parts, entries, width = book.shape

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, counts = np.zeros(book.shape, object), np.zeros((parts, entries), np.int64)
            for _, whole in _slices(batches, parts):
                for p in range(parts):
                    index, _ = nearest(whole[:, p], book[p])
                    counts[p] += np.bincount(index, minlength=entries)
                    for c in range(width):  # 32 bits at a time stay exact in the doubles of bincount
                        high, low = whole[:, p, c] >> 16, whole[:, p, c] & 0xFFFF
                        each = [np.bincount(index, weights=x, minlength=entries).astype(np.int64) for x in (high, low)]
                        sums[p, :, c] += each[0].astype(object) * 65536 + each[1]
            at = np.argwhere(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at[:, 0]), pa.array(at[:, 1]), pa.array(counts[tuple(at.T)]),
                 pa.array([[str(s) for s in sums[p, e]] for p, e in at], pa.list_(pa.string()))], ["p", "e", "n", "s"])

        told = kept.mapInArrow(summed, "p long, e long, n long, s array<string>")
        totals = told.groupBy("p", "e").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[c].cast("decimal(38,0)")).alias(f"s{c}") for c in range(width)])
        book = book.copy()
        for r in totals.collect():  # one row per used entry
            book[r["p"], r["e"]] = [int(r[f"s{c}"]) // r["n"] for c in range(width)]
        return book

    def digest(self) -> str:
        """SHA-256 of all components in decimal, by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def encode(self, vectors: DataFrame, embedding: str = "embedding", code: str = "code", error: str = "error") -> DataFrame:
        """The rows of ``vectors`` that can be coded, all columns, with the entry indexes as an array and the squared error."""
        book, dims = self.entries, self.dims
        parts = len(book)
        kept = vectors.where(usable(F.col(embedding), dims) if dims else F.lit(False))
        names = list(kept.columns)
        placed = kept.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("v", F.col(f"c{names.index(embedding)}").cast("array<double>"))

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece, whole in _slices(batches, parts):
                found = [nearest(whole[:, p], book[p]) for p in range(parts)]
                index = np.stack([f[0] for f in found], 1).astype(np.int32)
                ends = pa.array(np.arange(0, index.size + 1, parts, dtype=np.int32))
                columns = [*piece.columns[:-1], pa.ListArray.from_arrays(ends, pa.array(index.ravel())), pa.array(sum(f[1] for f in found))]
                yield pa.RecordBatch.from_arrays(columns, [*piece.schema.names[:-1], "code", "error"])

        schema = StructType(placed.schema.fields[:-1]).add("code", ArrayType(IntegerType())).add("error", "long")
        return placed.mapInArrow(coded, schema).toDF(*names, code, error)

    def decode(self, code: Column) -> Column:
        """The vector that a code stands for: the lower corner of the cells of its entries' components."""
        flat = F.lit(self.entries.reshape(-1).tolist())
        parts, entries, width = self.entries.shape
        whole = F.slice(F.flatten(F.transform(code, lambda e, p: F.slice(flat, (p * entries + e) * width + 1, width))), 1, self.dims)
        return F.transform(whole, lambda x: x / SCALE)


def code_digest(vectors: DataFrame) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` for every row of ``vectors(vec_id, embedding, label)`` that can be coded.

    Rows whose vector is null, empty, holds null or non-finite components, or is not as long as that of the smallest id, are left
    out. A length that the number of parts does not divide is filled up with zeros. Components beyond :func:`limit` are held
    there. Null ids come last at the start; rows that share an id start in the order of their vectors. Repeated rows are each
    answered, and an empty table gives no rows. Errors of equal labels are summed before the shuffle and joined back by label,
    which Spark broadcasts or splits by what it measures. Other columns are not looked at.
    """
    rows = vectors.select("vec_id", "embedding", "label")
    books = Codebooks.fit(rows)
    coded = stored(books.encode(rows).select("vec_id", "code", "error", "label"))
    totals = coded.groupBy(F.col("label").alias("_l")).agg(F.try_sum("error").alias("label_error"))
    digits = F.array_join(F.transform("code", lambda e: F.lower(F.lpad(F.hex(e), 2, "0"))), "")
    return coded.join(totals, F.col("label").eqNullSafe(F.col("_l")), "left").select(
        "vec_id", digits.alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
