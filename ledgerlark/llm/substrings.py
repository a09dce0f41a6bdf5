"""Substring dedup by a compacted de Bruijn graph of token windows.

An edge of the graph is a window of ``WINDOW`` consecutive words; its ends are the window's first and its last ``WINDOW - 1`` words.
Consecutive windows of a text that share their minimizer form a path without branches and travel as one row. Only paths whose
minimizer is met again are looked at further; equal ones compact into one by grouping, and only where the paths of a minimizer
differ, at branches, are their windows told apart. What repeats is joined back to where it was read, and consecutive pieces with
the same source compact into long spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import as_bytes, document_key, map_rows, mixed, ngram_hashes, pieces, stored, text_hash, unused, word_hashes

#: Words in a window, and in the k-mers among which a window's minimizer is the one with the least hash.
WINDOW, KMER = 20, 5
_WIDTH = WINDOW - KMER + 1
_MULT = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, lane: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(lane)
    if have is None or len(have[0]) < n:
        out = []
        for m in (_MULT[lane], pow(_MULT[lane], -1, 1 << 64)):
            p = np.full(2 * n, m, np.uint64)
            p[0] = 1
            with np.errstate(over="ignore"):
                out.append(np.cumprod(p))
        have = _POWERS[lane] = (out[0], out[1])
    return have


def span_keys(h: np.ndarray, start: np.ndarray, length, lane: int) -> np.ndarray:
    """64-bit keys of the words ``start`` to ``start + length``: differences of prefix sums of hash times power, shifted to power 0."""
    up, down = _powers(len(h) + 1, lane)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((h ^ np.uint64(_MULT[1 - lane])) * up[:len(h)])])
        return mixed((total[start + length] - total[start]) * down[start] + np.asarray(length, np.uint64))


def paths(words: list[bytes]) -> tuple[np.ndarray, ...]:
    """The paths of one text: word hashes, minimizer, first window, number of windows.

    A path ends where the minimizer's place changes, so equal windows of one text are in different paths of one minimizer.
    """
    n = len(words) - WINDOW + 1
    h = mixed(word_hashes(words))
    if n < 1:
        return h, np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    least, at, span = mixed(ngram_hashes(h, KMER)), np.arange(len(h) - KMER + 1), 1

    def smaller(step: int) -> tuple[np.ndarray, np.ndarray]:
        left = least[:-step] <= least[step:]  # of equal ones the leftmost
        return np.where(left, least[:-step], least[step:]), np.where(left, at[:-step], at[step:])

    while span * 2 <= _WIDTH:
        least, at = smaller(span)
        span *= 2
    if span < _WIDTH:
        least, at = smaller(_WIDTH - span)
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return h, least[new], new, np.append(new[1:], n) - new


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64))


def _minimizers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, 4 << 20):
            found = [paths(d.split()) for d in as_bytes(part.column("text"))]
            doc = np.repeat(np.asarray(part.column("d")), [len(p[1]) for p in found])
            yield pa.RecordBatch.from_arrays(
                [_signed(np.concatenate([p[1] for p in found])), pa.array(doc), pa.array(np.concatenate([p[2] for p in found]))], ["mini", "d", "start"])


_CANDIDATES = "mini long, key1 long, key2 long, d long, t long, start long, keys array<long>"


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, 4 << 20):
            out: list[list[np.ndarray]] = []
            for d, t, data, wanted in zip(part.column("d").to_pylist(), part.column("t").to_pylist(), as_bytes(part.column("text")), part.column("starts"), strict=True):
                h, mini, start, count = paths(data.split())
                keep = np.isin(start, np.asarray(wanted.values))
                if keep.any():
                    mini, start, count = mini[keep], start[keep], count[keep]
                    each = np.repeat(start - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                    length = count + WINDOW - 1
                    out.append([mini, span_keys(h, start, length, 0), span_keys(h, start, length, 1), np.full(len(mini), d), np.full(len(mini), t), start, count, span_keys(h, each, WINDOW, 0)])
            if out:
                mini, key1, key2, d, t, start, count, keys = (np.concatenate(c) for c in zip(*out, strict=True))
                offsets = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [_signed(mini), _signed(key1), _signed(key2), pa.array(d), pa.array(t), pa.array(start), pa.ListArray.from_arrays(offsets, _signed(keys))],
                    [c.split()[0] for c in _CANDIDATES.split(", ")])


def _named(docs: DataFrame) -> DataFrame:
    """Null ids sort last; the text's hash tells rows apart that share an id."""
    return docs.select("doc_id", "text", document_key().alias("d"), text_hash().alias("t"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``d, t, start, windows, source, source_start``: runs of windows that also start earlier, each with its earliest place.

    ``d`` is the document id (null as the largest long) and ``t`` the hash of its text. A path is known by its minimizer and two
    independent 64-bit keys of all its words: an occurrence counts as repeated only where both keys equal those at the source.
    """
    named = _named(docs)
    minis = named.select("d", "text").mapInArrow(_minimizers, "mini long, d long, start long")
    # stored, so that both sides of the join are plain shuffles and Spark splits a minimizer that many documents hold
    again = stored(minis.groupBy("mini").agg(F.count("*").alias("n")).where("n > 1").select("mini"))
    met = stored(minis.join(again, "mini", "left_semi").select("d", "start"))
    starts = met.groupBy("d").agg(F.collect_set("start").alias("starts"))  # as many as a document has paths
    found = stored(named.select("d", "t", "text").join(starts, "d").mapInArrow(_candidates, _CANDIDATES))
    key = ["mini", "key1", "key2"]
    distinct = stored(found.groupBy(*key).agg(F.min(F.struct("d", "start", "t", "keys")).alias("first"), F.count("*").alias("n")))
    # occurrences of a path behind its first one
    later = found.select(*key, "d", "t", "start", F.size("keys").alias("windows")).join(distinct.where("n > 1").select(*key, "first.d", "first.start").toDF(*key, "source", "source_start"), key)
    later = later.where("d > source OR d = source AND start > source_start").select("d", "t", "start", "windows", "source", "source_start")
    # windows of a path's first occurrence that stand in another path of the same minimizer
    branched = distinct.groupBy("mini").agg(F.count("*").alias("n")).where("n > 1").select("mini")
    windows = distinct.select("mini", "first").join(branched, "mini").select("mini", F.col("first.d").alias("d"), F.col("first.t").alias("t"), "first.start", F.posexplode("first.keys").alias("o", "key"))
    windows = stored(windows.select("mini", "key", "d", "t", (F.col("start") + F.col("o")).alias("start")))
    earliest = windows.groupBy("mini", "key").agg(F.min(F.struct("d", "start")).alias("f"), F.count("*").alias("n")).where("n > 1").select("mini", "key", F.col("f.d").alias("source"), F.col("f.start").alias("source_start"))
    shared = windows.join(earliest, ["mini", "key"]).where("d > source OR d = source AND start > source_start")
    pieces_ = stored(later.union(shared.select("d", "t", "start", F.lit(1).alias("windows"), "source", "source_start")).distinct())
    # pieces of one text that follow each other, with sources that do too, compact into one span
    order = W.partitionBy("d", "t").orderBy("start", "source", "source_start")
    follows = (F.lag(F.col("start") + F.col("windows")).over(order) == F.col("start")) & (F.lag("source").over(order) == F.col("source")) & (
        F.lag(F.col("source_start") + F.col("windows")).over(order) == F.col("source_start"))
    runs = pieces_.withColumn("new", F.when(follows, 0).otherwise(1)).withColumn("run", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy("d", "t", "run").agg(F.min("start").alias("start"), F.sum("windows").alias("windows"), F.min("source").alias("source"), F.min("source_start").alias("source_start")).drop("run")


_TOKEN = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


def _kept(n: int, spans: list[dict] | None) -> np.ndarray:
    step = np.zeros(n + 1, np.int64)
    for s in spans or ():
        step[s["start"]] += 1
        step[s["start"] + s["windows"] + WINDOW - 1] -= 1
    return np.cumsum(step)[:-1] == 0


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch):
            out = []
            for data, spans in zip(as_bytes(part.column("text")), part.column("spans").to_pylist(), strict=True):
                words = data.split()
                keep = _kept(len(words), spans)
                left = list(compress(words, keep.tolist())) if spans else words
                out.append((len(words), len(words) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()))
            n, gone, sha = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha)], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch):
            texts, names = part.column("text").to_pylist(), part.schema.names[:-1]
            for i, spans in enumerate(part.column(len(names)).to_pylist()):
                if spans:  # what is kept keeps the white space behind it
                    tokens = _TOKEN.findall(texts[i].encode())
                    texts[i] = b"".join(compress(tokens, _kept(len(tokens), spans).tolist())).decode()
            yield pa.RecordBatch.from_arrays([pa.array(texts, part.schema.field(c).type) if c == "text" else part.column(c) for c in names], names)


def _listed(docs: DataFrame) -> DataFrame:
    return repeated_spans(docs).groupBy("d", "t").agg(F.collect_list(F.struct("start", "windows")).alias("_spans"))


def removal_digest(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for every row of ``docs(doc_id, text)``; kept words are joined by one space.

    Each word is removed that a window covers whose words also start earlier: in a smaller document id, or before in the same
    text. Windows are judged on what was given, not on what is left.

    A null text has no words; one of fewer words than a window repeats nothing. A null id comes after all others. Rows that
    share an id and a text are the same document and repeat each other nowhere; rows that share only the id are each answered
    for their own text. An empty table gives no rows. Other columns are not looked at.
    """
    joined = _named(docs).join(_listed(docs), ["d", "t"], "left").select("doc_id", "text", F.col("_spans").alias("spans"))
    return joined.mapInArrow(_digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, with what :func:`removal_digest` removes cut from ``text``; other texts stay as they are."""
    d, t, listed = unused(docs, "_d", "_t", "_spans")
    joined = docs.withColumns({d: document_key(), t: text_hash()}).join(_listed(docs).toDF(d, t, listed), [d, t], "left").drop(d, t)
    return map_rows(joined, _cut, len(docs.columns))
