"""Quality rules: how much of a text lies inside repeated word n-grams and repeated lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_bytes, map_rows, mixed, ngram_hashes, pieces

#: Largest share of word characters inside word n-grams that occur more than once, by n-gram length.
NGRAM_LIMITS = {5: 0.30, 7: 0.28, 10: 0.25}
#: Largest share of lines, and of word characters, in lines equal to an earlier line.
LINE_LIMIT, LINE_CHAR_LIMIT = 0.40, 0.20
#: Largest share of symbols against words.
SYMBOL_LIMIT = 0.10
MIN_WORDS, REPEAT_PERCENT = 50, 50

SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, "
          "dup_line_chars long, " + ", ".join(f"dup_chars_{n} long" for n in NGRAM_LIMITS) + ", base_failed boolean, kept boolean")


def covered(g: np.ndarray, n: int, words: int) -> np.ndarray:
    """Which of ``words`` words lie in an ``n``-word window whose value in ``g`` is found twice or more."""
    s = np.sort(g)
    again = s[1:][s[1:] == s[:-1]]
    if not len(again):
        return np.zeros(words, bool)
    at = again[np.minimum(np.searchsorted(again, g), len(again) - 1)] == g
    step = np.zeros(words + 1, np.int32)
    step[:-n] += at
    step[n:] -= at
    return np.cumsum(step)[:-1] > 0


def measure(data: bytes) -> tuple:
    """The row of one text, without its id."""
    words = data.split()
    n = len(words)
    length = np.fromiter(map(len, words) if data.isascii() else (len(w.decode()) for w in words), np.int64, n)
    ids: dict[bytes, int] = {}
    h = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, n)
    spread = mixed(h + np.uint64(1))
    v = np.uint64(len(ids))
    # Three ids below 2^21 fit 63 bits and need no hash.
    triples = (h[:-2] * v + h[1:-1]) * v + h[2:] if len(ids) < 1 << 21 else ngram_hashes(spread, 3)
    repeat = int(covered(triples, 3, n).sum()) if n >= 3 else 0
    dup = [int(length[covered(ngram_hashes(spread, k), k, n)].sum()) if n >= k else 0 for k in NGRAM_LIMITS]
    seen: set[bytes] = set()
    lines = dup_lines = dup_chars = 0
    for line in data.split(b"\n"):
        if not line.strip():
            continue
        lines += 1
        if line in seen:
            dup_lines += 1
            dup_chars += len(b"".join(line.split()).decode())
        else:
            seen.add(line)
    symbols = len(data) - len(data.translate(None, b"#*$%&|<>"))
    chars = int(length.sum())
    failed = n < MIN_WORDS or 100 * repeat > REPEAT_PERCENT * n
    good = (all(d <= limit * chars for d, limit in zip(dup, NGRAM_LIMITS.values(), strict=True))
            and dup_lines <= LINE_LIMIT * lines and dup_chars <= LINE_CHAR_LIMIT * chars and symbols <= SYMBOL_LIMIT * n)
    return (n, chars, symbols, dup_lines, repeat, lines, dup_chars, *dup, failed, not failed and good)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(c.split()[0], pa.bool_() if c.endswith("boolean") else pa.int64()) for c in SCHEMA.split(", ")])
    for batch in batches:
        for part in pieces(batch):
            rows = [measure(data) for data in as_bytes(part.column("text"))]
            columns = [part.column("doc_id").cast(pa.int64()), *(pa.array(c) for c in zip(*rows, strict=True))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def quality_signals(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)`` with its counts, repetition coverage and verdict.

    The n-gram windows of every length in ``NGRAM_LIMITS`` are rolling hashes in numpy; a word counts as repeated if any window
    over it is found twice in the text. Nothing is shuffled: a text is judged alone, where it is read.

    A null or empty text has no words and fails the base rule. Ids may be null or repeat; each row is answered. Texts of any
    length are read whole. Other columns are not looked at.
    """
    return docs.select("doc_id", "text").mapInArrow(_measured, SCHEMA)


def passing(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose text the rules keep."""

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                yield part.filter(pa.array([measure(data)[-1] for data in as_bytes(part.column("text"))], pa.bool_()))

    return map_rows(docs, chosen, len(docs.columns))
