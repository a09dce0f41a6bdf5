"""Token counts by a byte-level BPE vocabulary, without building ids."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, pieces

#: Distinct pre-tokens whose piece counts a task keeps at a time.
KEPT = 1 << 19
#: A text is cut for pre-tokenising after so many characters, at the next space behind an ASCII letter or digit. No pre-token
#: of the vocabulary's pattern runs from such a character into a space, so the cut changes nothing.
STRETCH = 1 << 20
_CUT = re.compile(r"(?<=[A-Za-z0-9])(?= )")
#: The vocabulary's own split into pre-tokens (fixed value), and the code points whose classes are the same in every Unicode
#: version in use; a text with any other goes through the library's splitter, which gives the same and takes five times as long.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SETTLED = re.compile(r"[\x00-\u052F\u2010-\u205F\u3041-\u3096\u30A0-\u30FF\u4E00-\u9FA5\uAC00-\uD7A3]*")


class PieceCounts(dict):
    """Pre-token -> number of pieces; a pre-token is run through the merges the first time it is asked for."""

    def __init__(self, tokenizer) -> None:
        super().__init__()
        self._tokenizer = tokenizer

    def __missing__(self, pre_token: str) -> int:
        if len(self) >= KEPT:
            self.clear()
        n = self[pre_token] = len(self._tokenizer.encode(pre_token, add_special_tokens=False))
        return n


def stretches(text: str) -> Iterator[str]:
    start = 0
    while len(text) - start > STRETCH and (cut := _CUT.search(text, start + STRETCH)):
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


class TokenCounter:
    """Counts the tokens of a text as the library does by default, special strings included."""

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        if tokenizer.normalizer is not None or type(tokenizer.pre_tokenizer).__name__ != "ByteLevel":
            raise ValueError(f"{path}: not a byte-level vocabulary without a normaliser")
        added = tokenizer.get_added_tokens_decoder().values()
        if any(t.single_word or t.lstrip or t.rstrip for t in added):
            raise ValueError(f"{path}: an added token takes white space or whole words")
        names = sorted((t.content for t in added), key=len, reverse=True)
        self._special = re.compile("|".join(map(re.escape, names))) if names else None
        self._split, self._pre, self._pieces = regex.compile(PATTERN), tokenizer.pre_tokenizer, PieceCounts(tokenizer)

    def pre_tokens(self, text: str) -> list[str]:
        if _SETTLED.fullmatch(text):
            return self._split.findall(text)
        return [text[start:stop] for _, (start, stop) in self._pre.pre_tokenize_str(text)]

    def frequencies(self, text: str) -> tuple[Counter, int]:
        """How often each pre-token occurs in a text, and its special tokens."""
        between, special = [text], 0
        if self._special and self._special.search(text):
            between = self._special.split(text)
            special = len(between) - 1
        found: Counter = Counter()
        for part in between:
            for stretch in stretches(part):
                found.update(self.pre_tokens(stretch))
        return found, special

    def __call__(self, text: str) -> int:
        found, special = self.frequencies(text)
        pieces_of = self._pieces
        return special + sum(n * pieces_of[p] for p, n in found.items())


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs(doc_id, text)``.

    Each task turns its texts into pre-token frequencies, counts the pieces of a pre-token once, joins the two and sums. The
    join stays inside the task: bringing all documents' frequencies to one table would shuffle more bytes than the texts hold,
    to save a second count of pre-tokens that two tasks share. ``path`` is the vocabulary file, on every executor.

    A null text is empty: no bytes, no tokens. Ids may be null or repeat; each row is answered. Long texts are counted whole, in
    stretches cut where no pre-token crosses. Other columns are not looked at.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = TokenCounter(path)
        for batch in batches:
            for part in pieces(batch):
                data = as_bytes(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(map(len, data), pa.int64()), pa.array([count(d.decode()) for d in data], pa.int64())],
                    ["doc_id", "n_bytes", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
