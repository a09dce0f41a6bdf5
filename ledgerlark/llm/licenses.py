"""License scans: an exact set-similarity join of text blocks with license notices."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, pieces

#: Phrases whose words must stand consecutively, with the label that each gives.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices as they are printed in licenses and source files, each with its label.
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
            "(the \"Software\"), to deal in the Software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
            "the Free Software Foundation"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
             "the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
            "copyright notice and this permission notice appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0"),
    ("cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "Unauthorized copying of this file, via any medium, is strictly prohibited. All rights reserved"),
]
#: Share of a notice's distinct words that a block must hold.
THRESHOLD = 0.9
#: A notice of up to so many words is looked for in blocks of twice as many, one every so many words.
WIDTHS = (8, 16, 32, 64, 128, 256, 512, 1024)
#: Most bytes of notices that go to the tasks.
NOTICE_BYTES = 16 << 20

#: Bytes that are part of a word as they are; all others become spaces. Upper case has gone before.
_SPACED = bytes(c if c > 0x7F or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Runs of letters, digits and anything beyond ASCII, with A-Z in lower case."""
    return text.lower().translate(_SPACED).split()


def _needed(n: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * n - 1e-9))


@dataclass
class Template:
    """A notice: its distinct words as ranks, rarest first, and how many of them a block must hold."""

    label: str
    ranks: tuple[int, ...]
    needed: int
    width: int
    above: set[int] = field(default_factory=set)


class Index:
    """Templates by the words of their prefixes.

    ``frequency`` is how many documents of the corpus hold a word. Sets are ordered by it, rarest first. A block and a template
    with ``needed`` words in common share one among the first ``size - needed + 1`` of each, so only those are looked up.
    Words that no template has cannot be shared and are left out of the blocks' sets.
    """

    def __init__(self, notices: Sequence[tuple[str, str]], threshold: float, frequency: Mapping[bytes, int]) -> None:
        if not 0 < threshold <= 1:
            raise ValueError("the threshold lies above 0 and at most at 1")
        split = [(label, words_of(text.encode())) for label, text in notices]
        known = sorted({w for _, words in split for w in words}, key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(known)}
        self.templates, self.prefixes = [], {}
        for label, words in split:
            if not words:
                continue
            ranks = tuple(sorted({self.rank[w] for w in words}))
            width = next((w for w in WIDTHS if len(words) <= w), 1 << (len(words) - 1).bit_length())
            self.templates.append(Template(label, ranks, _needed(len(ranks), threshold), width))
        for t, one in enumerate(self.templates):
            one.above = {u for u, other in enumerate(self.templates) if set(one.ranks) < set(other.ranks)}
            for i, r in enumerate(one.ranks[:len(one.ranks) - one.needed + 1]):
                self.prefixes.setdefault((one.width, r), []).append((t, i))
        self.asked = {w: {r for v, r in self.prefixes if v == w} for w in sorted({w for w, _ in self.prefixes})}

    def matches(self, words: list[bytes]) -> list[tuple[int, int, int, int]]:
        """``template, start, stop, words in common`` of every block and template that meet the threshold, by block.

        A template whose words all belong to another one that the block meets is left out there.
        """
        hits = [(i, r) for i, r in enumerate(map(self.rank.get, words)) if r is not None]
        if not hits:
            return []
        places, ranks = [i for i, _ in hits], [r for _, r in hits]
        found = []
        for width, asked in self.asked.items():
            # block k holds the words from k * width to (k + 2) * width, so a run of up to width words lies whole in one
            blocks = {k for i, r in hits if r in asked for k in (i // width - 1, i // width) if k >= 0}
            for k in sorted(blocks):
                lo, hi = bisect_left(places, k * width), bisect_right(places, (k + 2) * width - 1)
                held = sorted(set(ranks[lo:hi]))
                met = {}
                for j, r in enumerate(held):
                    for t, i in self.prefixes.get((width, r), ()):
                        if t not in met:
                            met[t] = self._overlap(self.templates[t], held, i, j)
                met = {t: n for t, n in met.items() if n}
                stop = min((k + 2) * width, len(words))
                found += [(t, k * width, stop, n) for t, n in sorted(met.items()) if not self.templates[t].above & met.keys()]
        return found

    @staticmethod
    def _overlap(one: Template, held: list[int], i: int, j: int) -> int:
        """Words in common, or 0 if they are too few; ``i`` and ``j`` are the places of the first word that both have."""
        if len(held) < one.needed or j > len(held) - one.needed:  # length, and the prefix of the block
            return 0
        if 1 + min(len(one.ranks) - i - 1, len(held) - j - 1) < one.needed:  # position
            return 0
        n = len(set(one.ranks).intersection(held))
        return n if n >= one.needed else 0


def word_frequencies(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """How many texts of ``docs`` hold each word of ``vocabulary``; a task sends one row a word, and the driver as many as the vocabulary has."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for batch in batches:
            for part in pieces(batch):
                for text in as_bytes(part.column("text")):
                    held.update(vocabulary.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["w", "n"])

    rows = docs.select("text").mapInArrow(counted, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["w"]): r["n"] for r in rows}


def phrase_places(words: list[bytes], phrases: list[tuple[tuple[bytes, ...], str]]) -> list[tuple[int, str]]:
    """``start, label`` of every place where a phrase stands."""
    found = []
    for phrase, label in phrases:
        last, n, at = phrase[-1], len(phrase), 0
        while True:
            try:
                at = words.index(last, at)
            except ValueError:
                break
            if at + 1 >= n and tuple(words[at - n + 1:at + 1]) == phrase:
                found.append((at - n + 1, label))
            at += 1
    return found


SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
          "blocks array<struct<label: string, start: long, stop: long, containment: double>>")


def license_scan(docs: DataFrame, notices: Sequence[tuple[str, str]] = tuple(NOTICES), phrases: Mapping[str, str] = PHRASES,
                 threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: where base phrases stand, and every block that holds a notice.

    ``blocks`` lists every text block with ``threshold`` of a notice's distinct words, with its span in words. ``labels`` joins
    the labels of blocks and phrases; ``score`` is 1 where a phrase stands, else the largest containment among ``blocks``, else 0.

    Word frequencies over all texts order the sets in a first pass; the second looks blocks up in the index of notices, which are
    the caller's parameter and go to the tasks with the function, ``NOTICE_BYTES`` at most. Nothing of the texts is shuffled.

    A null text is empty: no words, no places, no labels, score 0. Ids may be null or repeat; each row is answered. Texts are
    read whole. An empty table gives no rows. Other columns are not looked at.
    """
    if sum(len(t) for _, t in notices) > NOTICE_BYTES:
        raise ValueError(f"more than {NOTICE_BYTES} bytes of notices: scan with some of them at a time")
    wanted = [(tuple(words_of(p.encode())), label) for p, label in phrases.items()]
    vocabulary = {w for _, t in notices for w in words_of(t.encode())}
    index = Index(notices, threshold, word_frequencies(docs, vocabulary))

    def row(text: bytes) -> tuple:
        words = words_of(text)
        places = phrase_places(words, wanted)
        blocks = [{"label": index.templates[t].label, "start": a, "stop": b, "containment": n / len(index.templates[t].ranks)} for t, a, b, n in index.matches(words)]
        base = {label for _, label in places}
        score = 1.0 if base else max((b["containment"] for b in blocks), default=0.0)
        starts = [s for s, _ in places]
        return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
                ",".join(sorted(base | {b["label"] for b in blocks})), score, blocks)

    blocks_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("containment", pa.float64())]))
    types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), blocks_type]
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"]

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                rows = [row(t) for t in as_bytes(part.column("text"))]
                columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *columns], names)

    return docs.select("doc_id", "text").mapInArrow(scanned, SCHEMA)
