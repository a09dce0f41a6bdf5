"""Near copies by exact similarity against all pairs."""

from __future__ import annotations

import random
from itertools import combinations

import pytest

from ledgerlark.llm import nearsets

from .cases import awkward, documents, prose


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4)) or frozenset([tuple(words)] if words else [])


def kept_ids(rows, similarity=0.8):
    """Ids that stay, by comparing all pairs of distinct sets."""
    sets = sorted({shingles(t) for _, t in rows}, key=sorted)
    root = {s: i for i, s in enumerate(sets)}
    for x, y in combinations(sets, 2):
        if len(x & y) >= similarity * len(x | y) - 1e-9 and root[x] != root[y]:
            old, new = root[x], root[y]
            root = {s: new if r == old else r for s, r in root.items()}
    least = {}
    for i, t in rows:
        r = root[shingles(t)]
        least[r] = min(least.get(r, i), i)
    return sorted(least.values())


def edited(rng, text, n):
    words = text.split()
    for at in rng.sample(range(len(words)), n):
        words[at] = f"e{rng.randrange(10 ** 6)}"
    return " ".join(words)


def corpus(rng):
    base = [prose(rng, rng.choice([8, 9, 12, 40, 150, 300]), 9000) for _ in range(30)]
    rows = base + [edited(rng, t, rng.randrange(1, 2 + len(t.split()) // 30)) for t in base * 3]
    chain = [base[0] if len(base[0].split()) > 100 else prose(rng, 200, 9000)]
    for _ in range(8):  # each like the one before, the ends alike no more
        chain.append(edited(rng, chain[-1], 3))
    passage = prose(rng, 60, 9000)
    shared = [f"{prose(rng, 30, 9000)} {passage} {prose(rng, 25, 9000)}" for _ in range(50)]
    centre = prose(rng, 120, 9000)
    group = [edited(rng, centre, 2) for _ in range(60)] + [edited(rng, centre, 4) for _ in range(20)]
    small = [prose(rng, k, 12) for k in (1, 2, 3, 4, 5, 6, 7, 8, 9) for _ in range(6)]
    return list(enumerate(rows + chain + shared + group + small + [rows[3].upper(), centre]))


@pytest.mark.parametrize("heavy_from", [2, 64])
def test_no_pair_is_lost(spark, monkeypatch, heavy_from):
    rng = random.Random(heavy_from)
    rows = corpus(rng)
    monkeypatch.setattr(nearsets, "HEAVY", heavy_from)
    monkeypatch.setattr(nearsets, "SLICE", 3 if heavy_from == 2 else 64)
    got = nearsets.one_of_each(documents(spark, rows).repartition(5))
    assert sorted(r["doc_id"] for r in got.collect()) == kept_ids(rows)


def test_the_last_round_alone_loses_none(spark, monkeypatch):
    rows = corpus(random.Random(77))
    monkeypatch.setattr(nearsets, "ROUNDS", 0)
    got = nearsets.one_of_each(documents(spark, rows).repartition(3), similarity=0.6)
    assert sorted(r["doc_id"] for r in got.collect()) == kept_ids(rows, 0.6)


def test_sketches_differ_in_no_more_bits_than_their_sets(spark):
    rng = random.Random(3)
    base = prose(rng, 150, 9000)
    rows = [(i, edited(rng, base, 1 + 3 * i)) for i in range(8)] + [(20, prose(rng, 900, 40)), (21, "a b")]
    got = {r["d"]: r["sk"] for r in nearsets.shingle_sets(documents(spark, rows), 5, 0.8).collect()}
    sets = {i: shingles(t) for i, t in rows}
    for i, j in combinations(got, 2):
        bits = sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(got[i], got[j], strict=True))
        assert bits <= len(sets[i] ^ sets[j])


def test_awkward_rows(spark):
    rows = [(i, t) for i, t in awkward() if i is not None]
    assert sorted(r["doc_id"] for r in nearsets.one_of_each(documents(spark, rows)).collect()) == kept_ids(rows)
    assert nearsets.one_of_each(documents(spark, [])).collect() == []


def test_one_document_of_each_group(spark):
    docs = documents(spark, [(3, "a b c d"), (2, "A b\nc d"), (2, "A b\nc d"), (None, "a b c d"), (None, "other words stand here"), (None, "other words stand here"), (9, "not like the rest of them")])
    kept = nearsets.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.where("doc_id IS NOT NULL").collect()) == [(2, "A b\nc d"), (9, "not like the rest of them")]
    assert [r["text"] for r in kept.where("doc_id IS NULL").collect()] == ["other words stand here"]


def test_copies_with_edited_words_go_and_clean_documents_stay(spark):
    rng = random.Random(8)
    clean = {i: prose(rng, 200, 9000) for i in range(20)}
    rows = list(clean.items())
    for i in range(12):
        words = clean[i].split()
        for at in rng.sample(range(len(words)), 3):
            words[at] = "edited"
        rows.append((100 + i, " ".join(words)))
    half = clean[15].split()
    rows.append((200, " ".join(half[:100]) + " " + prose(rng, 100, 9000)))
    kept = sorted(r["doc_id"] for r in nearsets.one_of_each(documents(spark, rows)).collect())
    assert kept == [*range(20), 200]


def test_the_table_of_all_rows_holds_no_prefixes(spark):
    """Prefixes and sketches are stored once a set, not again with every row."""
    r = random.Random(4)
    same = prose(r, 60)
    named, _ = nearsets.similar_sets(documents(spark, [(1, same), (2, same), (3, prose(r, 60))]))
    assert sorted(named.columns) == ["d", "t", "w"] and named.count() == 3 and named.select("w").distinct().count() == 2
