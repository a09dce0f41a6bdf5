"""Near-duplicates, decontamination and mixing against plain loops."""

from __future__ import annotations

import random
import re
from itertools import combinations

import pytest
import xxhash

from ledgerlark.llm import decontaminate, mixing, simhash
from ledgerlark.llm.common import components, ranked, running_before

from .cases import awkward, documents, prose


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(values):
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(root), 2):
        if (a ^ b).bit_count() <= 2:
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in values}


def expected_components(rows):
    prints = [(i, fingerprint(t)) for i, t in rows]
    root = linked({p for _, p in prints})
    least = {}
    for i, p in prints:
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    return sorted(((i, f"{p:016x}", least.get(root[p])) for i, p in prints), key=str)


def test_near_duplicates(spark):
    rng = random.Random(1)
    base = prose(rng, 400)
    rows = awkward() + [(20 + i, base.upper() if i % 2 else base) for i in range(30)] + [(60 + i, base + f" end{i}") for i in range(25)] + [(90 + i, prose(rng, 1 + i % 4, 3)) for i in range(40)]
    got = simhash.near_duplicates(documents(spark, rows).repartition(4))
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected_components(rows)


def test_large_buckets_are_split_and_lose_no_link(spark, monkeypatch):
    rng = random.Random(2)
    values = {0, (1 << 64) - 1}
    for _ in range(12):
        centre = rng.getrandbits(64)
        values |= {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(40)}
    monkeypatch.setattr(simhash, "TREE", 7)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    found = components(simhash.links(spark.createDataFrame(signed, "fp long")))
    root = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in found.collect()}
    groups = {}
    for v, r in linked(values).items():
        groups.setdefault(r, set()).add(v)
    assert {frozenset(g) for g in groups.values() if len(g) > 1} == {frozenset(v for v in root if root[v] == r) for r in set(root.values())}


def test_tree_search():
    rng = random.Random(3)
    tree, values = simhash.BKTree(), [rng.getrandbits(12) for _ in range(300)]
    for v in values:
        tree.add(v)
    for q in range(0, 4096, 37):
        assert sorted(tree.within(q, 2)) == [i for i, v in enumerate(values) if (v ^ q).bit_count() <= 2]


def test_wide_links_lose_none(spark, monkeypatch):
    rng = random.Random(6)
    values = {0, (1 << 64) - 1} | {rng.getrandbits(64) for _ in range(60)}
    for _ in range(8):
        centre = rng.getrandbits(64)
        values |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(11))) for _ in range(25)}
    root = {v: v for v in values}
    for a, b in combinations(sorted(values), 2):
        if (a ^ b).bit_count() <= 10 and root[a] != root[b]:
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = {v: new if r == old else r for v, r in root.items()}
    want = {frozenset(v for v in root if root[v] == r) for r in root.values()}
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    for most in (2048, 3):
        monkeypatch.setattr(simhash, "TREE", most)
        found = {r["node"] % (1 << 64): r["root"] for r in components(simhash.wide_links(spark.createDataFrame(signed, "fp long"))).collect()}
        assert {frozenset(v for v in found if found[v] == r) for r in found.values()} == {g for g in want if len(g) > 1}


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(30)], [(0, i) for i in range(1, 40)], [(5, 5)], [(1, 2), (2, 1), (4, 3), (3, 9), (9, 2), (8, 7)], []])
def test_components(spark, edges):
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_ranks_and_running_sums(spark):
    df = spark.createDataFrame([(g, c, v) for g in "ab" for c in range(3) for v in range(5)], "g string, c int, v long")
    assert [r["rank"] for r in ranked(df, "g", "c", "v").orderBy("g", "c", "v").collect()] == list(range(30))
    before = [r["b"] for r in running_before(df, "g", "c", ["v"], "v", "b").orderBy("g", "c", "v").collect()]
    assert before[:15] == before[15:] == [sum(([*range(5)] * 3)[:k]) for k in range(15)]


def shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def test_contamination(spark, monkeypatch):
    rng = random.Random(4)
    items = [(i, prose(rng, n, 5000)) for i, n in enumerate((4, 5, 6, 9, 15, 30, 60))] + [(2, prose(rng, 12, 5000)), (None, prose(rng, 20, 5000)), (50, None), (51, "")]
    docs = awkward()
    for k in range(80):
        words = (rng.choice(items)[1] or "").split()
        for _ in range(rng.randrange(4)):
            if words:
                words[rng.randrange(len(words))] = "changed"
        docs.append((100 + k, f"{prose(rng, rng.randrange(200), 5000)}, {' '.join(words).title()}! {prose(rng, 30, 5000)}"))
    expected = set()
    for i, t in docs:
        have = shingles(t)
        for j, u in items:
            if (want := shingles(u)) and 100 * len(want & have) >= 80 * len(want):
                expected.add((i, j, len(want), len(want & have)))
    table = spark.createDataFrame([(*x, 0) for x in items], "item_id long, text string, n long")
    for rows in (decontaminate.BROADCAST_ROWS, 20):
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows)
        got = decontaminate.contaminated(documents(spark, docs), table)
        assert {(r.doc_id, r.item_id, r.n_item, r.n_found) for r in got.collect()} == expected and len(expected) > 20
    held = {(i, t) for i, t in docs if any(100 * len(w & shingles(t)) >= 80 * len(w) for _, u in items if (w := shingles(u)))}
    left = decontaminate.clean(documents(spark, docs), table)
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted((x for x in docs if x not in held), key=str)


def targets(sizes, weights=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, stopped = 1.5 * sum(sizes.values()), set()
    while True:
        free = sum(weight[s] for s in order if s not in stopped)
        level = (total - sum(2 * sizes[s] for s in stopped)) / free if free else 0
        over = {s for s in order if s not in stopped and weight[s] * level >= 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in stopped else weight[s] * level for s in order}
        stopped |= over


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    monkeypatch.setattr(mixing, "CHUNK", 10)
    rng = random.Random(5)
    rows = [(i, t, rng.choice(["b", "é", None, "a", ""])) for i, t in awkward()] + [(100 + i, prose(rng, rng.randrange(90)), rng.choice("aaaaabcdefgh")) for i in range(200)] + [(7, None, "zz")]
    got = mixing.mix(documents(spark, rows)).collect()
    again = mixing.mix(documents(spark, rows).repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = targets(sizes)
    assert sorted(((r.doc_id, r.source, r.size) for r in got), key=str) == sorted(((i, s, size(t)) for i, t, s in rows), key=str)
    for s, target in want.items():
        mine = [r for r in got if r.source == s]
        assert all(abs(r.target - target) < 1e-6 and r.source_size == sizes[s] for r in mine)
        assert sum(r.taken for r in mine) == int(mine[0].target)
    assert all(0 <= r.taken <= 2 * r.size for r in got)


def test_schedule_reads_every_block_once_and_evenly(spark):
    blocks = {0: 500, 1: 1, 2: 250, 3: 0, 4: 249}
    slots = mixing.schedule(spark.createDataFrame(list(blocks.items()), "sid long, blocks long")).orderBy("slot").collect()
    assert [s["slot"] for s in slots] == list(range(1000))
    assert sorted((s["sid"], s["block"]) for s in slots) == sorted((s, b) for s, n in blocks.items() for b in range(n))
    for cut in (50, 100, 400, 900):
        assert all(abs(sum(s["sid"] == k for s in slots[:cut]) - cut * n / 1000) < 8 for k, n in blocks.items())


def test_empty_tables(spark):
    none = documents(spark, [])
    items = spark.createDataFrame([(1, prose(random.Random(1), 30))], "item_id long, text string")
    assert simhash.near_duplicates(none).count() == simhash.one_of_each(none).count() == mixing.mix(none).count() == 0
    assert decontaminate.contaminated(none, items).count() == decontaminate.clean(none, items).count() == 0
    some = documents(spark, awkward())
    assert decontaminate.contaminated(some, items.where("false")).count() == 0 and decontaminate.clean(some, items.where("false")).count() == some.count()
