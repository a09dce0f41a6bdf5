"""License scans, Merkle manifests and vector codes against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from ledgerlark.llm import codes, licenses, manifest

from .cases import awkward, documents, prose

# license scans


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_scan(text, notices=licenses.NOTICES, threshold=licenses.THRESHOLD):
    words = words_of(text)
    places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i:i + len(p.split())] == p.split()]
    sets = [(label, set(words_of(t)), len(words_of(t))) for label, t in notices]
    found = []
    for width in licenses.WIDTHS:
        for k in range(-(-len(words) // width)):
            block = set(words[k * width:(k + 2) * width])
            met = [(label, s) for label, s, n in sets
                   if min(w for w in licenses.WIDTHS if n <= w) == width and len(s & block) >= math.ceil(threshold * len(s) - 1e-9)]
            found += [(label, k * width, min((k + 2) * width, len(words)), len(s & block) / len(s)) for label, s in met if not any(s < o for _, o in met)]
    base = {label for _, label in places}
    score = 1.0 if base else max((f[3] for f in found), default=0.0)
    starts = [i for i, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | {f[0] for f in found})), score, sorted(found))


def license_texts():
    rng = random.Random(3)
    mit, cc = licenses.NOTICES[0][1], "Licensed under CC BY-NC 4.0."
    dropped = " ".join(w for i, w in enumerate(mit.split()) if i not in (3, 9))
    shuffled = mit.split()
    rng.shuffle(shuffled)
    texts = [mit, prose(rng, 37) + " " + mit + " " + prose(rng, 50), dropped, " ".join(shuffled), mit.replace(" ", "\n "), mit[:60], cc, prose(rng, 9) + "\n" + cc,
             "released under the MIT License, not the mit-license.", "GNU General Public License. general public  license", "ÄMIT license mit licenseö",
             "licensed under cc by 4.0 and licensed under cc by-nc 4.0", "a the of to this software " * 200]
    texts += [prose(rng, 60) + " ".join(rng.sample(t.split(), rng.randrange(len(t.split()))) + [t] * (i % 2)) for i in range(3) for _, t in licenses.NOTICES]
    return texts


def rows_of(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"],
                    sorted(tuple(b) for b in r["blocks"])) for r in df.collect()), key=str)


@pytest.mark.parametrize("threshold", [licenses.THRESHOLD, 0.6, 1.0])
def test_every_block_that_meets_the_threshold_is_found(spark, threshold):
    rows = awkward() + [(100 + i, t) for i, t in enumerate(license_texts())]
    got = licenses.license_scan(documents(spark, rows).repartition(5), threshold=threshold)
    assert rows_of(got) == sorted(((i, *plain_scan(t, threshold=threshold)) for i, t in rows), key=str)


def test_notice_whose_words_are_dropped_beyond_the_threshold_is_left_alone(spark):
    text = " ".join(licenses.NOTICES[0][1].split()[:20])
    row = licenses.license_scan(documents(spark, [(1, text)])).first()
    assert (row["labels"], row["score"], row["blocks"]) == ("", 0.0, [])


def test_scan_of_an_empty_table_and_of_own_notices(spark):
    assert licenses.license_scan(documents(spark, [])).collect() == []
    row = licenses.license_scan(documents(spark, [(1, "Only ACME staff may read this")]), [("acme", "only acme staff may read this"), ("none", "...")], {}).first()
    assert (row["n_base"], row["labels"], row["score"]) == (0, "acme", 1.0)
    with pytest.raises(ValueError):
        licenses.license_scan(documents(spark, []), threshold=0)


# manifests


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climbed(nodes, at):
    """The root of ``nodes``, and per level what stands left and right of the node ``at``."""
    path = []
    while len(nodes) > 1:
        first = at - at % 3
        path.append(("".join(nodes[first:at]), "".join(nodes[at + 1:first + 3])))
        nodes = [sha("".join(nodes[i:i + 3])) for i in range(0, len(nodes), 3)]
        at //= 3
    return nodes[0], path


def plain_manifest(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in groups.values():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    subroots = [climbed([leaf(r) for r in groups[s]], 0)[0] for s in order]
    out = []
    for k, s in enumerate(order):
        root, high = climbed(subroots, k)
        for i, row in enumerate(groups[s]):
            path = climbed([leaf(r) for r in groups[s]], i)[1] + high
            changed = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None:
                changed = (*row[:4], row[4].replace("\n", ""))
            fold = leaf(changed)
            for left, right in path:
                fold = sha(left + fold + right)
            out.append((row[0], leaf(row), subroots[k], root, sha("".join(x + y for x, y in path)), fold, fold == root))
    return sorted(out, key=str)


def manifest_rows(sizes):
    rng = random.Random(8)
    rows, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((i, source, rng.choice(["en", "de", None]), rng.choice([1, 20, None]), rng.choice(["a\nb", "", None, "ä\n中", prose(rng, 5)])))
            i += rng.choice([1, 7, 40])
    rows += [(None, "b", None, None, "x\ny"), (None, "b", None, None, "x\ny"), (None, None, "en", 3, None), (5_000_000_000, "b", "en", 2, "p\nq"), (5_000_000_000, "b", "en", 2, "p")]
    rng.shuffle(rows)
    return rows


DOCS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, g string, path string, `a.b` long"


@pytest.mark.parametrize("levels", [1, 2, manifest.LEVELS])
def test_proofs_lead_to_the_root(spark, monkeypatch, levels):
    monkeypatch.setattr(manifest, "LEVELS", levels)
    sizes = {"b": 30, "a": 1, "": 3, "Z": 4, "ä": 9, None: 10, "c": 2, "hot": 260 if levels == manifest.LEVELS else 90}
    rows = manifest_rows(sizes)
    docs = spark.createDataFrame([(*r, "x", "y", "z", 1) for r in rows], DOCS).repartition(5)
    assert sorted((tuple(r) for r in manifest.proof_digest(docs).collect()), key=str) == plain_manifest(rows)


@pytest.mark.parametrize("n", [0, 1, 3, 4])
def test_small_manifests(spark, n):
    rows = [(i, "s", "en", 1, "a\n") for i in range(n)]
    docs = spark.createDataFrame([(*r, "x", "y", "z", 1) for r in rows], DOCS)
    assert sorted((tuple(r) for r in manifest.proof_digest(docs).collect()), key=str) == (plain_manifest(rows) if rows else [])


# vector codes


def plain_codes(rows, parts=16, entries=64, rounds=2):
    ok = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    ok.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ok = [r for r in ok if len(r[1]) == len(ok[0][1])]
    width = -(-len(ok[0][1]) // parts)
    whole = [[math.floor(256 * x) for x in r[1]] + [0] * (width * parts - len(r[1])) for r in ok]
    cut = [[v[p * width:(p + 1) * width] for p in range(parts)] for v in whole]
    book = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def assign():
        out = []
        for c in cut:
            each = [[sum((x - y) ** 2 for x, y in zip(c[p], e, strict=True)) for e in book[p]] for p in range(parts)]
            out.append([(min(range(len(d)), key=lambda k: (d[k], k)), min(d)) for d in each])
        return out

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(book[p])):
                mine = [c[p] for c, f in zip(cut, found, strict=True) if f[p][0] == e]
                if mine:
                    book[p][e] = [sum(m[k] for m in mine) // len(mine) for k in range(width)]
    digest = sha(",".join(str(x) for b in book for e in b for x in e))
    found = assign()
    errors = [sum(d for _, d in f) for f in found]
    by_label = {}
    for r, e in zip(ok, errors, strict=True):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    return sorted(((r[0], "".join(f"{k:02x}" for k, _ in f), e, by_label[r[2]], digest) for r, f, e in zip(ok, found, errors, strict=True)), key=str)


VECTORS = "vec_id long, embedding array<float>, label int, code string, v array<int>, error long, `a.b` long"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "c", [1], 2, 3) for r in rows], VECTORS)


@pytest.mark.parametrize(("dims", "n"), [(64, 200), (32, 70), (20, 90), (64, 5)])
def test_vector_codes(spark, dims, n):
    rng = np.random.default_rng(dims + n)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, [0.01, 0.3, 3][i % 3], dims)], int(i % 4) if i % 5 else None) for i in rng.permutation(n)]
    same = rows[0][1]
    rows += [(1000 + i, same, 1) for i in range(40)] + [(2000, [0.0] * dims, 2), (None, same, None), (3, rows[1][1], 7), (3, rows[1][1], 7)]
    rows += [(-1, None, 1), (-2, [], 1), (-3, [float("nan")] * dims, 1), (-4, [float("inf")] + [0.0] * (dims - 1), 1), (-5, [None] + [0.0] * (dims - 1), 1), (9000, [1.0], 1)]
    got = codes.code_digest(vectors(spark, rows).repartition(3))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_codes(rows)


def test_codes_of_an_empty_table_and_of_no_usable_vector(spark):
    assert codes.code_digest(vectors(spark, [])).collect() == []
    assert codes.code_digest(vectors(spark, [(1, None, 1), (2, [float("nan")], None)])).collect() == []


def test_huge_components_are_held(spark):
    rows = [(i, [3e38 * (-1) ** i] * 64, 1) for i in range(4)]
    assert len(codes.code_digest(vectors(spark, rows)).collect()) == 4


def test_nearest_agrees_with_all_distances_and_its_ties():
    rng = np.random.default_rng(4)
    for dims in (1, 4, 7):
        entries = rng.integers(-6, 6, (64, dims))
        points = rng.integers(-8, 8, (3000, dims))
        index, best = codes.nearest(points, entries)
        d = ((points[:, None] - entries) ** 2).sum(2)
        assert (index == d.argmin(1)).all() and (best == d.min(1)).all()


def test_decoded_vectors_are_near(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 20)], 0) for i in range(300)]
    df = vectors(spark, rows)
    books = codes.Codebooks.fit(df)
    coded = books.encode(df, code="kode", error="miss")
    assert coded.columns == [*df.columns, "kode", "miss"]
    from pyspark.sql import functions as F

    for r in coded.withColumn("back", books.decode(F.col("kode"))).collect():
        gap = np.array(r["back"]) - np.floor(np.array(r["embedding"], np.float64) * 256) / 256
        assert len(r["back"]) == 20
        assert round(float((gap ** 2).sum()) * 65536) == r["miss"]
