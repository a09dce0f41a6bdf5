"""Quality rules, token counts, substring dedup and language-model scores against plain loops."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import pytest

from ledgerlark.llm import lm, quality, substrings, tokens
from ledgerlark.llm.common import ngram_hashes

from .cases import awkward, documents, prose


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def quality_row(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    inside = {j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed


def test_quality_counts(spark):
    rng = random.Random(1)
    rows = awkward() + [(20, "one two\nthree\none two\n\n\none two \n# <b> | *"), (21, prose(rng, 60, 9)), (22, prose(rng, 300, 50))]
    got = quality.quality_signals(documents(spark, rows))
    expected = sorted(((i, *quality_row(t)) for i, t in rows), key=str)
    assert rows_of(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == expected


def test_quality_verdicts(spark):
    rng = random.Random(2)
    clean, passage = prose(rng, 200, 5000), prose(rng, 40, 5000)
    rows = [(1, clean), (2, " ".join([passage] * 2 + [prose(rng, 60, 5000)])), (3, clean.replace(" ", "*** ")), (4, (passage + "\n") * 3 + prose(rng, 90, 5000))]
    kept = dict(rows_of(quality.quality_signals(documents(spark, rows)), "doc_id", "kept"))
    assert kept == {1: True, 2: False, 3: False, 4: False}
    docs = documents(spark, rows)
    assert quality.passing(docs).collect() == docs.where("doc_id = 1").collect()


@pytest.mark.parametrize("n", range(1, 14))
def test_rolling_hashes_depend_on_the_window_alone(n):
    import numpy as np

    x = np.array([random.Random(i % 37).getrandbits(64) for i in range(120)], np.uint64)
    whole, part = ngram_hashes(x, n), ngram_hashes(x[11:60], n)
    assert len(whole) == 120 - n + 1 and (whole[11:11 + len(part)] == part).all()
    assert len(set(whole[:37].tolist())) == 37 and whole[0] == whole[37]


PATH = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_token_counts_are_the_library_s(spark):
    from tokenizers import Tokenizer

    rng, tokenizer = random.Random(3), Tokenizer.from_file(PATH)
    alphabet = [*" \n\t\r'sdtlve09.,!?-<|>", "é", "ß", "中", "😀", " ", "​", "՘", "٣", "'ll", "<|endoftext|>", "  ", "the", "WORD"]
    rows = awkward() + [(100 + i, "".join(rng.choices(alphabet, k=rng.randrange(40)))) for i in range(300)]
    got = tokens.token_counts(documents(spark, rows), PATH)
    expected = []
    for i, text in rows:
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        expected.append((i, len((text or "").encode()), n, n > 512))
    assert rows_of(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(expected, key=str)


def test_stretches_change_nothing(monkeypatch):
    counter = tokens.TokenCounter(PATH)
    text = prose(random.Random(4), 3000) + "  x\n\n " + "ab " * 500
    whole = counter(text)
    monkeypatch.setattr(tokens, "STRETCH", 50)
    assert len(list(tokens.stretches(text))) > 50 and counter(text) == whole
    monkeypatch.setattr(tokens, "KEPT", 3)
    assert tokens.TokenCounter(PATH)(text) == whole


def cut_row(rows):
    order = sorted({(math.inf if i is None else i, t or "") for i, t in rows})
    first: dict[bytes, tuple] = {}
    for i, t in order:
        words = t.encode().split()
        for p in range(len(words) - 19):
            key = b" ".join(words[p:p + 20])
            first[key] = min(first.get(key, (math.inf, math.inf)), (i, p))
    out = []
    for i, t in rows:
        words, d = (t or "").encode().split(), math.inf if i is None else i
        gone = {q for p in range(len(words) - 19) if first[b" ".join(words[p:p + 20])] < (d, p) for q in range(p, p + 20)}
        left = b" ".join(w for q, w in enumerate(words) if q not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def test_substrings(spark):
    rng = random.Random(6)
    passages = [prose(rng, n, 5000) for n in (19, 20, 21, 33, 60, 200)]
    rows = awkward()
    for i in range(60):
        parts = [prose(rng, rng.randrange(40), 5000)]
        for _ in range(rng.randrange(4)):
            words = rng.choice(passages).split()
            a = rng.randrange(0, 5)
            parts += [" ".join(words[a:len(words) - rng.randrange(0, 5)]), prose(rng, rng.randrange(30), 5000)]
        rows.append((100 + rng.randrange(80), "\n".join(parts)))
    rows += [(200 + i, f"{passages[-1]} {prose(rng, 3)}") for i in range(40)] + [(300, "x y " * 60), (301, "y x " * 45)]
    got = substrings.removal_digest(documents(spark, rows).repartition(5))
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == cut_row(rows)


def test_cut_texts_keep_other_columns_and_spacing(spark):
    passage = prose(random.Random(7), 50, 5000)
    docs = documents(spark, [(1, f"a\n {passage}\tb"), (2, f" c\n\n{passage}  d\ne "), (3, None)])
    out = {r["doc_id"]: r for r in substrings.without_repeats(docs).collect()}
    assert out[1]["text"] == f"a\n {passage}\tb" and out[2]["text"] == "c\n\nd\ne " and out[3]["text"] is None
    assert out[2].asDict() | {"text": 0} == docs.where("doc_id = 2").first().asDict() | {"text": 0}


@pytest.mark.parametrize(("order", "block"), [(1, 1 << 20), (2, 1 << 12), (3, 1 << 14)])
def test_backoff_scores(spark, order, block):
    rng = random.Random(8)
    rows = awkward()[:9] + [(50 + i, prose(rng, rng.randrange(60), 30)) for i in range(40)]
    texts = [(i, (t or "").encode().split()) for i, t in rows]

    def grams(w):
        return Counter(tuple(w[k - n + 1:k + 1]) for k in range(len(w)) for n in range(1, order + 1) if k >= n - 1)

    total, words = sum((grams(w) for _, w in texts), Counter()), sum(len(w) for _, w in texts)
    expected = []
    for i, w in texts:
        own, s, found = grams(w), 0.0, 0
        for k in range(len(w)):
            longest = min(order, k + 1)
            for n in range(longest, 0, -1):
                g = tuple(w[k - n + 1:k + 1])
                c = total[g] - own[g]
                below = total[g[:-1]] - own[g[:-1]] if n > 1 else max(words - len(w), 1)
                if c > 0 or n == 1:
                    s += (longest - n) * math.log(0.4) + math.log(max(c, 1) / below)
                    found += n == longest and c > 0
                    break
        expected.append((i, len(w), round(s, 6), found))
    got = lm.lm_scores(documents(spark, rows), order, block)
    assert sorted(((r.doc_id, r.n_words, round(r.log_score, 6), r.n_found) for r in got.collect()), key=str) == sorted(expected, key=str)
    assert all((r.mean_log is None) == (r.n_words == 0) for r in got.collect())


def test_empty_tables(spark):
    none = documents(spark, [])
    for out in (quality.quality_signals(none), quality.passing(none), tokens.token_counts(none, PATH), substrings.removal_digest(none), substrings.without_repeats(none), lm.lm_scores(none)):
        assert out.count() == 0


def test_the_registered_language_model_counts_trigrams(spark, tmp_path):
    from ledgerlark.llm import queries

    rng = random.Random(12)
    rows = [(i, prose(rng, 80, 12)) for i in range(12)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda df: sorted((r.doc_id, round(r.log_score, 9), r.n_found) for r in df.collect())
    got = key(queries.QUERIES["op10_lm_scoring"](spark, str(tmp_path)))
    assert got == key(lm.lm_scores(documents(spark, rows), 3)) != key(lm.lm_scores(documents(spark, rows), 2))
