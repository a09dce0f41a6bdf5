"""Chat formatting and WARC archives by round trips, URL filters by rules and held-out accuracy."""

from __future__ import annotations

import base64
import hashlib
import random
from urllib.parse import urlsplit

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlark.llm import chat, urls, warc

from .cases import prose

TEXTS = st.lists(st.sampled_from([*chat.CONTROL, "\\", "<", ">", "[", "]", "/", "s", "INST", " ", "\n", "é", "a", "b"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_escapes_are_reversible_and_leave_no_control_string(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text and not any(c in out for c in chat.CONTROL)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "[/ROLE]"]), TEXTS), max_size=6))
def test_spans_give_every_turn_back(turns):
    whole = ""
    for k, turn in enumerate(turns):
        part, start, stop = chat.turn_span(chat.instruction_template, turns[:k], turn)
        whole += part
        assert (chat.role_of(part), chat.unescape(part[start:stop])) == turn
    assert whole == chat.instruction_template(turns)


def test_a_template_that_rewrites_history_is_found(spark):
    def last_only(turns):
        return "".join(f"<{r}>{t if k == len(turns) - 1 else ''}" for k, (r, t) in enumerate(turns))

    with pytest.raises(chat.RewritesHistory):
        chat.turn_span(last_only, [("user", "hello")], ("assistant", "x"))
    assert chat.turn_span(last_only, [], ("user", "hello")) == ("<user>hello", 6, 11)
    with pytest.raises(Exception, match="changes the output"):
        chat.spans(spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b")], "conv_id long, turn long, role string, text string"), last_only).collect()


def test_templates_that_look_further_back_than_the_window(spark):
    turns = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", f"text {i}") for i in range(150)], "conv_id long, turn long, role string, text string")

    def forgets(turns):  # the first turn goes once there are a hundred
        return "".join(f"<{t}>" for _, t in (turns[1:] if len(turns) > 100 else turns))

    with pytest.raises(Exception, match="RewritesHistory"):
        chat.spans(turns, forgets).collect()

    def numbers(turns):
        return "".join(f"{i}:{t};" for i, (_, t) in enumerate(turns))

    got = chat.spans(turns, numbers).orderBy("turn").collect()
    assert [(r.formatted, r.formatted[r.start:r.stop]) for r in got] == [(f"{i}:text {i};", f"text {i}") for i in range(150)]


def test_digests(spark):
    rng = random.Random(1)
    rows = [(1, 0, "system", "be [INST] kind"), (1, 2, "assistant", "</s>\\"), (1, 1, "user", None), (2, 0, None, "x"), (None, 0, "assistant", "y"), (1, None, "user", "first"), (2, 0, None, "x")]
    rows += [(9, k, "assistant" if k % 2 else "user", prose(rng, 5)) for k in range(200)]
    turns = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, n_turns string, start int")
    got = {r.conv_id: r for r in chat.format_digest(turns, context=8).collect()}
    assert len(got) == 4
    for conv in got:
        mine = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))]
        loss = "".join(t for r, t in mine if r == "assistant")
        want = (len(mine), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in mine).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(chat.instruction_template(mine)))
        assert tuple(got[conv])[1:] == want
    cut = chat.spans(turns.where("conv_id = 1")).collect()
    assert [(r.role, chat.unescape(r.formatted[r.start:r.stop]), r.loss) for r in cut] == [("user", "first", False), ("system", "be [INST] kind", False), ("user", "", False), ("assistant", "</s>\\", True)]
    assert chat.format_digest(turns.where("false")).count() == 0


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", 5) for r in rows], "page_id long, url string, html string, digest string, at int")


FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 4\r\n\r\nevil\r\n\r\n"


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_archives_round_trip(spark, monkeypatch, compression):
    monkeypatch.setattr(warc, "RECORDS", 9)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    rng = random.Random(2)
    rows = [(i, f"http://x/{i}", prose(rng, rng.randrange(60))) for i in range(60)]
    rows += [(100 + i, None, "same \r\n\r\n") for i in range(20)] + [(200, "a\r\nContent-Length: 1", f"head {FAKE}{FAKE} tail"), (201, "u", FAKE), (202, "u", "WARC/1.0\r\n" * 5), (203, "u", None), (204, "u", "")]
    rows += [(205, "u", "ends in WARC/1.0\r\n"), (206, "u", f"head {FAKE}{FAKE} tail"), (None, "u", "lonely"), (None, "u", "same \r\n\r\n"), (300, "u", "tie"), (300, "u", "tie"), (301, "ü", "äöü WARC/1.0\r\nContent-Length: 99999\r\n\r\n")]
    try:
        got = sorted((tuple(r) for r in warc.archive_digest(pages(spark, rows), compression=compression).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    first = {}
    for i, _, html in rows:
        first[html or ""] = max(first.get(html or "", -1), -1 if i is None else i)
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        mine = i == first[html or ""] or first[html or ""] == -1
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if mine else "revisit", None if mine else first[html or ""]))
    assert got == sorted(want, key=str)


def test_small_payloads_and_empty_tables(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")]
    kinds = {r.page_id: (r.record_type, r.refers_to) for r in warc.archive_digest(pages(spark, rows), least=3).collect()}
    assert kinds == {1: ("response", None), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None)}
    assert warc.archive_digest(pages(spark, [])).count() == 0


URLS = ["http://a.example.com/en/1", "https://WWW.Example.COM/en/2", "http://example.com/fr/", "http://x.net/es/a?b=://c/d", "net/es/", None, "", "http://net/fr/9#f", "http://notexample.net/de/", "x://HÖST.org/p?q",
        "http://a.com?x=/en/", "http://www.example.com.net/es/", "ftp://com/", "http://ecom/x", "a://b://c/d", "http://x.com\n/y"]


def judged_by_hand(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    best = None
    for verdict, rule in urls.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = verdict, rule
    return host, path, *(best[::-1] if best else (None, None))


def test_rules(spark):
    rng = random.Random(3)
    rows = [(i, u) for i, u in enumerate(URLS)] + [(None, URLS[0]), (0, URLS[0])]
    rows += [(100 + i, f"http://{rng.choice(['www.', '', 'm.'])}{rng.choice(['example', 'x'])}.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'es', 'fr', 'de'])}/{i}") for i in range(200)]
    df = spark.createDataFrame([(*r, "clash", 1.0) for r in rows], "page_id long, url string, host string, label double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 300, 3)] + [(3, None), (None, 1)], "doc_id long, toxic int")
    got = urls.judged(df, labels).collect()
    want = sorted(((i, *judged_by_hand(u)) for i, u in rows), key=str)
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict if r.rule else None) for r in got), key=str) == want
    assert {r.verdict for r in got} <= {"allow", "block"}
    assert urls.judged(df.where("false"), labels).count() == 0 and urls.judged(df, labels.where("false")).count() == len(rows)


def test_trees_on_held_out_urls(spark):
    rng = random.Random(4)
    rows = []
    for i in range(1500):
        bad = rng.random() < 0.4
        host = "".join(rng.choices("abcdefg0123456789-" if bad else "abcdefgh", k=rng.randrange(8, 20)))
        rows.append((f"http{'' if bad else 's'}://{host}.{rng.choice(['xyz', 'net'] if bad else ['org', 'net'])}/{'p/' * rng.randrange(1 + 4 * bad)}{i}" + "?a=1&b=2" * (bad and rng.random() < 0.7), float(bad)))
    df = spark.createDataFrame(rows, "url string, label double")
    known = urls.parsed(df.limit(1000), "label")
    model = urls.fit(known)
    held = model.score(urls.lexical(urls.parsed(df.subtract(df.limit(1000)), "label")))
    right = [(r.score >= 0.5) == (r.label == 1.0) for r in held.collect()]
    assert len(right) > 400 and sum(right) / len(right) > 0.95


def test_urlsplit_agrees_on_plain_urls():
    for u in ("http://a.example.com/en/1", "https://x.net/es/a?b=c#d"):
        parts = urlsplit(u)
        assert judged_by_hand(u)[:2] == (parts.netloc, parts.path)
