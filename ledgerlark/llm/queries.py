"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, codes, decontaminate, licenses, lm, manifest, mixing, quality, simhash, substrings, tokens, urls, warc
from .common import documents, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


@_query("op1_url_filters")
def _(spark, sf_dir):
    return urls.judged(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


@_query("op2_token_counts")
def _(spark, sf_dir):
    import public_tokenizers

    return tokens.token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@_query("op3_source_mixing")
def _(spark, sf_dir):
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


@_query("op4_benchmark_decontamination", r"""
WITH words AS (SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents
  UNION ALL SELECT 'b', item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') FROM benchmark),
starts AS (SELECT kind, id, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5),
shingles AS (SELECT DISTINCT kind, id, array_to_string(w[i:i+4], ' ') AS s FROM starts),
items AS (SELECT id, s, count(*) OVER (PARTITION BY id) AS n FROM shingles WHERE kind = 'b')
SELECT d.id AS doc_id, i.id AS item_id, any_value(i.n) AS n_item, count(*) AS n_found, count(*) / any_value(i.n) AS containment
FROM shingles d JOIN items i ON d.s = i.s WHERE d.kind = 'd' GROUP BY d.id, i.id HAVING 100 * count(*) >= 80 * any_value(i.n)""")
def _(spark, sf_dir):
    return decontaminate.contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@_query("op5_simhash_near_dedup")
def _(spark, sf_dir):
    return simhash.near_duplicates(documents(spark, sf_dir))


@_query("op7_quality_rules")
def _(spark, sf_dir):
    return quality.quality_signals(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_MARKED = r"""len(regexp_extract_all({0}, '\\|\[INST\]|\[/INST\]|<s>|</s>|<<SYS>>|<</SYS>>|\[ROLE\]|\[/ROLE\]')) + len({0})"""


@_query("op6_chat_formatting", f"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
said AS (SELECT conv_id, string_agg(text, '' ORDER BY turn, role, text) AS loss FROM rows WHERE role = 'assistant' GROUP BY conv_id),
whole AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum({_MARKED.format("text")} + CASE role WHEN 'assistant' THEN 6 WHEN 'user' THEN 18 ELSE 30 + {_MARKED.format("role")} END) AS BIGINT) AS formatted_chars
  FROM rows GROUP BY conv_id)
SELECT whole.conv_id, n_turns, turns_sha256, len(coalesce(loss, '')) AS loss_chars, sha256(coalesce(loss, '')) AS loss_sha256, formatted_chars
FROM whole LEFT JOIN said ON whole.conv_id = said.conv_id""")
def _(spark, sf_dir):
    given = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    quoted = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", quoted), (-1, 1, "assistant", quoted)], given.schema)
    return chat.format_digest(given.union(extra))


@_query("op8_substring_dedup", r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM words WHERE len(w) >= 20),
windows AS (SELECT doc_id, p, md5(array_to_string(w[p:p+19], ' ')) AS k FROM starts),
later AS (SELECT doc_id, p FROM windows QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, p) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM later),
each AS (SELECT doc_id, w[i] AS word, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words)),
kept AS (SELECT e.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY e.i) AS text FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM words LEFT JOIN kept ON words.doc_id = kept.doc_id""")
def _(spark, sf_dir):
    return substrings.removal_digest(documents(spark, sf_dir))


_HEX = "('0x' || substr(h, {at}, 5))::BIGINT"
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((({_HEX.format(at=1 + 5 * i)} >> {shift}) & 31) + 1 AS INT), 1)" for i in range(8) for shift in (15, 10, 5, 0))


@_query("op9_warc", f"""
WITH hashed AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
first AS (SELECT h, max(page_id) AS first FROM hashed GROUP BY h)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, {_BASE32.replace("(h,", "(hashed.h,")} AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM hashed JOIN first ON hashed.h = first.h""")
def _(spark, sf_dir):
    return warc.archive_digest(table(spark, sf_dir, "pages"))


@_query("op10_lm_scoring")
def _(spark, sf_dir):
    return lm.lm_scores(documents(spark, sf_dir))


_NOTICES = ", ".join("('{}', '{}')".format(label, text.replace("'", "''")) for label, text in licenses.NOTICES)
_WORDS = r"regexp_extract_all(lower({}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLACES = " UNION ALL ".join(
    "SELECT r, i - 1 AS i, '{}' AS label FROM spots WHERE {}".format(label, " AND ".join(f"w[i + {k}] = '{word}'" for k, word in enumerate(phrase.split())))
    for phrase, label in licenses.PHRASES.items())


@_query("op11_license_scans", f"""
WITH words AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.replace("lower({})", _LOWER.format("coalesce(text, '')"))} AS w FROM documents),
spots AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM words),
places AS ({_PLACES}),
base AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY r),
notices AS (SELECT row_number() OVER () AS t, label, list_distinct({_WORDS.format("notice")}) AS s, len({_WORDS.format("notice")}) AS n FROM (VALUES {_NOTICES}) v(label, notice)),
templates AS (SELECT t, label, s, len(s) AS size, CAST(ceil({licenses.THRESHOLD} * len(s) - 1e-9) AS BIGINT) AS needed, (SELECT min(x) FROM unnest({list(licenses.WIDTHS)}) u(x) WHERE x >= n) AS width FROM notices),
vocabulary AS (SELECT DISTINCT unnest(s) AS word FROM templates),
hits AS (SELECT DISTINCT r, (i - 1) AS i, word FROM (SELECT r, i, w[i] AS word FROM spots) a SEMI JOIN vocabulary v ON a.word = v.word),
blocks AS (SELECT DISTINCT r, width, (i // width) - d AS k, word FROM hits, (SELECT DISTINCT width FROM templates) x, (VALUES (0), (1)) y(d) WHERE (i // width) - d >= 0),
each AS (SELECT t, unnest(s) AS word FROM templates),
met AS (SELECT b.r, b.width, b.k, p.t, any_value(p.label) AS label, any_value(p.size) AS size, count(*) AS n FROM blocks b JOIN each e ON b.word = e.word JOIN templates p ON p.t = e.t AND p.width = b.width
  GROUP BY b.r, b.width, b.k, p.t HAVING count(*) >= any_value(p.needed)),
above AS (SELECT a.t, b.t AS u FROM templates a JOIN templates b ON len(a.s) < len(b.s) AND len(list_intersect(a.s, b.s)) = len(a.s)),
kept AS (SELECT * FROM met m WHERE NOT EXISTS (SELECT 1 FROM above JOIN met o ON o.t = above.u WHERE above.t = m.t AND o.r = m.r AND o.width = m.width AND o.k = m.k)),
named AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM kept UNION ALL SELECT r, label FROM places) GROUP BY r),
scored AS (SELECT r, max(n / size) AS score FROM kept GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0)::DOUBLE END AS score
FROM words LEFT JOIN base ON words.r = base.r LEFT JOIN named ON words.r = named.r LEFT JOIN scored ON words.r = scored.r""")
def _(spark, sf_dir):
    return licenses.license_scan(documents(spark, sf_dir)).drop("blocks")


#: Levels that the SQL of the manifest unrolls: 3 ** 12 documents a source.
_DEPTH = 12
_FRAME = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = " || ".join(_FRAME.format(c) for c in manifest.FIELDS)
_TAMPERED = " || ".join(_FRAME.format("(CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END)" if c == "text" else c) for c in manifest.FIELDS)
_CRC = ("xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), "
        "lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295::BIGINT)")


def _levels(name: str, group: str) -> str:
    """SQL of ``name0`` to ``nameN``, each level of a tree from the one below, and of the siblings that each leaf meets."""
    out = []
    for k in range(1, _DEPTH + 1):
        out.append(f"{name}{k} AS (SELECT {group}, i // 3 AS i, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h, "
                   f"CAST(ceil(any_value(n) / 3) AS BIGINT) AS n FROM {name}{k - 1} GROUP BY {group}, i // 3)")
        out.append(f"{name}p{k} AS (SELECT a.{group}, a.i, a.n > 1 AS hashed, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS l, "
                   f"coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS r FROM {name}{k - 1} a JOIN {name}{k - 1} b ON a.{group} = b.{group} AND a.i // 3 = b.i // 3 "
                   f"GROUP BY a.{group}, a.i, a.n)")
    return ",\n".join(out)


def _fold(name: str, group: str, start: str, from_table: str) -> tuple[str, str]:
    """SQL that folds ``from_table`` up the levels of ``name``, gathering siblings; and the name of the last step."""
    out, before = [], from_table
    for k in range(1, _DEPTH + 1):
        now = f"{name}f{k}"
        out.append(f"{now} AS (SELECT f.* EXCLUDE ({start}, i, folded, proof), f.{start}, f.i // 3 AS i, CASE WHEN p.hashed THEN sha256(p.l || f.folded || p.r) ELSE f.folded END AS folded, f.proof || p.l || p.r AS proof "
                   f"FROM {before} f JOIN {name}p{k} p ON f.{start} = p.{group} AND f.i = p.i)")
        before = now
    return ",\n".join(out), before


_LOW, _LOW_END = _fold("s", "g", "g", "s00")
_HIGH, _HIGH_END = _fold("t", "g", "top", "t00")


@_query("op12_merkle_manifest", f"""
WITH given AS (SELECT *, {_CRC} AS crc, coalesce('=' || source, '') AS g FROM documents),
hashed AS (SELECT doc_id, g, sha256({_LEAF}) AS h, sha256({_TAMPERED}) AS changed FROM given),
s0 AS (SELECT doc_id, g, changed, h, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM hashed),
{_levels("s", "g")},
t0 AS (SELECT 0 AS g, g AS source, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM s{_DEPTH}),
{_levels("t", "g")},
s00 AS (SELECT doc_id, g, h AS leaf, i, changed AS folded, '' AS proof FROM s0),
{_LOW},
t00 AS (SELECT f.doc_id, f.leaf, t.h AS subroot, 0 AS top, t.i, f.folded, f.proof FROM {_LOW_END} f JOIN t0 t ON f.g = t.source),
{_HIGH}
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = h AS verified FROM {_HIGH_END} CROSS JOIN (SELECT h FROM t{_DEPTH})""")
def _(spark, sf_dir):
    return manifest.proof_digest(documents(spark, sf_dir))


_PART = "[p * width + 1 : p * width + width]"
_ASSIGN = """{0} AS (SELECT i, p, v, e, d FROM (SELECT a.i, a.p, a.v, b.e, list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
  FROM parts a JOIN {1} b ON a.p = b.p) QUALIFY row_number() OVER (PARTITION BY i, p ORDER BY d, e) = 1)"""
_MEANS = """{1} AS (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM {2} b LEFT JOIN (SELECT p, e, list(mean ORDER BY c) AS v FROM
  (SELECT p, e, c, floor(sum(v[c]) / count(*))::BIGINT AS mean FROM (SELECT p, e, v, unnest(range(1, len(v) + 1)) AS c FROM {0}) GROUP BY p, e, c) GROUP BY p, e) m ON b.p = m.p AND b.e = m.e)"""


@_query("op13_vector_codes", f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS i, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v, len(embedding) // 16 AS width
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT i, p, v{_PART} AS v FROM kept, (SELECT unnest(range(16)) AS p)),
b0 AS (SELECT p, i - 1 AS e, v FROM parts WHERE i <= 64),
{_ASSIGN.format("a1", "b0")},
{_MEANS.format("a1", "b1", "b0")},
{_ASSIGN.format("a2", "b1")},
{_MEANS.format("a2", "b2", "b1")},
{_ASSIGN.format("a3", "b2")},
codes AS (SELECT i, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a3 GROUP BY i),
said AS (SELECT string_agg(array_to_string(v, ','), ',' ORDER BY p, e) AS text FROM b2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, sha256(text) AS codebooks_sha256 FROM kept JOIN codes ON kept.i = codes.i CROSS JOIN said""")
def _(spark, sf_dir):
    return codes.code_digest(table(spark, sf_dir, "embeddings"))
