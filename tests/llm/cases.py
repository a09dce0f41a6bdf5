"""Small corpora that the tests of this folder share."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def documents(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """``(doc_id, text)`` or ``(doc_id, text, source)`` with extra columns named like the operators' own."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "s", "x", 1, 2, 3, "y", "k", 4, 5, ["z"], 6) for r in rows]
    return spark.createDataFrame(full, "doc_id long, text string, source string, fingerprint string, n_words long, d long, t long, spans string, _key string, _d long, _T long, _spans array<string>, `a.b` long")


def awkward() -> list[tuple]:
    """Nulls, empty and very long texts, ties and repeated rows."""
    rng = random.Random(5)
    long = prose(rng, 30_000, 3_000)
    same = prose(rng, 80)
    return [(1, None), (2, ""), (3, " \t\n\x0b "), (None, same), (None, None), (4, same), (4, same), (4, prose(rng, 70)), (5, same.upper()), (6, long),
            (7, "a " * 300), (8, prose(rng, 19)), (9, prose(rng, 20)), (10, "ä ö ß x 中文"), (11, long + " tail")]
