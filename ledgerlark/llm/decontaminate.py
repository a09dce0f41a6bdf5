"""Benchmark items found inside documents: size-partitioned MinHash sketches, then exact shingle containment. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, text_hash, unused

#: Words in a shingle; an item is found if a document holds at least ``FOUND`` of its shingles, in hundredths.
SHINGLE, FOUND = 5, 80
#: Rows that a broadcast side may have. Items beyond it are taken in blocks, candidates beyond it by a shuffled join.
BROADCAST_ROWS = 1_000_000


def _words(df: DataFrame, *keep: str) -> DataFrame:
    """Lower-case runs of letters and digits, of texts with a shingle at least."""
    return df.select(*keep, F.expr(r"regexp_extract_all(lower(text), r'[\p{L}\p{N}]+', 0)").alias("w")).where(F.size("w") >= SHINGLE)


def _shingles(df: DataFrame, *keep: str) -> DataFrame:
    """One row per shingle; hash and words are worked out behind the generator, inside generated code."""
    at = [F.col("w")[F.col("i") + k] for k in range(SHINGLE)]
    rows = df.select(*keep, "w", F.explode(F.sequence(F.lit(0), F.size("w") - SHINGLE)).alias("i"))
    return rows.select(*keep, F.xxhash64(*at).alias("h"), F.concat_ws(" ", *at).alias("shingle"))


def item_shingles(items: DataFrame) -> DataFrame:
    """``item, item_id, n, h, shingle, sketched`` for each distinct shingle of each distinct item.

    Items are partitioned by size, a class reaching from one power of two to the next. A class's sketch is the ``m`` least hash
    values of an item, one more than the shingles that its largest item may miss; a document that holds enough of the item
    holds one of them, so the sketch loses nothing.
    """
    from pyspark.sql import Window as W

    words = _words(items.select("item_id", "text"), "item_id").withColumn("item", F.xxhash64("item_id", "w")).dropDuplicates(["item"])
    each = _shingles(words, "item", "item_id").distinct()
    sizes = each.groupBy("item").agg(F.count("*").alias("n"))
    largest = F.expr("shiftleft(1, length(bin(n))) - 1")
    least = F.row_number().over(W.partitionBy("item").orderBy("h", "shingle"))
    return each.join(sizes, "item").withColumn("sketched", least <= F.floor(largest * (100 - FOUND) / 100) + 1)


def _found(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, t, item_id, n, n_found``: the items found, with the hash ``t`` of the document's text."""
    known = durable(item_shingles(items))
    blocks = -(-known.count() // BROADCAST_ROWS) or 1
    named = docs.select("doc_id", text_hash().alias("t"), "text")
    out = None
    for block in range(blocks):
        some = known.where(F.pmod("item", F.lit(blocks)) == block)
        probed = _shingles(_words(named, "doc_id", "t"), "doc_id", "t").select("doc_id", "t", "h")
        pairs = durable(probed.join(F.broadcast(some.where("sketched").select("h", "item")), "h").select("doc_id", "t", "item").distinct())
        hit = pairs.select(F.col("doc_id").alias("_d"), F.col("t").alias("_t")).distinct()
        again = named.join(_small(hit), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("t") == F.col("_t")), "left_semi")
        mine = _shingles(_words(again, "doc_id", "t"), "doc_id", "t")
        whole = some.select(F.col("h").alias("_h"), F.col("shingle").alias("_s"), "item", "item_id", "n")
        met = mine.join(F.broadcast(whole), (mine.h == whole._h) & (mine.shingle == whole._s))
        counted = met.groupBy("doc_id", "t", "item", "item_id", "n").agg(F.count_distinct("_s").alias("n_found")).where(f"100 * n_found >= {FOUND} * n")
        candidates = pairs.toDF("_d", "_t", "_i")
        rows = counted.join(candidates, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("t") == F.col("_t")) & (F.col("item") == F.col("_i")), "left_semi")
        out = rows if out is None else out.union(rows)
    return out.drop("item")


def _small(ids: DataFrame) -> DataFrame:
    """To be broadcast, if it was counted and has no more than ``BROADCAST_ROWS`` rows."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, n_item, n_found, containment`` for each benchmark item that a document of ``docs(doc_id, text)`` holds.

    First the sketches of ``items(item_id, text)`` are probed with every shingle of every document. Only documents with a hit
    are then read again, and their shingles compared, as text, with the whole items. Sketches and items are broadcast in blocks
    of at most about ``BROADCAST_ROWS`` shingles; candidate ids are broadcast up to that number, else joined by a shuffle.

    Words are runs of letters and digits, lower-cased. Null texts and texts under five words hold and are no items. Null and
    repeated ids are answered; equal answers appear once. Other columns are not looked at.
    """
    return _found(docs, items).select("doc_id", "item_id", F.col("n").alias("n_item"), "n_found", (F.col("n_found") / F.col("n")).alias("containment")).distinct()


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, in which no item is found."""
    d, t, key = unused(docs, "_d", "_t", "_key")
    found = durable(_found(docs, items).select(F.col("doc_id").alias(d), F.col("t").alias(t)).distinct())
    return docs.withColumn(key, text_hash()).join(_small(found), F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(key) == F.col(t)), "left_anti").drop(key)
