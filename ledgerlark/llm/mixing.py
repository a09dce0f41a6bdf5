"""Mixing sources to target weights by a low-discrepancy schedule over shuffled blocks of equal token counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, durable, ranked, running_before

#: Words in a block.
BLOCK = 256
#: Rows or slots that one ordered chunk holds.
CHUNK = 1 << 12
#: The schedule's points lie on so many steps of the unit line, the golden ratio's fraction of them apart.
STEPS = 1 << 31
GOLDEN = round(0.6180339887498949 * STEPS) | 1
SEED = 17


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, source_size`` -> ``sid, source, source_size, weight, target``.

    Sources take the weights in turn, by code point with null last, and share ``share`` of all words; a target stops at ``most``
    times its source and what is over goes to the others by weight, round by round. A round is one aggregate over the sources.
    """
    order = (F.col("source").isNull(), F.col("source"))
    turn = F.array(*map(F.lit, weights))[(F.col("rank") % len(weights)).cast("int")]
    sources = durable(ranked(sizes, *order).select(F.col("rank").alias("sid"), "source", "source_size", turn.alias("weight")))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = 0.0, -1
    while total:
        over = F.col("weight") * F.lit(level) >= F.col("source_size") * F.lit(most)
        n, kept, free = sources.agg(F.count(F.when(over, 1)), F.sum(F.when(over, F.col("source_size"))), F.sum(F.when(~over, F.col("weight")))).first()
        if n == stopped or not free:
            break
        level, stopped = (total * share - most * (kept or 0)) / free, n
    target = F.least(F.col("weight") * F.lit(level), F.col("source_size") * F.lit(most))
    return sources.withColumn("target", target.cast("double"))


def _points(sources: DataFrame, slots: int) -> DataFrame:
    """``slot, sid``: each slot's golden-ratio point falls into one source's share of the cumulative block counts."""
    spark = sources.sparkSession
    wide = running_before(sources.withColumn("_all", F.lit(0)).withColumn("_chunk", F.expr(f"sid div {CHUNK}")), "_all", "_chunk", ["sid"], "blocks", "lo")
    # Both sides meet in equal bins of the line, so that the lookup is an equality join; a source lies in every bin it touches.
    bins = 1024
    width = -(-slots // bins)
    shares = wide.where("blocks > 0").select(
        "sid", "lo", (F.col("lo") + F.col("blocks")).alias("hi"),
        F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"(lo + blocks - 1) div {width}"))).alias("bin"))
    # frac(slot * golden) in whole steps, the same on every machine
    at = F.expr(f"cast(floor(cast(((slot % {STEPS}) * {GOLDEN}) % {STEPS} AS double) / {STEPS} * {slots}) AS long)")
    points = spark.range(slots).withColumnRenamed("id", "slot").withColumn("at", F.least(at, F.lit(slots - 1)))
    points = points.withColumn("bin", F.expr(f"at div {width}"))
    return points.join(shares, "bin").where("at >= lo AND at < hi").select("slot", "sid")


def schedule(sources: DataFrame) -> DataFrame:
    """``slot, sid, block``: the order in which the mix reads its blocks; every block of every source has one slot.

    A source's slots are ranked and the r-th reads its block r. Points fill a source's share evenly but not exactly: a slot past
    its source's last block goes to a block that is left over.
    """
    slots = sources.agg(F.sum("blocks")).first()[0] or 0
    if not slots:
        return sources.where("false").select(F.lit(0).cast("long").alias("slot"), "sid", F.lit(0).cast("long").alias("block"))
    points = _points(sources, slots).withColumn("one", F.lit(1)).withColumn("chunk", F.expr(f"slot div {CHUNK}"))
    points = durable(running_before(points, "sid", "chunk", ["slot"], "one", "block").select("slot", "sid", F.col("block").cast("long")))
    used = points.groupBy("sid").agg(F.count("*").alias("used"))
    have = sources.select("sid", "blocks").join(used, "sid", "left").select("sid", "blocks", F.coalesce("used", F.lit(0)).alias("used"))
    spare = ranked(points.join(sources.select("sid", "blocks"), "sid").where("block >= blocks").select("slot"), F.col("slot"))
    short = ranked(have.where("used < blocks").select("sid", F.explode(F.expr("sequence(used, blocks - 1)")).alias("block")), F.col("block"), F.col("sid"))
    moved = spare.join(short, "rank").select("slot", "sid", "block")
    kept = points.join(sources.select("sid", "blocks"), "sid").where("block < blocks").select("slot", "sid", "block")
    return kept.union(moved)


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken, first_slot`` for every row of ``docs(doc_id, text, source)``.

    The documents of a source are shuffled by a seeded hash and laid end to end, again from the start when they run out; the line
    is cut into blocks of ``BLOCK`` words up to the source's target, the last one shorter, and :func:`schedule` reads the blocks.
    ``taken`` counts the words read of a document, repeats included; ``first_slot`` is the slot that reads it first.

    A source may hold any share of the rows: its line is summed in chunks. Null texts are empty; a document without words
    takes part with nothing taken. Null is a source of its own. Ids may be null or repeat; each row is answered. An empty table
    gives no rows. Reruns agree. Other columns are not looked at.
    """
    sized = durable(docs.select("doc_id", "source", F.coalesce(F.expr(f"regexp_count(text, r'{WORD}')"), F.lit(0)).cast("long").alias("size")))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    targets = source_targets(sizes.select("source", "source_size"), weights, share, most)
    chunks = sizes.select("source", F.expr(f"n div {CHUNK} + 1").alias("chunks"))
    sources = durable(targets.join(chunks, targets.source.eqNullSafe(chunks.source)).select(
        "sid", targets.source, "source_size", "target", "chunks", F.floor("target").cast("long").alias("length"),
        F.ceil(F.floor("target") / BLOCK).cast("long").alias("blocks")))
    h = F.xxhash64(F.lit(SEED), "doc_id")
    lined = sized.join(sources, sized.source.eqNullSafe(sources.source)).select(
        "doc_id", sized.source, "size", "sid", "source_size", "target", "length", h.alias("h"), F.pmod(h, "chunks").alias("chunk"))
    lined = durable(running_before(lined, "sid", "chunk", ["h", "doc_id", "size"], "size", "start").drop("h", "chunk"))
    turns = lined.where("size > 0 AND length > 0").select(
        "sid", "start", "size", "length", F.explode(F.expr("sequence(0, (length - 1) div source_size)")).alias("turn"), "source_size")
    spans = turns.select("sid", "start", (F.col("start") + F.col("turn") * F.col("source_size")).alias("lo"), "size", "length")
    spans = spans.select("sid", "start", "lo", F.least(F.col("lo") + F.col("size"), "length").alias("hi")).where("lo < hi")
    cut = spans.select("*", F.explode(F.expr(f"sequence(lo div {BLOCK}, (hi - 1) div {BLOCK})")).alias("block"))
    words = F.least("hi", (F.col("block") + 1) * BLOCK) - F.greatest("lo", F.col("block") * BLOCK)
    read = cut.withColumn("words", words).join(schedule(sources), ["sid", "block"])
    taken = read.groupBy("sid", "start").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    keyed = lined.withColumn("key", F.when(F.col("size") > 0, F.col("start")))
    taken = taken.select(F.col("sid").alias("_sid"), F.col("start").alias("_start"), "taken", "first_slot")
    joined = keyed.join(taken, (keyed.sid == taken._sid) & (keyed.key == taken._start), "left")
    return joined.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")
