"""Recompute only what a change can reach."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .ordered import attach_totals

HORIZON_S = 7 * 86_400


def changed_rows(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Rows of either version that were created, deleted or altered."""
    cols = [c for c in after.columns if c != key]
    a = before.select(key, F.struct(*cols).alias("_a"))
    b = after.select(key, F.struct(*cols).alias("_b"))
    return a.join(b, key, "full").where(~F.col("_a").eqNullSafe(F.col("_b")))


def changed_entities(before: DataFrame, after: DataFrame, key: str, entities: Sequence[str]) -> DataFrame:
    """Distinct ``kind, entity`` of changed rows in both versions; blanks are nobody."""
    pairs = [F.struct(F.lit(e).alias("kind"), F.col(side)[e].alias("entity")) for side in ("_a", "_b") for e in entities]
    long = changed_rows(before, after, key).select(F.explode(F.array(*pairs)).alias("p")).select("p.kind", "p.entity")
    return long.where("entity IS NOT NULL AND entity <> ''").distinct()


def neighbourhood(rows: DataFrame, dirty: DataFrame, key: str, unlimited: Sequence[str], near: Sequence[str] = (),
                  span: DataFrame | None = None, ts: str = "ts_s", horizon: int = HORIZON_S) -> DataFrame:
    """Rows that share a changed entity; ``near`` entities only within ``horizon`` of the changed rows."""
    found = None
    for e in [*unlimited, *near]:
        some = rows
        if e in near and span is not None:
            some = attach_totals(rows, span, []).where(F.col(ts).between(F.col("lo") - horizon, F.col("hi") + horizon)).select(*rows.columns)
        ids = some.join(dirty.where(F.col("kind") == e).select(F.col("entity").alias(e)), e, "left_semi").select(key)
        found = ids if found is None else found.unionByName(ids)
    return rows.join(found.distinct(), key, "left_semi")


def rebuild(before: DataFrame, after: DataFrame, previous: DataFrame, key: str, entities: Sequence[str], build) -> DataFrame:
    """``build(after)`` obtained by rebuilding only rows near a change.

    ``build`` must derive a row from rows that share one of ``entities`` with it. A row's features
    are taken from the rebuild only when it is owned by a changed entity; the rest keep their
    previous values. The inputs of a rebuilt entity are complete because every row of a changed
    entity, and every row sharing an entity with those, takes part.
    """
    dirty = durable(changed_entities(before, after, key, entities))
    owned = durable(neighbourhood(after, dirty, key, entities))
    kinds = F.explode(F.array(*[F.struct(F.lit(e).alias("kind"), F.col(e).alias("entity")) for e in entities]))
    reach = owned.select(kinds.alias("p")).select("p.kind", "p.entity").where("entity <> ''").distinct()
    fresh = build(neighbourhood(after, reach, key, entities)).join(owned.select(key), key, "left_semi")
    kept = previous.join(owned.select(key), key, "left_anti").join(after.select(key), key, "left_semi")
    return kept.unionByName(fresh.select(*previous.columns))


def restore_slice(current: DataFrame, pristine: DataFrame, key: str, minted, touched) -> DataFrame:
    """Undo one campaign: drop the rows it minted, put originals back for the rows it touched."""
    kept = current.where(~minted & ~touched)
    return kept.unionByName(pristine.join(current.where(touched & ~minted).select(key), key, "left_semi"))
