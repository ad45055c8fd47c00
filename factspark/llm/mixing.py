"""Mixing sources to target weights by systematic sampling of whole documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, numbered, saved

#: Steps of the random offset; few enough bits that offset + count stays exact.
OFFSET_STEPS = 1 << 20


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: list[float], share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds ``target`` to one row per source (``source``, ``source_size``).

    The sources, by code point with null last, weigh ``weights`` in turn and share
    ``share`` times all sizes.  A target stops at ``most`` times its source's size and the
    excess is shared again by weight among the others.  The level L that solves
    sum(min(most * size, L * weight)) = share * total is read from sources ordered by
    most * size / weight, so there is no loop.  One row per source passes one task.
    """
    order = Window.orderBy(F.asc_nulls_last("source"))
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    rows = sizes.withColumn("_w", turn).withColumn("_cap", F.col("source_size") * most)
    rows = rows.withColumn("_full_at", F.col("_cap") / F.col("_w"))
    by_level = Window.orderBy("_full_at", F.asc_nulls_last("source"))
    so_far = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    rows = rows.withColumn("_goal", F.sum("source_size").over(whole) * share)
    left = F.col("_goal") - F.coalesce(F.sum("_cap").over(so_far), F.lit(0.0))
    rows = rows.withColumn("_level", left / F.sum("_w").over(onward))
    # the first source that is not filled sets the level; those before it stop at their cap
    open_at = F.when(F.col("_level") <= F.col("_full_at"), F.struct("_full_at", F.col("source").isNull(), "source"))
    rows = rows.withColumn("_level", F.min_by("_level", open_at).over(whole))
    target = F.coalesce(F.least(F.col("_cap"), F.col("_level") * F.col("_w")), F.col("_cap"))
    return rows.withColumn("target", target).drop("_w", "_cap", "_full_at", "_goal", "_level")


def offset(source: Column) -> Column:
    """One number in (0, 1) per source, the same in every run."""
    step = F.conv(F.substring(F.md5(F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))), 1, 5), 16, 10)
    return (step.cast("double") + 0.5) / OFFSET_STEPS


def mix(docs: DataFrame, weights: list[float], share: float = 1.5, most: float = 2.0, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """How often each document enters the mix (``copies``, 0 included).

    A source's documents stand in order of falling size (ties by id, then by ``row_col``).  Each expects
    r = target / source size copies; with P the prefix sum of r and u the source's random
    offset, a document is emitted once for every integer between P + u before and after it.
    As the order is by size, the words taken miss the target by less than the source's
    largest document, and no document is taken more than ceil(r) times.

    Only ids, sources and word counts are shuffled.  Null texts have size 0, null sources
    form one source, repeated rows are documents of their own, and sources without words
    have target 0 and are not taken.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(text_col).alias("size"), *([F.col(row_col).alias("row")] if row_col else []))
    base = saved(base, "sizes")
    sizes = saved(targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    ranked = numbered(base, ["source"], [("size", True)])
    sizes = sizes.withColumnRenamed("source", "_source")
    rows = ranked.join(sizes, ranked["source"].eqNullSafe(sizes["_source"])).drop("_source")
    rows = rows.withColumn("_i", F.explode(F.sequence(F.col("rank"), F.col("rank") + F.col("copies") - 1)))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    u = offset(F.col("source"))
    copies = F.floor((F.col("_i") + 1) * rate + u) - F.floor(F.col("_i") * rate + u)
    return rows.withColumn("copies", F.least(copies, F.lit(int(-(-most // 1)))).cast("int")).drop("_i", "rank")
