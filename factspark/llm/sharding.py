"""Shards by weighted rendezvous hashing of stable record keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard (0, 1, ...) whose score for ``key`` is highest.

    Shard i scores -w / ln(u) with u a uniform hash of (key, i), so it wins with
    probability w over the sum of weights.  The score of a shard depends on no other
    shard: a shard that is added takes keys only into itself, one that is removed (or
    whose weight falls) loses only its own.  Ties go to the smaller number.  A null key
    is one key like any other.
    """
    if not weights or any(w < 0 for w in weights) or not any(weights):
        raise ValueError("weights are not negative, one at least is positive")
    text = F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("n"))
    scored = []
    for i, w in enumerate(weights):
        if w > 0:
            bits = F.shiftrightunsigned(F.xxhash64(text, F.lit(i)), 11).cast("double")
            score = F.lit(-float(w)) / F.log((bits + 0.5) / float(2**53))
            scored.append(F.struct(score.alias("score"), F.lit(-i).alias("shard")))
    return (-F.array_max(F.array(*scored))["shard"]).cast("int")


def shard_rows(rows: DataFrame, key: str, weights: list[float], joining: float | None = None) -> DataFrame:
    """Every row with its ``shard`` and its ``slot`` there, gapless from 0.

    ``grown_shard`` is the row's shard once a shard of weight ``joining`` is added (null
    without it).  The rows' columns, which must be groupable and not bear these three names,
    are kept; repeated rows each get a slot of their own, an empty table gives an empty one.
    """
    clash = {"shard", "grown_shard", "slot", "copies", "rank"} & set(rows.columns)
    if clash:
        raise ValueError(f"rename or drop {sorted(clash)} first")
    grown = F.lit(None).cast("int") if joining is None else rendezvous(F.col(key), [*weights, joining])
    placed = rows.withColumns({"shard": rendezvous(F.col(key), weights), "grown_shard": grown})
    ranked = numbered(placed, ["shard"], [])
    slot = F.explode(F.sequence(F.col("rank"), F.col("rank") + F.col("copies") - 1))
    return ranked.withColumn("slot", slot).drop("rank", "copies")


def shard_report(placed: DataFrame) -> DataFrame:
    """Rows per shard, and how many of them a grown set of shards would move."""
    moves = F.count_if(F.col("grown_shard") != F.col("shard"))
    return placed.groupBy("shard").agg(F.count("*").alias("n_rows"), moves.alias("n_moved"))
