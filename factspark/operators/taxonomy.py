"""Taxonomy growth: proposals checked against the vocabulary and against each other."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factspark.session import checkpointed

SAME_TEXT = 0.72
# a ratio of 0.72 needs the shorter text to have at least this share of the longer one
MIN_LENGTH_SHARE = SAME_TEXT / (2 - SAME_TEXT)


@F.pandas_udf(T.DoubleType())
def _text_ratio(new: pd.Series, old: pd.Series) -> pd.Series:
    def ratio(a, b):
        match = SequenceMatcher(None, a, b)
        # the two quick bounds spare most pairs the full comparison
        if match.real_quick_ratio() < SAME_TEXT or match.quick_ratio() < SAME_TEXT:
            return 0.0
        return match.ratio()

    return pd.Series([ratio(a, b) for a, b in zip(new, old)], dtype="float64")


def node_text(label: Column, definition: Column) -> Column:
    return F.lower(F.concat(label, F.lit(" "), F.coalesce(definition, F.lit(""))))


def _band(text: Column) -> Column:
    return F.floor(F.log(F.length(text).cast("double")) / F.lit(-1.0) / F.log(F.lit(MIN_LENGTH_SHARE)))


def similar_texts(new: DataFrame, old: DataFrame, extra: Column | None = None) -> DataFrame:
    """Pairs of one facet whose texts match by at least 0.72.

    ``new``: facet, new_id, new_text.  ``old``: facet, old_id, old_text.  Texts are joined
    on length bands, since a match bounds the difference in length.
    """
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    banded = new.withColumn("band", F.explode(F.transform(steps, lambda s: _band(F.col("new_text")) + s)))
    pairs = banded.join(old.withColumn("band", _band(F.col("old_text"))), ["facet", "band"])
    short, long = F.least(F.length("new_text"), F.length("old_text")), F.greatest(F.length("new_text"), F.length("old_text"))
    near = pairs.filter(short >= long * (MIN_LENGTH_SHARE - 1e-9))
    if extra is not None:
        near = near.filter(extra)
    return near.filter(_text_ratio("new_text", "old_text") >= SAME_TEXT).select("facet", "new_id", "old_id")


def node_text_similarity(proposals: DataFrame, node: DataFrame) -> DataFrame:
    """(pos, path) of proposals and the known nodes they repeat in other words."""
    new = proposals.select("facet", F.col("pos").alias("new_id"), node_text(F.col("label"), F.col("definition")).alias("new_text"))
    old = node.filter(F.col("status").isin("active", "proposed")).select("facet", F.col("path").alias("old_id"), node_text(F.col("label"), F.col("definition")).alias("old_text"))
    return similar_texts(new, old).select(F.col("new_id").alias("pos"), F.col("old_id").alias("path"))


def evolve_apply(proposals: DataFrame, node: DataFrame) -> DataFrame:
    """Outcome (added / altered / duplicate / skipped) of each proposal in ``pos`` order.

    ``proposals``: pos, op, facet, path, label, definition.  An addition is dropped when
    its path or its wording is taken, by the vocabulary or by an earlier addition.  Each
    round settles all additions without an open earlier rival.
    """
    clean = proposals.select(
        "pos", F.coalesce(F.lower(F.trim("op")), F.lit("add")).alias("op"), F.trim("facet").alias("facet"),
        F.replace(F.lower(F.trim("path")), F.lit(" "), F.lit("_")).alias("path"), F.trim("label").alias("label"), F.trim("definition").alias("definition"),
    )
    facets = node.filter("facet_status = 'active'").select("facet").distinct().withColumn("_facet", F.lit(True))
    taken = node.select("facet", "path", F.lit(True).alias("_taken"), (F.col("status") == "active").alias("_active"))
    seen = checkpointed(clean.join(facets, "facet", "left").join(taken, ["facet", "path"], "left"))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    invalid = blank("facet") | blank("path") | blank("label") | F.col("_facet").isNull()
    adds = seen.filter(~invalid & (F.col("op") != "alter") & F.col("_taken").isNull())
    known = node_text_similarity(adds, node).select("pos").distinct()
    worded = adds.join(known, "pos", "left_anti").withColumn("text", node_text(F.col("label"), F.col("definition")))
    # a later copy of the same path and wording shares the fate of the first one
    open_ = checkpointed(worded.groupBy("facet", "path", "text").agg(F.min("pos").alias("pos")))
    new = open_.select("facet", F.col("pos").alias("new_id"), F.col("text").alias("new_text"))
    old = open_.select("facet", F.col("pos").alias("old_id"), F.col("text").alias("old_text"))
    alike = similar_texts(new, old, F.col("old_id") < F.col("new_id")).select("new_id", "old_id")
    rivals = checkpointed(alike)
    waiting, added = open_.select("pos", "facet", "path"), None
    while not waiting.isEmpty():
        live = rivals.join(waiting.select(F.col("pos").alias("old_id")), "old_id", "left_semi").select(F.col("new_id").alias("pos"))
        head = waiting.groupBy("facet", "path").agg(F.min("pos").alias("pos"))
        now = checkpointed(head.join(live, "pos", "left_anti").select("pos", "facet", "path"))
        added = now if added is None else added.unionByName(now)
        beaten = rivals.join(now.select(F.col("pos").alias("old_id")), "old_id", "left_semi").select(F.col("new_id").alias("pos"))
        waiting = checkpointed(waiting.join(now, ["facet", "path"], "left_anti").join(beaten, "pos", "left_anti").select("pos", "facet", "path"))
    added = added if added is not None else waiting
    won = added.select("pos", F.lit(True).alias("_added"))
    fresh = added.groupBy("facet", "path").agg(F.min("pos").alias("_since"))
    judged = seen.join(won, "pos", "left").join(fresh, ["facet", "path"], "left")
    target = F.coalesce("_active", F.lit(False)) | F.coalesce(F.col("_since") < F.col("pos"), F.lit(False))
    outcome = (
        F.when(invalid, "skipped")
        .when(F.col("op") == "alter", F.when(target, "altered").otherwise("skipped"))
        .when(F.col("_added"), "added")
        .otherwise("duplicate")
    )
    return judged.select("pos", "facet", "path", "label", "definition", outcome.alias("outcome"))


def evolve_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"))
