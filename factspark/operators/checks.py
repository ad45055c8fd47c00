"""Data-quality reports in place of database constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factspark.sources.vocabulary import key_violations

from .entities import live

DAY_MICROS = 86_400_000_000
EARLIEST, LATEST = -(2**62), 2**62


def overlap_violations(assertion, attribute_def) -> DataFrame:
    """Live accepted claims that overlap an earlier-starting claim of the same attribute.

    ``conflicts_with`` is the earlier claim that lasts longest.  Claims are first reduced
    to one row per start time, then a running maximum is taken inside each day and over
    the days, so no task ever holds all claims of one key.
    """
    keys = ["entity_id", "attribute_key"]
    single = attribute_def.filter("cardinality = 'single'").select("attribute_key")
    spans = (
        live(assertion)
        .join(single, "attribute_key", "left_semi")
        .select(
            *keys, "assertion_id",
            F.coalesce(F.unix_micros("valid_lower"), F.lit(EARLIEST)).alias("lo"),
            F.coalesce(F.unix_micros("valid_upper"), F.lit(LATEST)).alias("hi"),
        )
        .filter("lo < hi")
    )
    longest = F.max(F.struct("hi", F.negative("assertion_id").alias("neg_id")))
    starts = spans.groupBy(*keys, "lo").agg(longest.alias("top"), F.min("assertion_id").alias("first_id"))
    starts = starts.withColumn("day", F.floor(F.col("lo") / DAY_MICROS))
    before_row = Window.partitionBy(*keys, "day").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    before_day = Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = starts.groupBy(*keys, "day").agg(F.max("top").alias("day_top"))
    days = days.withColumn("earlier_days", F.max("day_top").over(before_day)).drop("day_top")
    running = (
        starts.withColumn("same_day", F.max("top").over(before_row))
        .join(days, [*keys, "day"])
        .select(*keys, "lo", "first_id", F.greatest("same_day", "earlier_days").alias("prior"))
    )
    reached = F.coalesce(F.col("prior.hi") > F.col("lo"), F.lit(False))
    return (
        spans.join(running, [*keys, "lo"])
        .filter(reached | (F.col("assertion_id") > F.col("first_id")))
        .select(*keys, "assertion_id", F.when(reached, -F.col("prior.neg_id")).otherwise(F.col("first_id")).alias("conflicts_with"))
    )


def unsourced_extractions(assertion) -> DataFrame:
    """Extracted claims without a document or a quote."""
    return assertion.filter((F.col("method") == "extracted") & (F.col("document_id").isNull() | F.col("quote").isNull()))


def event_key_violations(event) -> DataFrame:
    """Events repeated with the same entity, type, date and positive amount."""
    return key_violations(event.filter("amount_usd > 0"), ["entity_id", "event_type", "date", "amount_usd"])


unique_key_violations = key_violations
