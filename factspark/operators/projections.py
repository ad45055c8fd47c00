"""Best-value projections and per-entity profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factspark.functions import trust, values

from .entities import live, top_rows
from .totals import source_counts

TIMELINE_ROWS = 80


def entity_current_v1(assertion, entity) -> DataFrame:
    """Best live accepted claim per entity and attribute by stored confidence."""
    best = top_rows(live(assertion), ["entity_id", "attribute_key"], [F.desc("confidence"), F.desc_nulls_first("observed_at"), F.col("assertion_id")])
    return best.join(entity.select("entity_id", "canonical_name", "entity_type"), "entity_id")


def entity_current(assertion, entity, attribute_def, as_of: Column) -> DataFrame:
    """Best live accepted claim per entity and attribute after decay.

    Claims are ranked before the entity join, so only winners are joined, and the rank
    limit cuts every map task to one row per key before the shuffle.
    """
    windows = attribute_def.select("attribute_key", "volatility_days")
    scored = live(assertion).join(windows, "attribute_key", "left").withColumn("valid_from", F.coalesce("valid_lower", "observed_at"))
    scored = scored.withColumn(
        "effective_confidence", trust.effective_confidence(F.col("confidence"), F.col("valid_from"), F.col("volatility_days"), as_of)
    )
    order = [F.desc("effective_confidence"), F.desc("confidence"), F.desc_nulls_first("valid_from"), F.desc_nulls_first("observed_at"), F.col("assertion_id")]
    best = top_rows(scored, ["entity_id", "attribute_key"], order)
    return best.join(entity.select("entity_id", "canonical_name", "entity_type"), "entity_id")


def relation_current(relation, entity) -> DataFrame:
    """Best live accepted relation per subject, predicate and object, with both names."""
    best = top_rows(live(relation), ["subject_id", "predicate", "object_id"], [F.desc("confidence"), F.col("relation_id")])
    name = lambda side: entity.select(F.col("entity_id").alias(f"{side}_id"), F.col("canonical_name").alias(f"{side}_name"))
    return best.join(name("subject"), "subject_id").join(name("object"), "object_id")


def with_trust(facts: DataFrame, attribute_def: DataFrame, as_of: Column) -> DataFrame:
    anchor = F.coalesce("valid_lower", "observed_at")
    window = F.col("volatility_days")
    return facts.join(attribute_def.select("attribute_key", "volatility_days"), "attribute_key", "left").withColumns(
        {"trust": trust.display_trust(F.col("confidence"), anchor, window, as_of), "days_stale": trust.days_stale(anchor, window, as_of)}
    )


def entity_facts(assertion, attribute_def, as_of: Column) -> DataFrame:
    """Best accepted claim per attribute with decayed trust, staleness and source count."""
    best = top_rows(live(assertion), ["entity_id", "attribute_key"], [F.desc("confidence"), F.col("assertion_id")])
    sources = source_counts(assertion).withColumnRenamed("n", "source_count")
    return with_trust(best, attribute_def, as_of).join(sources, ["entity_id", "attribute_key"], "left").withColumn(
        "source_count", F.coalesce("source_count", F.lit(1))
    )


def hq_fallback(assertion) -> DataFrame:
    """Location values per entity: the best accepted claim, else the best candidate."""
    keys = ["headquarters_city", "headquarters_country", "headquarters_address"]
    place = live(assertion, True).filter(F.col("attribute_key").isin(keys))
    best = top_rows(place, ["entity_id", "attribute_key"], [F.when(F.col("status") == "accepted", 0).otherwise(1), F.desc("confidence"), F.col("assertion_id")])
    pick = lambda k: F.max(F.when(F.col("attribute_key") == k, F.col("value_text"))).alias(k.replace("headquarters_", ""))
    return best.groupBy("entity_id").agg(*[pick(k) for k in keys])


def timeline_merge(event, participant, document) -> DataFrame:
    """First events of an entity, one row per story, with all sources and participants."""
    order = [F.asc_nulls_last("date"), F.asc_nulls_last("created_at"), F.col("event_id")]
    window = Window.partitionBy("entity_id").orderBy(*order)
    head = event.withColumn("pos", F.row_number().over(window)).filter(F.col("pos") <= TIMELINE_ROWS)
    story = F.trim(F.lower(F.substring("title", 1, 80)))
    urls = document.select(F.col("document_id").alias("source_document_id"), F.col("url").alias("source_url"))
    listed = head.withColumn("story", story).join(urls, "source_document_id", "left")
    keys = ["entity_id", "date", "event_type", "story"]
    first_set = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("pos")))
    merged = listed.groupBy(*keys).agg(
        F.min("pos").alias("pos"),
        F.min_by("event_id", "pos").alias("event_id"),
        F.min_by("title", "pos").alias("title"),
        F.max_by("description", F.struct(F.length("description"), -F.col("pos"))).alias("description"),
        F.array_sort(F.collect_set(F.when(F.col("source_url") != "", F.col("source_url")))).alias("source_urls"),
        first_set("call_url").alias("call_url"),
        first_set("call_status").alias("call_status"),
    )
    people = listed.select(*keys, "event_id").join(participant.select("event_id", F.col("entity_id").alias("participant_id")), "event_id")
    joined = people.groupBy(*keys).agg(F.array_sort(F.collect_set("participant_id")).alias("participants"))
    same = [F.col(f"m.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys]
    out = merged.alias("m").join(joined.alias("p"), same, "left")
    return out.select("m.*", F.coalesce("p.participants", F.array().cast("array<string>")).alias("participants")).drop("story")


def active_calls(timeline: DataFrame, entity: DataFrame, today: Column) -> DataFrame:
    """Calls of funding programmes that are not closed."""
    programs = entity.filter("entity_type = 'funding_program'").select("entity_id")
    status = values.call_status(F.col("event_type"), F.col("date"), F.col("call_status"), today)
    calls = timeline.filter("event_type = 'grant_call'").withColumn("display_status", status)
    return calls.filter("display_status <> 'closed'").join(programs, "entity_id", "left_semi")


def fragments_by_category(fragment) -> DataFrame:
    """The leading fragments of an entity, listed per category."""
    order = [F.col("category"), F.desc_nulls_first("date_of_information"), F.desc_nulls_first("created_at"), F.desc("fragment_id")]
    window = Window.partitionBy("entity_id").orderBy(*order)
    head = fragment.withColumn("pos", F.row_number().over(window)).filter(F.col("pos") <= TIMELINE_ROWS)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "fragment_id"))), lambda x: x["fragment_id"])
    return head.groupBy("entity_id", "category").agg(listed.alias("fragments"))


def participant_events(event, participant, n: int = 20) -> DataFrame:
    """Newest events in which an entity only takes part."""
    dated = event.select("event_id", "date", "created_at", "title")
    order = [F.desc_nulls_first("date"), F.desc_nulls_first("created_at"), F.desc("event_id")]
    return top_rows(participant.join(dated, "event_id"), ["entity_id"], order, n).select("entity_id", "event_id", "date", "title")


def neighbor_relations(relation, n: int = 50) -> DataFrame:
    """Outgoing and incoming relations of an entity, at most ``n`` each, offices marked."""
    current = relation.filter("superseded_at IS NULL")
    side = lambda own, other, name: top_rows(
        current.select(F.col(own).alias("entity_id"), F.lit(name).alias("direction"), "relation_id", "predicate", F.col(other).alias("other_id")),
        ["entity_id"], [F.col("predicate"), F.col("relation_id")], n,
    )
    both = side("subject_id", "object_id", "out").unionByName(side("object_id", "subject_id", "in"))
    return both.withColumn("is_office", (F.col("direction") == "out") & (F.col("predicate") == "has_office_in"))


def active_classifications(classification, node) -> DataFrame:
    """Memberships in active nodes of active facets."""
    active = node.filter("status = 'active' AND facet_status = 'active'").select("facet", "path", "label")
    return classification.join(active, ["facet", "path"]).select("entity_id", "classification_id", "facet", "path", "label", "weight")
