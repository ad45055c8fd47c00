"""Filters, searches and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factspark.functions import vocab

from .entities import block_rank, live, not_merged

NEWEST = [F.desc_nulls_first, F.desc_nulls_first]
ID_BLOCK = 65536


def contains_text(column: Column | str, q: str) -> Column:
    """Case-insensitive substring test, false for nulls."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.contains(F.lower(c), F.lit(q.lower())), F.lit(False))


def newest_first(date: str, created: str, key: str) -> list[Column]:
    """Newest first with undated rows on top, as the listings show them."""
    return [F.desc_nulls_first(date), F.desc_nulls_first(created), F.desc(key)]


def candidate_queue(assertion, entity, document, source, n: int = 200) -> DataFrame:
    """Claims awaiting review, the surest first."""
    head = (
        assertion.filter("status = 'candidate'")
        .orderBy(F.desc("confidence"), F.desc_nulls_first("observed_at"), "assertion_id")
        .limit(n)
    )
    docs = document.select("document_id", "source_id").join(source.select("source_id", F.col("name").alias("source")), "source_id", "left")
    return head.join(entity.select("entity_id", "canonical_name"), "entity_id").join(docs, "document_id", "left").select(
        "assertion_id", "entity_id", "canonical_name", "attribute_key", "value_num", "confidence", "observed_at", "source"
    )


def entity_search(entity, alias, q: str, n: int = 12) -> DataFrame:
    """Entities whose name or alias contains ``q``; nothing for fewer than two characters."""
    q = q.strip()
    shown = not_merged(entity).filter("entity_type <> 'geography'")
    if len(q) < 2:
        shown = shown.filter(F.lit(False))
    hits = alias.filter(contains_text("alias", q)).select("entity_id", F.lit(True).alias("alias_hit")).distinct()
    found = shown.join(hits, "entity_id", "left").filter(contains_text("canonical_name", q) | F.col("alias_hit").isNotNull())
    return found.orderBy("canonical_name", "entity_id").limit(n).select("entity_id", "canonical_name", "entity_type", "status")


def connections(event, participant, entity, q: str = "", entity_type: str = "", n: int = 200) -> DataFrame:
    """Newest events with participants, by name, title or type on either side."""
    names = entity.select("entity_id", "canonical_name", "entity_type")
    sides = participant.join(names, "entity_id").groupBy("event_id").agg(
        F.bool_or(contains_text("canonical_name", q)).alias("p_name"),
        F.bool_or(F.col("entity_type") == entity_type).alias("p_type"),
    )
    found = event.join(sides, "event_id").join(names, "entity_id")
    if q:
        found = found.filter(contains_text("canonical_name", q) | F.col("p_name") | contains_text("title", q))
    if entity_type:
        found = found.filter((F.col("entity_type") == entity_type) | F.col("p_type"))
    head = found.orderBy(F.desc("event_id")).limit(n).select("event_id", "entity_id", "title")
    listed = (
        participant.join(head.select("event_id"), "event_id", "left_semi")
        .join(names.select("entity_id", "canonical_name"), "entity_id")
        .groupBy("event_id")
        .agg(F.array_sort(F.collect_set("canonical_name")).alias("participants"))
    )
    return head.join(listed, "event_id")


def connection_counts(participant, entity) -> DataFrame:
    """Events that have participants, and the entity types in use."""
    return participant.agg(F.countDistinct("event_id").alias("n")).select(F.lit("events").alias("metric"), F.lit("").alias("key"), "n").unionByName(
        entity.groupBy(F.col("entity_type").alias("key")).agg(F.count("*").alias("n")).select(F.lit("entity_type").alias("metric"), "key", "n")
    )


def insights(event, fragment, entity, q: str = "", kind: str = "", n_events: int = 200, n_fragments: int = 100) -> DataFrame:
    """Publications, research grants and research fragments, newest first per kind."""
    names = entity.select("entity_id", "canonical_name")
    types = {"publications": ["publication"], "grants": ["research_grant"]}.get(kind, ["publication", "research_grant"])
    events = event.filter(F.col("event_type").isin(types))
    pieces = fragment.filter("category = 'research'")
    if q:
        events = events.join(names, "entity_id").filter(
            contains_text("canonical_name", q) | contains_text("title", q) | contains_text("description", q)
        )
        pieces = pieces.join(names, "entity_id").filter(contains_text("canonical_name", q) | contains_text("text", q))
    if kind in ("publications", "grants"):
        pieces = pieces.filter(F.lit(False))
    top_events = events.orderBy(*newest_first("date", "created_at", "event_id")).limit(n_events).select(
        F.col("event_type").alias("kind"), F.col("event_id").alias("id"), "entity_id", F.col("title").alias("label"), "date"
    )
    top_pieces = pieces.orderBy(*newest_first("date_of_information", "created_at", "fragment_id")).limit(n_fragments).select(
        F.lit("fragment").alias("kind"), F.col("fragment_id").alias("id"), "entity_id", F.col("text").alias("label"), F.col("date_of_information").alias("date")
    )
    return top_events.unionByName(top_pieces)


def insight_counts(event, fragment) -> DataFrame:
    e = event.filter(F.col("event_type").isin("publication", "research_grant")).groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))
    f = fragment.filter("category = 'research'").agg(F.count("*").alias("n")).select(F.lit("fragment").alias("kind"), "n")
    return e.unionByName(f)


def funding_events(event, entity, q: str = "", event_type: str = "", n: int = 300) -> DataFrame:
    """Newest funding events, optionally of one type and matching a text."""
    found = event.filter(F.col("event_type").isin(vocab.FUNDING_TYPES))
    if event_type:
        found = found.filter(F.col("event_type") == event_type)
    if q:
        found = found.join(entity.select("entity_id", "canonical_name"), "entity_id").filter(
            contains_text("canonical_name", q) | contains_text("title", q) | contains_text("description", q)
        )
    return found.orderBy(*newest_first("date", "created_at", "event_id")).limit(n).select(
        "event_id", "entity_id", "event_type", "date", "amount_usd"
    )


def calls_in_force(event: DataFrame, today: Column) -> DataFrame:
    """Calls neither marked closed nor past their deadline; unknown values stay."""
    not_closed = F.col("call_status").isNull() | (F.col("call_status") != "closed")
    not_past = F.col("date").isNull() | (F.col("date") >= today)
    return event.filter((F.col("event_type") == "grant_call") & not_closed & not_past)


def open_calls(event, today: Column, n: int = 30) -> DataFrame:
    head = calls_in_force(event, today).orderBy(*newest_first("date", "created_at", "event_id")).limit(n)
    return head.select("event_id", "entity_id", "date", "call_status", "call_url")


def recent_events(event, today: Column, past: int = 40, upcoming: int = 20, n: int = 14) -> DataFrame:
    """Events nearest to today, past ones first on ties."""
    cols = ["event_id", "date"]
    before = event.filter(F.col("date") <= today).orderBy(F.desc("date"), "event_id").limit(past)
    after = event.filter(F.col("date") > today).orderBy("date", "event_id").limit(upcoming)
    both = before.select(*cols, F.lit(0).alias("side")).unionByName(after.select(*cols, F.lit(1).alias("side")))
    return (
        both.withColumn("distance_days", F.abs(F.datediff("date", today)))
        .orderBy("distance_days", "side", "event_id")
        .limit(n)
        .drop("side")
    )


def recent_activity(entity, relation, run) -> DataFrame:
    """Newest entities, relations and runs."""
    e = not_merged(entity).orderBy(F.desc("created_at"), "entity_id").limit(10).select(
        F.lit("entity").alias("kind"), F.col("entity_id").alias("id"), F.col("created_at").alias("at"))
    r = relation.filter("superseded_at IS NULL").orderBy(F.desc("relation_id")).limit(8).select(
        F.lit("relation").alias("kind"), F.col("relation_id").cast("string").alias("id"), F.col("observed_at").alias("at"))
    u = run.orderBy(F.desc("started_at"), "run_id").limit(8).select(
        F.lit("run").alias("kind"), F.col("run_id").cast("string").alias("id"), F.col("started_at").alias("at"))
    return e.unionByName(r).unionByName(u)


def run_topic(run: DataFrame) -> DataFrame:
    return run.withColumn("topic", F.get_json_object("stats", "$.topic"))


def research_runs(run, entity, q: str = "", status: str = "", n: int = 150) -> DataFrame:
    """Newest runs with the entity their topic names; merged names lead to the survivor."""
    runs = run_topic(run)
    if q:
        runs = runs.filter(contains_text("topic", q))
    if status:
        runs = runs.filter(F.col("status") == status)
    head = runs.orderBy(F.desc("started_at"), "run_id").limit(n)
    wanted = head.select(F.lower("topic").alias("name")).distinct()
    named = entity.select("entity_id", "status", "redirects_to", F.lower("canonical_name").alias("name")).join(wanted, "name")
    resolved = named.groupBy("name").agg(
        F.coalesce(
            F.min(F.when(F.col("status").isin("active", "dormant"), F.col("entity_id"))),
            F.min(F.when(F.col("status") == "merged", F.col("redirects_to"))),
        ).alias("entity_id")
    )
    return head.withColumn("name", F.lower("topic")).join(resolved, "name", "left").select("run_id", "topic", "entity_id", "status")


def taxonomy_vocab(node, facets: list[str]) -> DataFrame:
    """Active vocabulary of the given facets."""
    return (
        node.filter((F.col("status") == "active") & (F.col("facet_status") == "active") & F.col("facet").isin(facets))
        .select("facet", "path", "label", F.substring("definition", 1, 120).alias("definition"))
        .orderBy("facet", "path")
    )


def seen_urls(document, assertion) -> DataFrame:
    """Distinct URLs of the documents behind each entity's claims."""
    backing = assertion.select("entity_id", "document_id").distinct()
    urls = document.filter("url <> ''").select("document_id", "url")
    return backing.join(urls, "document_id").select("entity_id", "url").distinct()


def seen_urls_recent(document, as_of: Column, days: int, n: int = 50) -> DataFrame:
    since = as_of - F.make_dt_interval(F.lit(days))
    return (
        document.filter((F.col("url") != "") & (F.col("fetched_at") >= since))
        .orderBy(F.desc("fetched_at"), "document_id")
        .limit(n)
        .select("document_id", "url")
    )


def stranded_candidates(assertion, as_of: Column, batch: int = 100) -> DataFrame:
    """Candidates one to twenty-four hours old, in numbered batches."""
    hour = lambda h: F.make_dt_interval(hours=F.lit(h))
    old = assertion.filter(
        (F.col("status") == "candidate") & (F.col("created_at") < as_of - hour(1)) & (F.col("created_at") >= as_of - hour(24))
    ).select("assertion_id", F.lit("adjudicate").alias("queue"))
    ranked = block_rank(old, ["queue"], "assertion_id", F.floor(F.col("assertion_id") / ID_BLOCK))
    return ranked.select("assertion_id", F.floor((F.col("rank") - 1) / batch).cast("long").alias("batch"))


def taxonomy_proposals(node, decisions) -> DataFrame:
    """Proposed nodes with the status a review decision gives them."""
    status = F.when(F.col("action") == "approve", "active").when(F.col("action") == "reject", "deprecated").otherwise("proposed")
    proposed = node.filter("status = 'proposed'").select("facet", "path", "label")
    return proposed.join(decisions, ["facet", "path"], "left").select("facet", "path", "label", status.alias("status")).orderBy("facet", "path")


def live_facts(assertion, with_candidates: bool = False) -> DataFrame:
    return live(assertion, with_candidates)
