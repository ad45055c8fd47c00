"""Aggregate reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factspark.functions import trust, values, vocab

from .entities import evidence, frame_of, head, live, not_merged, priced_calls, top_rows
from .gaps import MIN_RELEVANCE, first_value, ids, recent_topics_anti
from .reads import calls_in_force, contains_text, newest_first

TOTAL_KEY = "total_funding_usd"
REPORT_FUNDING = ["funding_round", "grant_award", "ipo", "spac", "debt_financing", "convertible", "crowdfunding", "research_grant"]
AWARD_TYPES = ["grant_award", "research_grant", "funding_round"]
SUPPLY_ENTITY_TYPES = ["company", "investor", "entity", "university", "facility"]


def entity_counts(entity) -> DataFrame:
    return entity.groupBy("entity_type", "status").agg(F.count("*").alias("n"))


def assertion_counts(assertion) -> DataFrame:
    return assertion.groupBy("status").agg(F.count("*").alias("n"))


def funding_total(assertion) -> DataFrame:
    return live(assertion).filter(F.col("attribute_key") == TOTAL_KEY).agg(
        F.coalesce(F.sum("value_num"), F.lit(0)).alias("total_usd"), F.count("*").alias("data_points")
    )


def facet_top_nodes(classification, node, k: int = 10) -> DataFrame:
    """Most used primary nodes per active facet."""
    active = node.filter("facet_status = 'active'").select("facet", "path")
    used = classification.filter("is_primary").join(active, ["facet", "path"], "left_semi")
    counts = used.groupBy("facet", "path").agg(F.countDistinct("entity_id").alias("n"))
    return top_rows(counts, ["facet"], [F.desc("n"), F.col("path")], k)


def cost_last_24h(calls, rates, entity, as_of: Column) -> DataFrame:
    """Calls and spend of the last day, with the size of the watch list."""
    since = as_of - F.make_dt_interval(F.lit(1))
    spent = priced_calls(calls.filter(F.col("called_at") >= since), rates).agg(
        F.count("*").alias("calls"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd")
    )
    watched = entity.agg(F.count_if("watchlist").alias("watchlist")).select("watchlist").scalar()
    return spent.withColumn("watchlist", watched)


def cost_report(calls, rates, as_of: Column, days: int = 30) -> DataFrame:
    """Calls, tokens and cost: overall, by task and by model, in one pass."""
    since = as_of - F.make_dt_interval(F.lit(days))
    priced = priced_calls(calls.filter(F.col("called_at") >= since), rates)
    by = priced.groupingSets([[], ["task"], ["model"]], "task", "model").agg(
        F.grouping_id().alias("g"),
        F.count("*").alias("calls"),
        F.sum(F.col("tokens_in").cast("long")).alias("tokens_in"),
        F.sum(F.col("tokens_out").cast("long")).alias("tokens_out"),
        F.sum("cost_usd").alias("cost_usd"),
    )
    level = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "task").otherwise("model")
    return by.select(level.alias("level"), F.coalesce("task", "model", F.lit("")).alias("key"), "calls", "tokens_in", "tokens_out", "cost_usd").orderBy("level", F.desc("cost_usd"), "key")


def dashboard_health(entity, summary, event, fragment, relation, assertion, as_of: Column) -> DataFrame:
    """(metric, key, value) rows of graph size, coverage, freshness and recent funding."""
    week = as_of - F.make_dt_interval(F.lit(7))
    month = F.to_date(as_of - F.make_dt_interval(F.lit(30)))
    kept = F.col("status") != "merged"
    wide = {
        "entity": entity.agg(
            F.count_if(kept).alias("active"),
            F.count_if(kept & F.col("space_relevance").isNotNull()).alias("scored"),
            F.count_if(kept & (F.col("created_at") >= week)).alias("new_entities"),
        ),
        "summary": summary.agg(F.count("*").alias("summarised")),
        "event": event.agg(
            F.count_if(F.col("created_at") >= week).alias("new_events"),
            F.count_if(F.col("event_type").isin(REPORT_FUNDING) & (F.col("date") >= month) & F.col("amount_usd").isNotNull()).alias("funding_30d_events"),
            F.coalesce(F.sum(F.when(F.col("event_type").isin(REPORT_FUNDING) & (F.col("date") >= month), F.col("amount_usd"))), F.lit(0)).alias("funding_30d_usd"),
        ),
        "fragment": fragment.agg(F.count_if(F.col("created_at") >= week).alias("new_fragments")),
        "relation": relation.agg(
            F.count_if(F.col("superseded_at").isNull()).alias("relations"),
            F.count_if(F.col("superseded_at").isNull() & (F.col("observed_at") >= week)).alias("new_relations"),
        ),
        "assertion": assertion.agg(F.count_if(F.col("status") == "candidate").alias("candidates")),
    }
    rows = None
    for part in wide.values():
        long = part.select([F.col(c).cast("double").alias(c) for c in part.columns]).unpivot([], part.columns, "metric", "value")
        rows = long if rows is None else rows.unionByName(long)
    rows = rows.withColumn("key", F.lit(""))
    share = rows.agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in ("active", "summarised", "scored")])
    percent = lambda m: F.coalesce(F.bround(F.lit(100) * F.col(m) / F.nullif("active", F.lit(0.0)), 0), F.lit(0.0))
    shares = share.select(percent("summarised").alias("summarised_pct"), percent("scored").alias("scored_pct"))
    shares = shares.unpivot([], shares.columns, "metric", "value").withColumn("key", F.lit(""))
    mix = entity.filter(kept & F.col("space_relevance").isNotNull()).groupBy("space_relevance").agg(F.count("*").cast("double").alias("value"))
    mix = mix.select(F.lit("relevance").alias("metric"), "value", F.col("space_relevance").cast("string").alias("key"))
    return rows.unionByName(shares).unionByName(mix).select("metric", "key", "value")


def run_totals(run) -> DataFrame:
    is_ = lambda s: F.count_if(F.col("status") == s).alias(s)
    return run.agg(F.count("*").alias("total"), is_("completed"), is_("failed"), is_("running"))


def node_entity_counts(node, classification) -> DataFrame:
    """Entities per node of the active facets, with the node's depth."""
    used = classification.groupBy("facet", "path").agg(F.countDistinct("entity_id").alias("n"))
    shown = node.filter("facet_status = 'active'").select("facet", "path")
    depth = F.length("path") - F.length(F.replace("path", F.lit("."), F.lit("")))
    return shown.join(used, ["facet", "path"], "left").select("facet", "path", depth.alias("depth"), F.coalesce("n", F.lit(0)).alias("n"))


def funding_type_counts(event) -> DataFrame:
    """Events per funding type; types without events count zero."""
    counts = [F.count_if(F.col("event_type") == k).alias(k) for k in vocab.FUNDING_TYPES]
    return event.agg(*counts).unpivot([], vocab.FUNDING_TYPES, "event_type", "n")


def top_investors(relation, entity, n: int = 10) -> DataFrame:
    deals = relation.filter("predicate = 'invested_in' AND superseded_at IS NULL").groupBy("subject_id").agg(F.count("*").alias("deals"))
    first = deals.orderBy(F.desc("deals"), "subject_id").limit(n)
    named = entity.select(F.col("entity_id").alias("subject_id"), "canonical_name")
    return first.join(named, "subject_id").select(F.col("subject_id").alias("entity_id"), "canonical_name", "deals")


def program_board(entity, relation, event, participant, fragment, today: Column, n: int = 60) -> DataFrame:
    """Active funding programmes with administrator, open calls, awards and best fragment."""
    first = entity.filter("entity_type = 'funding_program' AND status = 'active'").orderBy("canonical_name", "entity_id").limit(n).select("entity_id", "canonical_name")
    within = lambda df, column="entity_id": df.withColumn("entity_id", F.col(column)).join(first.select("entity_id"), "entity_id", "left_semi")
    admin = within(relation.filter("predicate = 'administers' AND superseded_at IS NULL"), "object_id").groupBy("entity_id").agg(F.min_by("subject_id", "relation_id").alias("administrator"))
    calls = top_rows(within(calls_in_force(event, today)), ["entity_id"], newest_first("date", "created_at", "event_id"), 3)
    calls = calls.groupBy("entity_id").agg(F.array_sort(F.collect_list("event_id")).alias("open_calls"))
    awarded = event.filter(F.col("event_type").isin(AWARD_TYPES)).select("event_id")
    awards = within(participant).join(awarded, "event_id").groupBy("entity_id").agg(F.count("*").alias("award_count"))
    best = within(fragment).groupBy("entity_id").agg(F.max_by("fragment_id", F.struct("confidence", -F.col("fragment_id"))).alias("fragment_id"))
    board = first.join(admin, "entity_id", "left").join(calls, "entity_id", "left").join(awards, "entity_id", "left").join(best, "entity_id", "left")
    board = board.withColumns({"open_calls": F.coalesce("open_calls", F.array().cast("array<long>")), "award_count": F.coalesce("award_count", F.lit(0))})
    return board.orderBy(F.desc(F.size("open_calls")), F.desc("award_count"), "canonical_name", "entity_id")


def source_counts(assertion) -> DataFrame:
    """Distinct documents behind each attribute of an entity."""
    return assertion.filter("superseded_at IS NULL").groupBy("entity_id", "attribute_key").agg(F.countDistinct("document_id").alias("n"))


def evidence_counts(assertion, fragment, event) -> DataFrame:
    return evidence(assertion, fragment, event).select("entity_id", "n")


def supply_degrees(relation) -> DataFrame:
    """Supply edges in and out per entity, in one grouping."""
    edges = relation.filter(F.col("superseded_at").isNull() & F.col("predicate").isin(vocab.SUPPLY_PREDICATES))
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("subject_id").alias("entity_id"), F.lit(1).alias("out")),
        F.struct(F.col("object_id").alias("entity_id"), F.lit(0).alias("out")),
    )).alias("e")).select("e.*")
    return ends.groupBy("entity_id").agg(F.count_if(F.col("out") == 0).alias("n_in"), F.count_if(F.col("out") == 1).alias("n_out"))


def supply_profiles(assertion) -> DataFrame:
    """Distinct tiers, outputs and inputs per entity that has any of them."""
    key = F.col("attribute_key")
    kept = live(assertion, True).filter(key.isin("value_chain_tier", "output", "input") & (F.col("value_text") != ""))
    of = lambda k, name: F.array_sort(F.collect_set(F.when(key == k, F.col("value_text")))).alias(name)
    return kept.groupBy("entity_id").agg(of("value_chain_tier", "tiers"), of("output", "outputs"), of("input", "inputs"))


def supply_lanes(entity, alias, assertion, relation, q: str = "", level: str = "", cat: str = "", n: int | None = None) -> DataFrame:
    """Entities per supply lane (of the first ``n`` by name); one without a known tier is pending."""
    profiles = supply_profiles(assertion)
    shown = entity.filter((F.col("status") == "active") & F.col("entity_type").isin(SUPPLY_ENTITY_TYPES)).join(profiles, "entity_id")
    if q:
        hits = ids(alias.filter(contains_text("alias", q))).withColumn("_hit", F.lit(True))
        shown = shown.join(hits, "entity_id", "left").filter(contains_text("canonical_name", q) | F.col("_hit").isNotNull())
    if level == "pending":
        shown = shown.filter(F.size("tiers") == 0)
    elif level:
        shown = shown.filter(F.exists("tiers", lambda p: F.coalesce(values.tier_level(p) == level, F.lit(False))))
    if cat:
        shown = shown.filter(F.exists("tiers", lambda p: contains_text(p, cat)))
    listed = head(shown, [F.col("canonical_name"), F.col("entity_id")], n).select("entity_id", "canonical_name", "tiers", "outputs", "inputs")
    country = first_value(live(assertion, True), "headquarters_country", "country")
    full = listed.join(country, "entity_id", "left").join(supply_degrees(relation), "entity_id", "left")
    levels = F.array_distinct(F.array_compact(F.transform("tiers", lambda p: values.tier_level(p))))
    lanes = F.when(F.size(levels) > 0, levels).otherwise(F.array(F.lit("pending")))
    return full.select(
        F.explode(lanes).alias("lane"), "entity_id", "canonical_name", "tiers", "outputs", "inputs",
        F.coalesce("country", F.lit("")).alias("country"),
        F.coalesce("n_in", F.lit(0)).alias("supply_in"), F.coalesce("n_out", F.lit(0)).alias("supply_out"),
    )


def lane_counts(lanes: DataFrame) -> DataFrame:
    every = [F.count_if(F.col("lane") == k).alias(k) for k in [*vocab.LEVELS, "pending"]]
    return lanes.agg(*every).unpivot([], [*vocab.LEVELS, "pending"], "lane", "n")


def tier_categories(assertion) -> DataFrame:
    """Second path parts in use."""
    parts = F.split("value_text", r"\.")
    tiers = live(assertion, True).filter("attribute_key = 'value_chain_tier' AND value_text <> ''")
    return tiers.filter((F.size(parts) >= 2) & F.element_at(parts, 1).isin(vocab.LEVELS)).select(F.element_at(parts, 2).alias("category")).distinct().orderBy("category")


def duplicate_events(event) -> DataFrame:
    return event.groupBy("entity_id", "event_type", "title", "date").agg(F.count("*").alias("n"), F.min("event_id").alias("oldest")).filter("n > 1")


def evidence_flag(entity, assertion, event, fragment) -> DataFrame:
    backed = ids(live(assertion)).union(ids(event)).union(ids(fragment)).distinct().withColumn("_has", F.lit(True))
    return entity.join(backed, "entity_id", "left").select("entity_id", F.col("_has").isNotNull().alias("has_evidence"))


def stale_entities(assertion, attribute_def, entity, run, as_of: Column, n: int | None = None, min_relevance: int = MIN_RELEVANCE) -> DataFrame:
    """Entities whose volatile facts are the longest past their window, with a sample."""
    windows = attribute_def.filter("volatility_days IS NOT NULL").select("attribute_key", F.when(F.col("volatility_days") == 0, trust.NO_WINDOW_DAYS).otherwise(F.col("volatility_days")).alias("window"))
    value = F.coalesce("value_text", F.col("value_num").cast("double").cast("string"), F.col("value_date").cast("string"), F.lit(""))
    aged = live(assertion).join(windows, "attribute_key").select(
        "entity_id", "assertion_id",
        (trust.whole_days(as_of, F.coalesce("valid_lower", "observed_at")) - F.col("window")).alias("excess_days"),
        F.concat("attribute_key", F.lit("="), value).alias("sample"),
    )
    worst = aged.filter("excess_days > 0").groupBy("entity_id").agg(
        F.max("excess_days").alias("excess_days"), F.max_by("sample", F.struct("excess_days", -F.col("assertion_id"))).alias("sample")
    )
    shown = not_merged(entity).filter(~F.col("entity_type").isin("geography", "document_node") & (F.col("space_relevance") >= min_relevance))
    found = recent_topics_anti(shown, run, as_of).join(worst, "entity_id")
    return head(found, [F.desc("excess_days"), F.col("entity_id")], n).select(
        "entity_id", "excess_days", "sample", frame_of(F.col("entity_type"), vocab.REPORT_FRAME).alias("frame")
    )


def stale_programs(entity, assertion, event, as_of: Column, days: int = 30) -> DataFrame:
    """Active funding programmes not observed lately or past their last deadline."""
    programs = entity.filter("entity_type = 'funding_program' AND status = 'active'").select("entity_id")
    seen = assertion.groupBy("entity_id").agg(F.max("observed_at").alias("last_observed"))
    calls = event.filter("event_type = 'grant_call' AND date IS NOT NULL").groupBy("entity_id").agg(F.max("date").alias("last_call"))
    stale = F.col("last_observed").isNull() | (F.col("last_observed") < as_of - F.make_dt_interval(F.lit(days)))
    passed = F.coalesce(F.col("last_call") < F.to_date(as_of), F.lit(False))
    return programs.join(seen, "entity_id", "left").join(calls, "entity_id", "left").select(
        "entity_id", stale.alias("stale"), passed.alias("deadline_passed")
    ).filter("stale OR deadline_passed")


def snapshot(entity, assertion, classification, node, calls, rates, as_of: Column) -> DataFrame:
    """All headline counts packed into one row of sorted maps."""
    part = lambda df, section, key, value: df.select(F.lit(section).alias("section"), key.alias("key"), value.cast("double").alias("value"))
    cost = cost_last_24h(calls, rates, entity, as_of).select(F.col("calls").cast("double"), F.col("cost_usd"), F.col("watchlist").cast("double"))
    total = funding_total(assertion).select(F.col("total_usd").cast("double").alias("total_usd"), F.col("data_points").cast("double"))
    n = F.col("n")
    rows = (
        part(entity_counts(entity), "entities", F.concat_ws("/", "entity_type", "status"), n)
        .unionByName(part(assertion_counts(assertion), "assertions", F.col("status"), n))
        .unionByName(part(facet_top_nodes(classification, node), "nodes", F.concat_ws("/", "facet", "path"), n))
        .unionByName(part(total.unpivot([], total.columns, "key", "value"), "funding", F.col("key"), F.col("value")))
        .unionByName(part(cost.unpivot([], cost.columns, "key", "value"), "cost", F.col("key"), F.col("value")))
    )
    packed = lambda s: F.array_sort(F.collect_list(F.when(F.col("section") == s, F.struct("key", "value")))).alias(s)
    return rows.agg(*[packed(s) for s in ("entities", "assertions", "nodes", "funding", "cost")])
