"""Coverage gaps, research planning, neighbourhoods and locations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factspark.functions import names, vocab

from .entities import frame_of, live, not_merged, top_rows
from .reads import run_topic

ORG_TYPES = ["company", "investor", "entity", "university"]
SUPPLY_TYPES = ["company", "entity", "university", "facility"]
MIN_RELEVANCE = 50
NO_SUMMARY_TYPES = ["geography", "document_node"]


def ids(df: DataFrame, column: str = "entity_id") -> DataFrame:
    return df.select(F.col(column).alias("entity_id")).distinct()


def relevant(entity: DataFrame) -> DataFrame:
    return not_merged(entity).filter(F.col("space_relevance") >= MIN_RELEVANCE)


def in_force(assertion: DataFrame, *keys: str) -> DataFrame:
    """Claims of the given attributes that were not superseded, whatever their status."""
    return assertion.filter(F.col("superseded_at").isNull() & F.col("attribute_key").isin(*keys))


def narrowed_frame(mapping=vocab.REPORT_FRAME) -> Column:
    """Research frame; a company that is only adjacent to the field gets the narrow one."""
    frame = frame_of(F.col("entity_type"), mapping)
    return F.when((frame == "company") & (F.col("space_relevance") < 100), "space_angle").otherwise(frame)


def missing_events(entity, event, requests, as_of: Column) -> DataFrame:
    """Relevant entities without any event and not queued in the last two hours."""
    recent = requests.filter(F.col("queued_at") > as_of - F.make_dt_interval(hours=F.lit(2)))
    return (
        relevant(entity)
        .filter("entity_type <> 'geography'")
        .join(ids(event), "entity_id", "left_anti")
        .join(ids(recent), "entity_id", "left_anti")
        .select("entity_id", narrowed_frame().alias("frame"))
    )


def missing_location(entity, assertion) -> DataFrame:
    known = live(assertion).filter("attribute_key = 'headquarters_country'")
    return relevant(entity).filter(F.col("entity_type").isin(ORG_TYPES)).join(ids(known), "entity_id", "left_anti").select("entity_id")


def missing_address(entity, assertion) -> DataFrame:
    placed = live(assertion, True).filter(F.col("attribute_key").isin("headquarters_city", "headquarters_country"))
    return (
        relevant(entity)
        .filter(F.col("entity_type").isin([*ORG_TYPES, "facility"]))
        .join(ids(placed), "entity_id", "left_semi")
        .join(ids(in_force(assertion, "headquarters_address")), "entity_id", "left_anti")
        .select("entity_id")
    )


def missing_outputs(entity, assertion) -> DataFrame:
    wanted = not_merged(entity).filter((F.col("space_relevance") == 100) & F.col("entity_type").isin(SUPPLY_TYPES))
    return wanted.join(ids(in_force(assertion, "output")), "entity_id", "left_anti").select("entity_id")


def needs_tier(entity, assertion) -> DataFrame:
    """Entities with outputs that have no tier, or a tier of the retired vocabulary.

    One pass over the two attributes decides both conditions per entity.
    """
    retired = F.lit(False)
    for part in vocab.RETIRED_TIER_PARTS:
        retired = retired | F.coalesce(F.contains("value_text", F.lit(f".{part}.")), F.lit(False))
    key = F.col("attribute_key")
    flags = in_force(assertion, "output", "value_chain_tier").groupBy("entity_id").agg(
        F.bool_or(key == "output").alias("has_output"),
        F.bool_or(key == "value_chain_tier").alias("has_tier"),
        F.bool_or((key == "value_chain_tier") & retired).alias("has_retired"),
    )
    wanted = flags.filter(F.col("has_output") & (~F.col("has_tier") | F.col("has_retired")))
    kept = not_merged(entity).filter(F.col("entity_type").isin([*ORG_TYPES, "facility"]))
    return kept.join(wanted.select("entity_id"), "entity_id", "left_semi").select("entity_id")


def needs_assessment(entity, summary, event, fragment) -> DataFrame:
    """Entities without a summary, without a score, or with a summary older than their evidence."""
    shown = not_merged(entity).filter(~F.col("entity_type").isin(NO_SUMMARY_TYPES)).join(
        summary.select("entity_id", "source_count"), "entity_id", "left"
    )
    has_data = ids(event).union(ids(fragment)).distinct().withColumn("has_data", F.lit(True))
    flagged = shown.join(has_data, "entity_id", "left")
    unscored = F.col("space_relevance").isNull() & F.col("entity_type").isin(list(vocab.FACETS_FOR_TYPE))
    reasons = F.when(F.col("source_count").isNull(), F.array(F.lit("no_summary"))).otherwise(
        F.array_compact(
            F.array(
                F.when(unscored, "no_score"),
                F.when((F.col("source_count") == 0) & F.col("has_data").isNotNull(), "stale_summary"),
            )
        )
    )
    return flagged.select("entity_id", F.explode(reasons).alias("reason"))


def needs_classification(entity) -> DataFrame:
    return not_merged(entity).filter(
        F.col("space_relevance").isNull() & F.col("entity_type").isin(list(vocab.FACETS_FOR_TYPE))
    ).select("entity_id")


def needs_summary(entity, summary) -> DataFrame:
    wanted = not_merged(entity).filter(
        ~F.col("entity_type").isin("person", *NO_SUMMARY_TYPES)
        & (F.col("space_relevance").isNull() | (F.col("space_relevance") >= 20))
    )
    return wanted.join(ids(summary), "entity_id", "left_anti").select("entity_id")


def attribute_gaps(entity, attribute_def, assertion, n: int = 15) -> DataFrame:
    """First ``n`` attributes without an accepted claim, per entity.

    The vocabulary enters as one array value, so no entity x attribute product is built.
    """
    every = attribute_def.select(F.array_sort(F.collect_set("attribute_key"))).scalar()
    present = assertion.filter("status = 'accepted'").groupBy("entity_id").agg(F.collect_set("attribute_key").alias("present"))
    missing = F.array_except(every, F.coalesce("present", F.array().cast("array<string>")))
    return entity.join(present, "entity_id", "left").select(
        "entity_id", F.explode(F.slice(missing, 1, n)).alias("attribute_key")
    )


def entity_context(entity, assertion, event, fragment, relation, summary,
                   k_facts: int = 20, k_events: int = 8, k_relations: int = 10, k_lines: int = 15) -> DataFrame:
    """A short text per entity from its best facts, events, relations, fragment and overview.

    Every part is cut to its top rows first and all parts meet in one grouping.
    """
    value = F.coalesce(F.col("value_text"), F.col("value_num").cast("double").cast("string"), F.col("value_date").cast("string"), F.col("value_bool").cast("string"))

    facts = top_rows(
        assertion.filter("status = 'accepted'").select("entity_id", "confidence", "assertion_id", F.concat("attribute_key", F.lit("="), value).alias("text")),
        ["entity_id"], [F.desc("confidence"), F.col("assertion_id")], k_facts,
    ).select("entity_id", F.lit("1 fact").alias("section"), F.struct((-F.col("confidence")).cast("long").alias("a"), F.col("assertion_id").alias("b")).alias("pos"), "text")
    day = F.coalesce(F.date_format("date", "yyyy-MM"), F.lit("?"))
    events = top_rows(
        event.select("entity_id", "date", "event_id", F.concat(day, F.lit(": "), "title").alias("text")),
        ["entity_id"], [F.desc_nulls_first("date"), F.desc("event_id")], k_events,
    ).select("entity_id", F.lit("2 event").alias("section"), F.struct((-F.coalesce(F.unix_date("date"), F.lit(10**7))).cast("long").alias("a"), (-F.col("event_id")).alias("b")).alias("pos"), "text")
    names_ = entity.select("entity_id", "canonical_name")
    current = relation.filter("superseded_at IS NULL")
    out_edges = top_rows(current.select(F.col("subject_id").alias("entity_id"), "relation_id", "predicate", F.col("object_id").alias("other")), ["entity_id"], [F.col("relation_id")], k_relations)
    in_edges = top_rows(current.select(F.col("object_id").alias("entity_id"), "relation_id", "predicate", F.col("subject_id").alias("other")), ["entity_id"], [F.col("relation_id")], k_relations)
    edges = out_edges.withColumn("side", F.lit(0)).unionByName(in_edges.withColumn("side", F.lit(1)))
    edges = edges.join(names_.select(F.col("entity_id").alias("other"), "canonical_name"), "other")
    edges = top_rows(edges, ["entity_id"], [F.col("side"), F.col("relation_id")], k_lines)
    arrow = F.when(F.col("side") == 0, " -> ").otherwise(" <- ")
    relations = edges.select("entity_id", F.lit("3 relation").alias("section"), F.struct(F.col("side").cast("long").alias("a"), F.col("relation_id").alias("b")).alias("pos"), F.concat("predicate", arrow, "canonical_name").alias("text"))
    zero = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")).alias("pos")
    best = top_rows(fragment.select("entity_id", "confidence", "fragment_id", "text"), ["entity_id"], [F.desc("confidence"), F.col("fragment_id")])
    about = best.select("entity_id", F.lit("4 about").alias("section"), zero, F.substring("text", 1, 300).alias("text"))
    overview = summary.select("entity_id", F.lit("0 overview").alias("section"), zero, F.substring("overview", 1, 300).alias("text"))
    parts = facts.unionByName(events).unionByName(relations).unionByName(about).unionByName(overview).filter("text IS NOT NULL")
    merged = parts.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("section", "pos", "text"))).alias("lines"))
    body = F.array_join(F.transform("lines", lambda x: F.concat(F.substring(x["section"], 3, 20), F.lit(": "), x["text"])), "\n")
    return merged.select("entity_id", body.alias("context"))


def relation_endpoints(relation, entity) -> DataFrame:
    """Relations with names and types of both ends.

    Entities, one row per id, are hashed within a partition, so the relations are never sorted and nothing spills.
    """
    def side(prefix):
        ends = entity.select(F.col("entity_id").alias(f"{prefix}_id"), F.col("canonical_name").alias(f"{prefix}_name"), F.col("entity_type").alias(f"{prefix}_type"))
        return ends.hint("shuffle_hash")

    return relation.join(side("subject"), "subject_id").join(side("object"), "object_id")


def recent_topics(run, as_of: Column, days: int) -> DataFrame:
    since = as_of - F.make_dt_interval(F.lit(days))
    return run_topic(run).filter((F.col("started_at") >= since) & F.col("topic").isNotNull()).select("topic").distinct()


def recent_topics_anti(entity, run, as_of: Column, days: int = 7) -> DataFrame:
    """Entities whose name was not a research topic lately."""
    recent = recent_topics(run, as_of, days).withColumnRenamed("topic", "canonical_name")
    return entity.join(recent, "canonical_name", "left_anti")


def cooldown_filter(requests, run, as_of: Column, hours: int = 6) -> DataFrame:
    """Requests whose topic and frame were not completed within the cooldown."""
    since = as_of - F.make_dt_interval(hours=F.lit(hours))
    done = run_topic(run).filter((F.col("status") == "completed") & (F.col("started_at") >= since) & F.col("topic").isNotNull())
    done = done.select(F.lower("topic").alias("_topic"), F.col("task").alias("_task")).distinct()
    keyed = requests.withColumns({"_topic": F.lower("topic"), "_task": F.concat(F.lit("research_"), "frame")})
    return keyed.join(done, ["_topic", "_task"], "left_anti").drop("_topic", "_task")


def cascade_candidates(touched, entity, assertion, run, as_of: Column, depth: int, cap: int, frame: str) -> DataFrame:
    """Entities to research next after a run, those with the fewest accepted claims first."""
    if frame in ("end_user", "location") or depth + 1 > cap:
        touched = touched.filter(F.lit(False))
    found = relevant(entity).filter("entity_type <> 'geography'").join(ids(touched), "entity_id", "left_semi")
    counts = assertion.filter("status = 'accepted'").groupBy("entity_id").agg(F.count("*").alias("n"))
    fresh = recent_topics_anti(found, run, as_of).join(counts, "entity_id", "left")
    base = frame_of(F.col("entity_type"))
    off_field = ~names.keyword_relevance(F.col("canonical_name"), F.col("entity_type"))
    child = F.when((base == "company") & off_field, "space_angle").otherwise(base)
    return fresh.select("entity_id", child.alias("frame"), F.coalesce("n", F.lit(0)).alias("n_claims")).orderBy("n_claims", "entity_id")


def frame_alignment(requests, entity, alias) -> DataFrame:
    """Requests with the frame their entity asks for; cascades onto irrelevant entities are dropped.

    ``requests``: request_id, topic, frame, depth.  ``alias`` carries ``alias_norm``.
    """
    active = entity.filter("status = 'active'")
    zero = active.filter("space_relevance = 0").select(F.lower("canonical_name").alias("_name")).distinct()
    dive = (F.col("depth") > 0) & F.col("frame").isin("company", "asset", "space_angle", "research")
    keyed = requests.withColumns({"_name": F.lower("topic"), "_norm": names.normalize_name(F.col("topic"))})
    marked = keyed.join(zero.withColumn("_zero", F.lit(True)), "_name", "left")
    kept = marked.filter(~(dive & F.col("_zero").isNotNull()))
    assets = active.filter("entity_type = 'asset'")
    by_name = assets.select(F.lower("canonical_name").alias("_name")).distinct().withColumn("_asset_name", F.lit(True))
    by_alias = alias.join(assets.select("entity_id"), "entity_id", "left_semi").select(F.col("alias_norm").alias("_norm")).distinct().withColumn("_asset_alias", F.lit(True))
    known = kept.join(by_name, "_name", "left").join(by_alias, "_norm", "left")
    is_asset = F.col("_asset_name").isNotNull() | F.col("_asset_alias").isNotNull()
    frame = F.when((F.col("frame") == "company") & is_asset, "asset").otherwise(F.col("frame"))
    return known.select("request_id", "topic", frame.alias("frame"), "depth")


def first_value(assertion: DataFrame, key: str, name: str) -> DataFrame:
    """One non-empty text value per entity for an attribute (lowest claim id)."""
    kept = assertion.filter((F.col("attribute_key") == key) & (F.col("value_text") != ""))
    return kept.groupBy("entity_id").agg(F.min_by("value_text", "assertion_id").alias(name))


def office_points(relation: DataFrame, entity: DataFrame) -> DataFrame:
    """Office relations with the coordinates of their qualifier or else of their place."""
    places = entity.select(F.col("entity_id").alias("object_id"), F.col("canonical_name").alias("place"),
                           F.col("latitude").alias("place_lat"), F.col("longitude").alias("place_lon"))
    q = lambda key: F.get_json_object("qualifiers", f"$.{key}")
    number = lambda key: F.nullif(q(key).try_cast("double"), F.lit(0.0))
    offices = relation.filter("predicate = 'has_office_in' AND superseded_at IS NULL").join(places, "object_id")
    return offices.select(
        "relation_id",
        F.col("subject_id").alias("entity_id"),
        "place",
        F.coalesce(number("lat"), F.col("place_lat")).alias("lat"),
        F.coalesce(number("lon"), F.col("place_lon")).alias("lon"),
        F.coalesce((q("address") != "") & number("lat").isNotNull(), F.lit(False)).alias("has_address"),
        F.coalesce(q("office_type"), F.lit("office")).alias("office_type"),
    )


def city_points(entity: DataFrame) -> DataFrame:
    """One known point per geography name."""
    known = entity.filter("entity_type = 'geography' AND latitude IS NOT NULL")
    return known.groupBy(F.col("canonical_name").alias("city")).agg(
        F.min_by("latitude", "entity_id").alias("city_lat"), F.min_by("longitude", "entity_id").alias("city_lon")
    )


def map_markers(entity, assertion, relation) -> DataFrame:
    """One headquarters marker per located organisation and one marker per office."""
    facts = live(assertion, True)
    hq = first_value(facts, "headquarters_country", "country").join(first_value(facts, "headquarters_city", "city"), "entity_id", "left")
    offices = office_points(relation, entity)
    office = offices.filter("lat IS NOT NULL").groupBy("entity_id").agg(
        F.min_by(F.struct("lat", "lon", "has_address"), "relation_id").alias("o")
    )
    own = entity.select("entity_id", "latitude", "longitude", "has_street_address")
    placed = hq.join(own, "entity_id").join(office, "entity_id", "left").join(city_points(entity), "city", "left")
    has_own, has_office = F.col("latitude").isNotNull(), F.col("o").isNotNull()
    pick = lambda a, b, c: F.when(has_own, F.col(a)).when(has_office, F.col(b)).otherwise(F.col(c))
    headquarters = placed.select(
        "entity_id",
        F.coalesce("city", "country").alias("place"),
        pick("latitude", "o.lat", "city_lat").alias("lat"),
        pick("longitude", "o.lon", "city_lon").alias("lon"),
        F.when(has_own, F.coalesce("has_street_address", F.lit(False))).when(has_office, F.col("o.has_address")).otherwise(False).alias("has_address"),
        F.lit("headquarters").alias("office_type"),
    )
    known = entity.select("entity_id")
    return headquarters.unionByName(offices.join(known, "entity_id", "left_semi").drop("relation_id"))


def supply_neighbors(relation, entity, assertion, only: DataFrame | None = None) -> DataFrame:
    """Suppliers and customers of each entity, with what the other side makes and needs."""
    edges = relation.filter(F.col("superseded_at").isNull() & F.col("predicate").isin(vocab.SUPPLY_PREDICATES))
    product = F.coalesce(F.get_json_object("qualifiers", "$.product"), F.lit(""))
    both = edges.select(
        "relation_id", "predicate", product.alias("product"),
        F.explode(F.array(
            F.struct(F.col("object_id").alias("entity_id"), F.lit("upstream").alias("direction"), F.col("subject_id").alias("other_id")),
            F.struct(F.col("subject_id").alias("entity_id"), F.lit("downstream").alias("direction"), F.col("object_id").alias("other_id")),
        )).alias("e"),
    ).select("relation_id", "e.*", "predicate", "product")
    if only is not None:
        both = both.join(ids(only), "entity_id", "left_semi")
    key = F.col("attribute_key")
    wanted = live(assertion, True).filter(key.isin("value_chain_tier", "output", "input") & (F.col("value_text") != ""))
    values_of = lambda k, name: F.array_sort(F.collect_set(F.when(key == k, F.col("value_text")))).alias(name)
    profile = wanted.groupBy(F.col("entity_id").alias("other_id")).agg(
        values_of("value_chain_tier", "tiers"), values_of("output", "outputs"), values_of("input", "inputs")
    )
    other = entity.select(F.col("entity_id").alias("other_id"), F.col("canonical_name").alias("other_name"))
    return both.join(other, "other_id").join(profile, "other_id", "left")


def provenance_docs(assertion, document, source, n: int = 8) -> DataFrame:
    """Documents behind an entity, at most ``n`` each."""
    pairs = assertion.filter("document_id IS NOT NULL").select("entity_id", "document_id").distinct()
    head = top_rows(pairs, ["entity_id"], [F.col("document_id")], n)
    docs = document.select("document_id", "title", "url", "source_id").join(source.select("source_id", F.col("name").alias("source")), "source_id", "left")
    return head.join(docs, "document_id").select("entity_id", "document_id", "title", "url", "source")


def office_geocodes(relation, geocodes) -> DataFrame:
    """Coordinates for office relations that have an address but no point yet."""
    q = lambda key: F.get_json_object("qualifiers", f"$.{key}")
    open_ = relation.filter("predicate = 'has_office_in' AND superseded_at IS NULL").select(
        "relation_id", F.col("subject_id").alias("entity_id"), q("address").alias("query"), q("office_type").alias("office_type"), q("lat").alias("_lat")
    ).filter("coalesce(_lat, '') IN ('', '0') AND query <> ''").drop("_lat")
    return open_.join(geocodes, "query").select("relation_id", "entity_id", "office_type", "lat", "lon")


def coord_backfill(entity, relation, assertion, geocodes) -> DataFrame:
    """New coordinates per entity: office point, address, city centroid, or city and country.

    ``geocodes``: query, lat, lon.
    """
    office = office_geocodes(relation, geocodes).filter("office_type = 'hq'").groupBy("entity_id").agg(
        F.min_by(F.struct("lat", "lon"), "relation_id").alias("o")
    )
    current = assertion.filter("superseded_at IS NULL")
    facts = (
        first_value(current, "headquarters_address", "address")
        .join(first_value(live(assertion, True), "headquarters_city", "city"), "entity_id", "full_outer")
        .join(first_value(live(assertion, True), "headquarters_country", "country"), "entity_id", "full_outer")
    )
    open_ = entity.filter("latitude IS NULL").select("entity_id").join(office, "entity_id", "left").join(facts, "entity_id", "left")
    needed = open_.filter("o IS NOT NULL OR address IS NOT NULL OR city IS NOT NULL OR country IS NOT NULL")
    asked = needed.withColumn("query", geocode_query()).join(city_points(entity), "city", "left")
    point = asked.join(geocodes, "query", "left")
    by_city = F.col("address").isNull() & F.col("city_lat").isNotNull()
    lat = F.when(F.col("o").isNotNull(), F.col("o.lat")).when(by_city, F.col("city_lat")).otherwise(F.col("lat"))
    lon = F.when(F.col("o").isNotNull(), F.col("o.lon")).when(by_city, F.col("city_lon")).otherwise(F.col("lon"))
    return point.select(
        "entity_id", lat.alias("lat"), lon.alias("lon"), (F.col("o").isNotNull() | F.col("address").isNotNull()).alias("precise")
    ).filter("lat IS NOT NULL")


def geocode_query() -> Column:
    return F.coalesce(F.col("address"), F.nullif(F.concat_ws(", ", "city", "country"), F.lit("")))


def geocode_requests(entity, assertion, geocodes) -> DataFrame:
    """Location texts that still need a geocode."""
    current = assertion.filter("superseded_at IS NULL")
    facts = (
        first_value(current, "headquarters_address", "address")
        .join(first_value(live(assertion, True), "headquarters_city", "city"), "entity_id", "full_outer")
        .join(first_value(live(assertion, True), "headquarters_country", "country"), "entity_id", "full_outer")
    )
    open_ = entity.filter("latitude IS NULL").select("entity_id").join(facts, "entity_id")
    placed = city_points(entity).select("city", F.lit(True).alias("placed"))
    asked = open_.join(placed, "city", "left").filter("address IS NOT NULL OR placed IS NULL")
    queries = asked.select(geocode_query().alias("query")).filter("query IS NOT NULL").distinct()
    return queries.join(geocodes.select("query"), "query", "left_anti")
