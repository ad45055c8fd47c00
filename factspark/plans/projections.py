"""Registered queries of the projections and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from factspark.operators import projections as proj
from factspark.session import scratch_folder
from factspark.sources.vocabulary import materialize, read_current

from .columns import at, CALL_SQL, EFFECTIVE_SQL, STALE_SQL, TRUST_SQL
from .gaps import LIVE2
from .reads import day, TODAY
from .registry import ORACLES, query
from .totals import LIVE

DBL = lambda df: df.withColumn("value_num", F.col("value_num").cast("double"))


@query(
    "entity_current_v1",
    f"""SELECT entity_id, attribute_key, assertion_id, CAST(value_num AS DOUBLE) AS value_num, confidence, canonical_name FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, attribute_key ORDER BY confidence DESC, observed_at DESC NULLS FIRST, assertion_id) AS rn
FROM x_assertion WHERE {LIVE}) r JOIN x_entity USING (entity_id) WHERE rn = 1""",
)
def _(t):
    return DBL(proj.entity_current_v1(t.x_assertion, t.x_entity)).select("entity_id", "attribute_key", "assertion_id", "value_num", "confidence", "canonical_name")


@query(
    "entity_current",
    f"""WITH r AS (SELECT a.*, coalesce(a.valid_lower, a.observed_at) AS valid_from, volatility_days, {EFFECTIVE_SQL} AS effective_confidence FROM x_assertion a LEFT JOIN x_attribute_def d USING (attribute_key) WHERE {LIVE})
SELECT entity_id, canonical_name, entity_type, attribute_key, assertion_id, CAST(value_num AS DOUBLE) AS value_num, confidence, effective_confidence, valid_from, volatility_days FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, attribute_key
 ORDER BY effective_confidence DESC, confidence DESC, valid_from DESC NULLS FIRST, observed_at DESC NULLS FIRST, assertion_id) AS rn FROM r) w JOIN x_entity e USING (entity_id) WHERE rn = 1""",
)
def _(t):
    best = proj.entity_current(t.x_assertion, t.x_entity, t.x_attribute_def, at())
    return DBL(best).select("entity_id", "canonical_name", "entity_type", "attribute_key", "assertion_id", "value_num", "confidence", "effective_confidence", "valid_from", "volatility_days")


@query(
    "relation_current",
    f"""SELECT subject_id, predicate, object_id, relation_id, confidence, s.canonical_name AS subject_name, o.canonical_name AS object_name FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, predicate, object_id ORDER BY confidence DESC, relation_id) AS rn
FROM x_relation WHERE {LIVE}) r JOIN x_entity s ON s.entity_id = subject_id JOIN x_entity o ON o.entity_id = object_id WHERE rn = 1""",
)
def _(t):
    return proj.relation_current(t.x_relation, t.x_entity).select("subject_id", "predicate", "object_id", "relation_id", "confidence", "subject_name", "object_name")


@query(
    "entity_facts",
    f"""SELECT entity_id, attribute_key, assertion_id, {TRUST_SQL} AS trust, days_stale, coalesce(source_count, 1) AS source_count FROM (SELECT *, {STALE_SQL} AS days_stale FROM (
 SELECT *, row_number() OVER (PARTITION BY entity_id, attribute_key ORDER BY confidence DESC, assertion_id) AS rn FROM x_assertion WHERE {LIVE}) a LEFT JOIN x_attribute_def USING (attribute_key) WHERE rn = 1) s
LEFT JOIN (SELECT entity_id, attribute_key, count(DISTINCT document_id) AS source_count FROM x_assertion WHERE superseded_at IS NULL GROUP BY ALL) c USING (entity_id, attribute_key)""",
)
def _(t):
    return proj.entity_facts(t.x_assertion, t.x_attribute_def, at()).select("entity_id", "attribute_key", "assertion_id", "trust", "days_stale", "source_count")


@query(
    "hq_fallback",
    f"""SELECT entity_id, max(value_text) FILTER (WHERE attribute_key = 'headquarters_city') AS city, max(value_text) FILTER (WHERE attribute_key = 'headquarters_country') AS country, max(value_text) FILTER (WHERE attribute_key = 'headquarters_address') AS address
FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, attribute_key ORDER BY CASE status WHEN 'accepted' THEN 0 ELSE 1 END, confidence DESC, assertion_id) AS rn FROM x_fact WHERE {LIVE2} AND attribute_key LIKE 'headquarters_%') r WHERE rn = 1 GROUP BY 1""",
)
def _(t):
    return proj.hq_fallback(t.x_fact)


TIMELINE = """t0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY date ASC NULLS LAST, created_at, event_id) AS pos FROM x_event) r WHERE pos <= 80),
 tl AS (SELECT e.entity_id, date, event_type, trim(lower(substr(e.title, 1, 80))) AS story, min(pos) AS pos, arg_min(event_id, pos) AS event_id, arg_min(e.title, pos) AS title,
  arg_max(description, {'l': length(description), 'p': -pos}) AS description, coalesce(string_agg(DISTINCT d.url, '|' ORDER BY d.url) FILTER (WHERE d.url <> ''), '') AS source_urls,
  arg_min(call_url, pos) FILTER (WHERE coalesce(call_url, '') <> '') AS call_url, arg_min(call_status, pos) FILTER (WHERE coalesce(call_status, '') <> '') AS call_status
  FROM t0 e LEFT JOIN x_document d ON d.document_id = e.source_document_id GROUP BY 1, 2, 3, 4)"""


@query(
    "timeline_merge",
    f"""WITH {TIMELINE}, pp AS (SELECT e.entity_id, date, event_type, trim(lower(substr(title, 1, 80))) AS story, string_agg(DISTINCT p.entity_id, '|' ORDER BY p.entity_id) AS participants FROM t0 e JOIN x_participant p USING (event_id) GROUP BY 1, 2, 3, 4)
SELECT tl.entity_id, tl.date, tl.event_type, event_id, title, description, source_urls, call_url, call_status, coalesce(participants, '') AS participants FROM tl LEFT JOIN pp ON pp.entity_id = tl.entity_id AND pp.date IS NOT DISTINCT FROM tl.date AND pp.event_type = tl.event_type AND pp.story = tl.story""",
)
def _(t):
    merged = proj.timeline_merge(t.x_event, t.x_participant, t.x_document)
    return merged.withColumns({c: F.array_join(c, "|") for c in ("source_urls", "participants")}).drop("pos")


@query(
    "active_calls",
    f"WITH {TIMELINE} SELECT event_id, entity_id, display_status FROM (SELECT *, {CALL_SQL.replace('2002-01-01', TODAY)} AS display_status FROM tl) q WHERE event_type = 'grant_call' AND display_status <> 'closed' AND entity_id IN (SELECT entity_id FROM x_entity WHERE entity_type = 'funding_program')",
)
def _(t):
    timeline = proj.timeline_merge(t.x_event, t.x_participant, t.x_document)
    return proj.active_calls(timeline, t.x_entity, day()).select("event_id", "entity_id", "display_status")


@query(
    "fragments_by_category",
    """SELECT entity_id, category, string_agg(fragment_id, ',' ORDER BY pos) AS fragments FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY category, date_of_information DESC NULLS FIRST, created_at DESC NULLS FIRST, fragment_id DESC) AS pos FROM x_fragment) f WHERE pos <= 80 GROUP BY 1, 2""",
)
def _(t):
    return proj.fragments_by_category(t.x_fragment).withColumn("fragments", F.array_join(F.col("fragments").cast("array<string>"), ","))


@query(
    "participant_events",
    "SELECT entity_id, event_id, date, title FROM (SELECT p.entity_id, event_id, date, title, row_number() OVER (PARTITION BY p.entity_id ORDER BY date DESC NULLS FIRST, created_at DESC NULLS FIRST, event_id DESC) AS rn FROM x_participant p JOIN x_event e USING (event_id)) q WHERE rn <= 20",
)
def _(t):
    return proj.participant_events(t.x_event, t.x_participant)


@query(
    "neighbor_relations",
    """SELECT entity_id, direction, relation_id, predicate, other_id, direction = 'out' AND predicate = 'has_office_in' AS is_office FROM (
 SELECT subject_id AS entity_id, 'out' AS direction, relation_id, predicate, object_id AS other_id, row_number() OVER (PARTITION BY subject_id ORDER BY predicate, relation_id) AS rn FROM x_relation WHERE superseded_at IS NULL
 UNION ALL SELECT object_id, 'in', relation_id, predicate, subject_id, row_number() OVER (PARTITION BY object_id ORDER BY predicate, relation_id) FROM x_relation WHERE superseded_at IS NULL) q WHERE rn <= 50""",
)
def _(t):
    return proj.neighbor_relations(t.x_relation)


@query(
    "active_classifications",
    "SELECT entity_id, classification_id, c.facet, c.path, label, CAST(weight AS DOUBLE) AS weight FROM x_classification c JOIN x_node n ON n.facet = c.facet AND n.path = c.path WHERE status = 'active' AND facet_status = 'active'",
)
def _(t):
    return proj.active_classifications(t.x_classification, t.x_node).withColumn("weight", F.col("weight").cast("double"))


@query("materialize", ORACLES["entity_current"])
def _(t):
    path = scratch_folder(t.spark, "projection")
    best = DBL(proj.entity_current(t.x_assertion, t.x_entity, t.x_attribute_def, at())).select("entity_id", "canonical_name", "entity_type", "attribute_key", "assertion_id", "value_num", "confidence", "effective_confidence", "valid_from", "volatility_days")
    materialize(best, path, ["entity_id", "attribute_key"], 1)
    return read_current(t.spark, path)
