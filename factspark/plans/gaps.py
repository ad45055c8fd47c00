"""Registered queries of gaps, planning, neighbourhoods and locations."""

from __future__ import annotations

from pyspark.sql import functions as F

from factspark.functions import names, vocab
from factspark.operators import gaps
from factspark.sources.tables import LEDGER_AS_OF

from .columns import _sql_any, sql_case_map, sql_list, sql_norm
from .registry import query

def now():
    return F.lit(LEDGER_AS_OF).cast("timestamp")
FRAME = f"coalesce({sql_case_map('entity_type', vocab.RESEARCH_FRAME)}, 'company')"
REPORT = f"coalesce({sql_case_map('entity_type', vocab.REPORT_FRAME)}, 'company')"
ORG = sql_list(gaps.ORG_TYPES)


@query(
    "missing_events",
    f"""SELECT entity_id, CASE WHEN {REPORT} = 'company' AND space_relevance < 100 THEN 'space_angle' ELSE {REPORT} END AS frame FROM x_entity
WHERE status <> 'merged' AND entity_type <> 'geography' AND space_relevance >= 50 AND entity_id NOT IN (SELECT entity_id FROM x_event)
 AND entity_id NOT IN (SELECT entity_id FROM x_call WHERE called_at > TIMESTAMP '{LEDGER_AS_OF}' - INTERVAL 2 HOUR)""",
)
def _(t):
    queued = t.x_call.select("entity_id", F.col("called_at").alias("queued_at"))
    return gaps.missing_events(t.x_entity, t.x_event, queued, now())


REL = "status <> 'merged' AND space_relevance >= 50"


@query(
    "missing_location",
    f"SELECT entity_id FROM x_entity WHERE {REL} AND entity_type IN ({ORG}) AND entity_id NOT IN (SELECT entity_id FROM x_fact WHERE attribute_key = 'headquarters_country' AND status = 'accepted' AND superseded_at IS NULL)",
)
def _(t):
    return gaps.missing_location(t.x_entity, t.x_fact)


@query(
    "missing_address",
    f"""SELECT entity_id FROM x_entity WHERE {REL} AND entity_type IN ({ORG}, 'facility') AND entity_id IN (SELECT entity_id FROM x_fact WHERE attribute_key IN ('headquarters_city', 'headquarters_country') AND status IN ('accepted', 'candidate') AND superseded_at IS NULL)
 AND entity_id NOT IN (SELECT entity_id FROM x_fact WHERE attribute_key = 'headquarters_address' AND superseded_at IS NULL)""",
)
def _(t):
    return gaps.missing_address(t.x_entity, t.x_fact)


@query(
    "missing_outputs",
    "SELECT entity_id FROM x_entity WHERE status <> 'merged' AND space_relevance = 100 AND entity_type IN ('company', 'entity', 'university', 'facility') AND entity_id NOT IN (SELECT entity_id FROM x_fact WHERE attribute_key = 'output' AND superseded_at IS NULL)",
)
def _(t):
    return gaps.missing_outputs(t.x_entity, t.x_fact)


@query(
    "needs_tier",
    f"""WITH o AS (SELECT DISTINCT entity_id FROM x_fact WHERE attribute_key = 'output' AND superseded_at IS NULL),
 tt AS (SELECT entity_id, value_text FROM x_fact WHERE attribute_key = 'value_chain_tier' AND superseded_at IS NULL),
 w AS ((SELECT entity_id FROM o EXCEPT SELECT entity_id FROM tt) UNION (SELECT entity_id FROM o INTERSECT SELECT entity_id FROM tt WHERE {_sql_any('value_text', ['.' + p + '.' for p in vocab.RETIRED_TIER_PARTS])}))
SELECT entity_id FROM x_entity WHERE status <> 'merged' AND entity_type IN ({ORG}, 'facility') AND entity_id IN (SELECT entity_id FROM w)""",
)
def _(t):
    return gaps.needs_tier(t.x_entity, t.x_fact)


@query(
    "needs_assessment",
    f"""WITH e AS (SELECT * FROM x_entity WHERE status <> 'merged' AND entity_type NOT IN ('geography', 'document_node')),
 a AS (SELECT entity_id FROM e WHERE entity_id NOT IN (SELECT entity_id FROM x_summary))
SELECT entity_id, 'no_summary' AS reason FROM a UNION ALL
SELECT entity_id, 'no_score' FROM e WHERE space_relevance IS NULL AND entity_type IN ({sql_list(vocab.FACETS_FOR_TYPE)}) AND entity_id NOT IN (SELECT entity_id FROM a) UNION ALL
SELECT entity_id, 'stale_summary' FROM e WHERE entity_id IN (SELECT entity_id FROM x_summary WHERE source_count = 0) AND (entity_id IN (SELECT entity_id FROM x_event) OR entity_id IN (SELECT entity_id FROM x_fragment)) AND entity_id NOT IN (SELECT entity_id FROM a)""",
)
def _(t):
    return gaps.needs_assessment(t.x_entity, t.x_summary, t.x_event, t.x_fragment)


@query("needs_classification", f"SELECT entity_id FROM x_entity WHERE status <> 'merged' AND space_relevance IS NULL AND entity_type IN ({sql_list(vocab.FACETS_FOR_TYPE)})")
def _(t):
    return gaps.needs_classification(t.x_entity)


@query(
    "needs_summary",
    "SELECT entity_id FROM x_entity WHERE status <> 'merged' AND entity_type NOT IN ('person', 'geography', 'document_node') AND (space_relevance IS NULL OR space_relevance >= 20) AND entity_id NOT IN (SELECT entity_id FROM x_summary)",
)
def _(t):
    return gaps.needs_summary(t.x_entity, t.x_summary)


@query(
    "attribute_gaps",
    """SELECT entity_id, attribute_key FROM (SELECT e.entity_id, d.attribute_key, row_number() OVER (PARTITION BY e.entity_id ORDER BY d.attribute_key) AS rn
 FROM x_entity e CROSS JOIN x_attribute_def d WHERE NOT EXISTS (SELECT 1 FROM x_assertion a WHERE a.entity_id = e.entity_id AND a.attribute_key = d.attribute_key AND a.status = 'accepted')) g WHERE rn <= 3""",
)
def _(t):
    return gaps.attribute_gaps(t.x_entity, t.x_attribute_def, t.x_assertion, n=3)


@query(
    "entity_context",
    """WITH p AS (
 SELECT entity_id, 0 AS s, 0 AS a, 0 AS b, 'overview: ' || substr(overview, 1, 300) AS txt FROM x_summary
 UNION ALL SELECT entity_id, 1, rn, 0, 'fact: ' || attribute_key || '=' || CAST(CAST(value_num AS DOUBLE) AS VARCHAR) FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY confidence DESC, assertion_id) AS rn FROM x_assertion WHERE status = 'accepted') f WHERE rn <= 20
 UNION ALL SELECT entity_id, 2, rn, 0, 'event: ' || coalesce(strftime(date, '%Y-%m'), '?') || ': ' || title FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY date DESC NULLS FIRST, event_id DESC) AS rn FROM x_event) f WHERE rn <= 8
 UNION ALL SELECT entity_id, 3, rn, 0, txt FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY side, relation_id) AS rn FROM (
   SELECT r.entity_id, side, relation_id, 'relation: ' || predicate || CASE side WHEN 0 THEN ' -> ' ELSE ' <- ' END || canonical_name AS txt FROM (
    SELECT subject_id AS entity_id, 0 AS side, relation_id, predicate, object_id AS other, row_number() OVER (PARTITION BY subject_id ORDER BY relation_id) AS k FROM x_relation WHERE superseded_at IS NULL
    UNION ALL SELECT object_id, 1, relation_id, predicate, subject_id, row_number() OVER (PARTITION BY object_id ORDER BY relation_id) FROM x_relation WHERE superseded_at IS NULL) r JOIN x_entity e ON e.entity_id = r.other WHERE k <= 10) r2) r3 WHERE rn <= 15
 UNION ALL SELECT entity_id, 4, 0, 0, 'about: ' || substr(text, 1, 300) FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY confidence DESC, fragment_id) AS rn FROM x_fragment) f WHERE rn = 1)
SELECT entity_id, string_agg(txt, chr(10) ORDER BY s, a, b) AS context FROM p GROUP BY entity_id""",
)
def _(t):
    return gaps.entity_context(t.x_entity, t.x_assertion, t.x_event, t.x_fragment, t.x_relation, t.x_summary)


@query(
    "relation_endpoints",
    "SELECT relation_id, s.canonical_name AS subject_name, s.entity_type AS subject_type, o.canonical_name AS object_name, o.entity_type AS object_type FROM x_relation JOIN x_entity s ON s.entity_id = subject_id JOIN x_entity o ON o.entity_id = object_id",
)
def _(t):
    return gaps.relation_endpoints(t.x_relation, t.x_entity).select("relation_id", "subject_name", "subject_type", "object_name", "object_type")


RECENT = f"SELECT stats->>'$.topic' FROM x_run WHERE started_at >= TIMESTAMP '{LEDGER_AS_OF}' - INTERVAL 7 DAY AND stats->>'$.topic' IS NOT NULL"


@query("recent_topics_anti", f"SELECT entity_id FROM x_entity WHERE canonical_name NOT IN ({RECENT})")
def _(t):
    return gaps.recent_topics_anti(t.x_entity, t.x_run, now()).select("entity_id")


@query(
    "cooldown_filter",
    f"""SELECT c_custkey AS request_id FROM customer WHERE (lower(c_name), CASE c_custkey % 3 WHEN 0 THEN 'research_company' WHEN 1 THEN 'research_question' ELSE 'research_person' END) NOT IN (
 SELECT (lower(stats->>'$.topic'), task) FROM x_run WHERE status = 'completed' AND started_at >= TIMESTAMP '2024-01-25' - INTERVAL 6 HOUR AND stats->>'$.topic' IS NOT NULL)""",
)
def _(t):
    frame = F.expr("CASE c_custkey % 3 WHEN 0 THEN 'company' WHEN 1 THEN 'question' ELSE 'person' END")
    requests = t.customer.select(F.col("c_custkey").alias("request_id"), F.col("c_name").alias("topic"), frame.alias("frame"))
    return gaps.cooldown_filter(requests, t.x_run, F.lit("2024-01-25").cast("timestamp")).select("request_id")


@query(
    "cascade_candidates",
    f"""SELECT entity_id, CASE WHEN {FRAME} = 'company' AND NOT (entity_type IN ({sql_list(vocab.ALWAYS_RELEVANT_TYPES)}) OR {_sql_any('lower(canonical_name)', vocab.FIELD_WORDS)} OR NOT {_sql_any('lower(canonical_name)', vocab.OFF_FIELD_WORDS)}) THEN 'space_angle' ELSE {FRAME} END AS frame,
 coalesce(n, 0) AS n_claims FROM x_entity LEFT JOIN (SELECT entity_id, count(*) AS n FROM x_assertion WHERE status = 'accepted' GROUP BY 1) a USING (entity_id)
WHERE {REL} AND entity_type <> 'geography' AND entity_id IN (SELECT entity_id FROM x_participant) AND canonical_name NOT IN ({RECENT})""",
)
def _(t):
    return gaps.cascade_candidates(t.x_participant, t.x_entity, t.x_assertion, t.x_run, now(), depth=0, cap=2, frame="company")


@query(
    "frame_alignment",
    f"""WITH r AS (SELECT c_custkey AS request_id, CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) ELSE alias END AS topic, CASE c_custkey % 3 WHEN 0 THEN 'company' WHEN 1 THEN 'question' ELSE 'asset' END AS frame, CAST(c_custkey % 2 AS INT) AS depth FROM customer JOIN x_alias ON entity_id = concat('C', c_custkey)),
 z AS (SELECT lower(canonical_name) AS n FROM x_entity WHERE status = 'active' AND space_relevance = 0),
 s AS (SELECT entity_id, lower(canonical_name) AS n FROM x_entity WHERE status = 'active' AND entity_type = 'asset')
SELECT request_id, topic, CASE WHEN frame = 'company' AND (lower(topic) IN (SELECT n FROM s) OR {sql_norm('topic')} IN (SELECT {sql_norm('alias')} FROM x_alias JOIN s USING (entity_id))) THEN 'asset' ELSE frame END AS frame, depth
FROM r WHERE NOT (depth > 0 AND frame IN ('company', 'asset', 'space_angle', 'research') AND lower(topic) IN (SELECT n FROM z))""",
)
def _(t):
    alias = t.x_alias.withColumn("alias_norm", names.normalize_name(F.col("alias")))
    base = t.customer.withColumn("entity_id", F.concat(F.lit("C"), "c_custkey")).join(t.x_alias, "entity_id")
    requests = base.select(
        F.col("c_custkey").alias("request_id"),
        F.expr("CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) ELSE alias END").alias("topic"),
        F.expr("CASE c_custkey % 3 WHEN 0 THEN 'company' WHEN 1 THEN 'question' ELSE 'asset' END").alias("frame"),
        (F.col("c_custkey") % 2).cast("int").alias("depth"),
    )
    return gaps.frame_alignment(requests, t.x_entity, alias)


LIVE2 = "status IN ('accepted', 'candidate') AND superseded_at IS NULL"
OFFICE = """SELECT relation_id, subject_id AS entity_id, canonical_name AS place, coalesce(nullif(TRY_CAST(qualifiers->>'$.lat' AS DOUBLE), 0), latitude) AS lat, coalesce(nullif(TRY_CAST(qualifiers->>'$.lon' AS DOUBLE), 0), longitude) AS lon,
 coalesce(qualifiers->>'$.address' <> '' AND nullif(TRY_CAST(qualifiers->>'$.lat' AS DOUBLE), 0) IS NOT NULL, false) AS has_address, coalesce(qualifiers->>'$.office_type', 'office') AS office_type
 FROM x_relation r JOIN x_entity p ON p.entity_id = r.object_id WHERE predicate = 'has_office_in' AND r.superseded_at IS NULL"""


def _first(key, col, where):
    return f"(SELECT entity_id, arg_min(value_text, assertion_id) AS {col} FROM x_fact WHERE attribute_key = '{key}' AND value_text <> '' AND {where} GROUP BY entity_id)"


CITY = "(SELECT canonical_name AS city, arg_min(latitude, entity_id) AS city_lat, arg_min(longitude, entity_id) AS city_lon FROM x_entity WHERE entity_type = 'geography' AND latitude IS NOT NULL GROUP BY 1)"


@query(
    "map_markers",
    f"""WITH f AS ({OFFICE}), h AS (SELECT c.entity_id, country, t.city, e.latitude, e.longitude, e.has_street_address, o.lat AS olat, o.lon AS olon, o.has_address AS oaddr, city_lat, city_lon
 FROM {_first('headquarters_country', 'country', LIVE2)} c LEFT JOIN {_first('headquarters_city', 'city', LIVE2)} t USING (entity_id) JOIN x_entity e USING (entity_id)
 LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY relation_id) AS rn FROM f WHERE lat IS NOT NULL) q WHERE rn = 1) o USING (entity_id) LEFT JOIN {CITY} g ON g.city = t.city)
SELECT entity_id, coalesce(city, country) AS place, CASE WHEN latitude IS NOT NULL THEN latitude WHEN olat IS NOT NULL THEN olat ELSE city_lat END AS lat, CASE WHEN latitude IS NOT NULL THEN longitude WHEN olat IS NOT NULL THEN olon ELSE city_lon END AS lon,
 CASE WHEN latitude IS NOT NULL THEN has_street_address WHEN olat IS NOT NULL THEN oaddr ELSE false END AS has_address, 'headquarters' AS office_type FROM h
UNION ALL SELECT entity_id, place, lat, lon, has_address, office_type FROM f WHERE entity_id IN (SELECT entity_id FROM x_entity)""",
)
def _(t):
    return gaps.map_markers(t.x_entity, t.x_fact, t.x_relation)


def _set(key, col):
    return f"coalesce(string_agg(DISTINCT value_text, '|' ORDER BY value_text) FILTER (WHERE attribute_key = '{key}'), '') AS {col}"


@query(
    "supply_neighbors",
    f"""WITH r AS (SELECT * FROM x_relation WHERE superseded_at IS NULL AND predicate IN ({sql_list(vocab.SUPPLY_PREDICATES)})),
 n AS (SELECT relation_id, object_id AS entity_id, 'upstream' AS direction, subject_id AS other_id, predicate, coalesce(qualifiers->>'$.product', '') AS product FROM r
  UNION ALL SELECT relation_id, subject_id, 'downstream', object_id, predicate, coalesce(qualifiers->>'$.product', '') FROM r),
 p AS (SELECT entity_id, {_set('value_chain_tier', 'tiers')}, {_set('output', 'outputs')}, {_set('input', 'inputs')} FROM x_fact WHERE {LIVE2} AND value_text <> '' AND attribute_key IN ('value_chain_tier', 'output', 'input') GROUP BY 1)
SELECT relation_id, n.entity_id, direction, other_id, canonical_name AS other_name, predicate, product, coalesce(tiers, '') AS tiers, coalesce(outputs, '') AS outputs, coalesce(inputs, '') AS inputs
FROM n JOIN x_entity e ON e.entity_id = other_id LEFT JOIN p ON p.entity_id = other_id""",
)
def _(t):
    found = gaps.supply_neighbors(t.x_relation, t.x_entity, t.x_fact)
    return found.withColumns({c: F.coalesce(F.array_join(c, "|"), F.lit("")) for c in ("tiers", "outputs", "inputs")})


@query(
    "provenance_docs",
    """SELECT entity_id, p.document_id, title, url, s.name AS source FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY document_id) AS rn FROM (SELECT DISTINCT entity_id, document_id FROM x_assertion) a) p
JOIN x_document d ON d.document_id = p.document_id LEFT JOIN x_source s USING (source_id) WHERE rn <= 8""",
)
def _(t):
    return gaps.provenance_docs(t.x_assertion, t.x_document, t.x_source)


def geocodes(t):
    """Known points for address and place texts that occur in the data."""
    texts = t.x_fact.filter("attribute_key = 'headquarters_address'").select(F.col("value_text").alias("query"), F.col("assertion_id").alias("k"))
    roads = t.part.select(F.concat("p_partkey", F.lit(" Road")).alias("query"), F.col("p_partkey").alias("k"))
    places = t.nation.select(F.concat("n_name", F.lit(", "), "n_name").alias("query"), F.col("n_nationkey").alias("k"))
    return texts.union(roads).union(places).filter("k % 3 > 0").select(
        "query", (F.col("k") % 80).cast("double").alias("lat"), (F.col("k") % 100).cast("double").alias("lon")
    ).distinct()


GEO = """(SELECT DISTINCT query, CAST(k % 80 AS DOUBLE) AS lat, CAST(k % 100 AS DOUBLE) AS lon FROM (SELECT value_text AS query, assertion_id AS k FROM x_fact WHERE attribute_key = 'headquarters_address'
 UNION ALL SELECT concat(p_partkey, ' Road'), p_partkey FROM part UNION ALL SELECT concat(n_name, ', ', n_name), n_nationkey FROM nation) q WHERE k % 3 > 0)"""
LOC = f"""(SELECT entity_id, address, city, country FROM {_first('headquarters_address', 'address', 'superseded_at IS NULL')} a FULL JOIN {_first('headquarters_city', 'city', LIVE2)} b USING (entity_id) FULL JOIN {_first('headquarters_country', 'country', LIVE2)} c USING (entity_id))"""
GQ = "coalesce(address, nullif(concat_ws(', ', l.city, country), ''))"
HQ_OFFICES = f"""(SELECT relation_id, subject_id AS entity_id, qualifiers->>'$.office_type' AS office_type, lat, lon FROM x_relation JOIN {GEO} g ON g.query = qualifiers->>'$.address'
 WHERE predicate = 'has_office_in' AND superseded_at IS NULL AND qualifiers->>'$.address' <> '' AND coalesce(qualifiers->>'$.lat', '') IN ('', '0'))"""


@query("office_geocodes", f"SELECT relation_id, entity_id, office_type, lat, lon FROM {HQ_OFFICES} o")
def _(t):
    return gaps.office_geocodes(t.x_relation, geocodes(t))


@query(
    "coord_backfill",
    f"""SELECT * FROM (SELECT e.entity_id, CASE WHEN o.entity_id IS NOT NULL THEN o.lat WHEN address IS NULL AND city_lat IS NOT NULL THEN city_lat ELSE g.lat END AS lat,
 CASE WHEN o.entity_id IS NOT NULL THEN o.lon WHEN address IS NULL AND city_lat IS NOT NULL THEN city_lon ELSE g.lon END AS lon, o.entity_id IS NOT NULL OR address IS NOT NULL AS precise
FROM x_entity e LEFT JOIN (SELECT entity_id, arg_min(lat, relation_id) AS lat, arg_min(lon, relation_id) AS lon FROM {HQ_OFFICES} h WHERE office_type = 'hq' GROUP BY 1) o ON o.entity_id = e.entity_id
LEFT JOIN {LOC} l ON l.entity_id = e.entity_id LEFT JOIN {CITY} c ON c.city = l.city LEFT JOIN {GEO} g ON g.query = {GQ} WHERE e.latitude IS NULL) z WHERE lat IS NOT NULL""",
)
def _(t):
    return gaps.coord_backfill(t.x_entity, t.x_relation, t.x_fact, geocodes(t))


@query(
    "geocode_requests",
    f"""SELECT DISTINCT {GQ} AS query FROM x_entity e JOIN {LOC} l ON l.entity_id = e.entity_id LEFT JOIN {CITY} c ON c.city = l.city
WHERE e.latitude IS NULL AND (address IS NOT NULL OR c.city IS NULL) AND {GQ} NOT IN (SELECT query FROM {GEO} g)""",
)
def _(t):
    return gaps.geocode_requests(t.x_entity, t.x_fact, geocodes(t))
