"""Registered queries of the listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from factspark.functions import vocab
from factspark.operators import reads

from .columns import sql_list
from .registry import query

TODAY = "1999-01-01"
def day():
    return F.lit(TODAY).cast("date")
MONEY = lambda df: df.withColumn("amount_usd", F.col("amount_usd").cast("double"))


@query(
    "candidate_queue",
    """SELECT assertion_id, a.entity_id, canonical_name, attribute_key, CAST(value_num AS DOUBLE) AS value_num, confidence, observed_at, s.name AS source
FROM (SELECT * FROM x_assertion WHERE status = 'candidate' ORDER BY confidence DESC, observed_at DESC NULLS FIRST, assertion_id LIMIT 200) a JOIN x_entity e ON e.entity_id = a.entity_id
LEFT JOIN x_document d ON d.document_id = a.document_id LEFT JOIN x_source s ON s.source_id = d.source_id""",
)
def _(t):
    return reads.candidate_queue(t.x_assertion, t.x_entity, t.x_document, t.x_source).withColumn("value_num", F.col("value_num").cast("double"))


@query(
    "entity_search",
    """SELECT entity_id, canonical_name, entity_type, status FROM x_entity WHERE status <> 'merged' AND entity_type <> 'geography'
 AND (contains(lower(canonical_name), 'red wid') OR entity_id IN (SELECT entity_id FROM x_alias WHERE contains(lower(alias), 'red wid'))) ORDER BY canonical_name, entity_id LIMIT 12""",
)
def _(t):
    return reads.entity_search(t.x_entity, t.x_alias, "Red Wid")


CONN_SQL = """SELECT e.event_id, e.entity_id, e.title FROM x_event e JOIN x_entity s ON s.entity_id = e.entity_id
 JOIN (SELECT event_id, bool_or(contains(lower(canonical_name), '#00000001')) AS pn, bool_or(entity_type = 'company') AS pt FROM x_participant p JOIN x_entity USING (entity_id) GROUP BY event_id) p ON p.event_id = e.event_id
 WHERE (contains(lower(s.canonical_name), '#00000001') OR pn OR contains(lower(e.title), '#00000001')) AND (s.entity_type = 'company' OR pt) ORDER BY e.event_id DESC LIMIT 200"""


@query(
    "connections",
    f"""SELECT c.event_id, c.entity_id, c.title, string_agg(DISTINCT n.canonical_name, '|' ORDER BY n.canonical_name) AS participants
FROM ({CONN_SQL}) c JOIN x_participant p ON p.event_id = c.event_id JOIN x_entity n ON n.entity_id = p.entity_id GROUP BY ALL""",
)
def _(t):
    found = reads.connections(t.x_event, t.x_participant, t.x_entity, q="#00000001", entity_type="company")
    return found.withColumn("participants", F.array_join("participants", "|"))


@query(
    "connection_counts",
    "SELECT 'events' AS metric, '' AS key, count(DISTINCT event_id) AS n FROM x_participant UNION ALL SELECT 'entity_type', entity_type, count(*) FROM x_entity GROUP BY entity_type",
)
def _(t):
    return reads.connection_counts(t.x_participant, t.x_entity)


@query(
    "insights",
    """SELECT * FROM (SELECT event_type AS kind, event_id AS id, entity_id, title AS label, date FROM x_event JOIN x_entity USING (entity_id) WHERE event_type IN ('publication', 'research_grant')
 AND (contains(lower(canonical_name), 'lot 3') OR contains(lower(title), 'lot 3') OR contains(lower(description), 'lot 3')) ORDER BY date DESC NULLS FIRST, x_event.created_at DESC NULLS FIRST, event_id DESC LIMIT 200) e
UNION ALL SELECT * FROM (SELECT 'fragment', fragment_id, entity_id, text, date_of_information FROM x_fragment JOIN x_entity USING (entity_id) WHERE category = 'research'
 AND (contains(lower(canonical_name), 'lot 3') OR contains(lower(text), 'lot 3')) ORDER BY date_of_information DESC NULLS FIRST, x_fragment.created_at DESC NULLS FIRST, fragment_id DESC LIMIT 100) f""",
)
def _(t):
    return reads.insights(t.x_event, t.x_fragment, t.x_entity.drop("created_at"), q="lot 3")


@query(
    "insight_counts",
    "SELECT event_type AS kind, count(*) AS n FROM x_event WHERE event_type IN ('publication', 'research_grant') GROUP BY 1 UNION ALL SELECT 'fragment', count(*) FROM x_fragment WHERE category = 'research'",
)
def _(t):
    return reads.insight_counts(t.x_event, t.x_fragment)


@query(
    "funding_events",
    f"""SELECT event_id, entity_id, event_type, date, CAST(amount_usd AS DOUBLE) AS amount_usd FROM x_event JOIN x_entity USING (entity_id) WHERE event_type IN ({sql_list(vocab.FUNDING_TYPES)}) AND event_type = 'ipo'
 AND (contains(lower(canonical_name), 'round 2') OR contains(lower(title), 'round 2') OR contains(lower(description), 'round 2'))
 ORDER BY date DESC NULLS FIRST, x_event.created_at DESC NULLS FIRST, event_id DESC LIMIT 300""",
)
def _(t):
    return MONEY(reads.funding_events(t.x_event, t.x_entity, q="Round 2", event_type="ipo"))


CALLS_SQL = f"event_type = 'grant_call' AND (call_status IS NULL OR call_status <> 'closed') AND (date IS NULL OR date >= DATE '{TODAY}')"


@query(
    "open_calls",
    f"SELECT event_id, entity_id, date, call_status, call_url FROM x_event WHERE {CALLS_SQL} ORDER BY date DESC NULLS FIRST, created_at DESC NULLS FIRST, event_id DESC LIMIT 30",
)
def _(t):
    return reads.open_calls(t.x_event, day())


@query(
    "recent_events",
    f"""SELECT event_id, date, distance_days FROM (SELECT event_id, date, 0 AS side, abs(date - DATE '{TODAY}') AS distance_days FROM (SELECT * FROM x_event WHERE date <= DATE '{TODAY}' ORDER BY date DESC, event_id LIMIT 40) a
 UNION ALL SELECT event_id, date, 1, abs(date - DATE '{TODAY}') FROM (SELECT * FROM x_event WHERE date > DATE '{TODAY}' ORDER BY date, event_id LIMIT 20) b) u ORDER BY distance_days, side, event_id LIMIT 14""",
)
def _(t):
    return reads.recent_events(t.x_event, day())


@query(
    "recent_activity",
    """SELECT * FROM (SELECT 'entity' AS kind, entity_id AS id, created_at AS at FROM x_entity WHERE status <> 'merged' ORDER BY created_at DESC, entity_id LIMIT 10) a
UNION ALL SELECT * FROM (SELECT 'relation', CAST(relation_id AS VARCHAR), observed_at FROM x_relation WHERE superseded_at IS NULL ORDER BY relation_id DESC LIMIT 8) b
UNION ALL SELECT * FROM (SELECT 'run', CAST(run_id AS VARCHAR), started_at FROM x_run ORDER BY started_at DESC, run_id LIMIT 8) c""",
)
def _(t):
    return reads.recent_activity(t.x_entity, t.x_relation, t.x_run)


@query(
    "research_runs",
    """WITH h AS (SELECT run_id, stats->>'$.topic' AS topic, status FROM x_run WHERE contains(lower(stats->>'$.topic'), 'customer#') AND status = 'completed' ORDER BY started_at DESC, run_id LIMIT 150),
 n AS (SELECT lower(canonical_name) AS name, coalesce(min(entity_id) FILTER (WHERE status IN ('active', 'dormant')), min(redirects_to) FILTER (WHERE status = 'merged')) AS entity_id FROM x_entity GROUP BY 1)
SELECT run_id, topic, n.entity_id, status FROM h LEFT JOIN n ON n.name = lower(topic)""",
)
def _(t):
    return reads.research_runs(t.x_run, t.x_entity, q="customer#", status="completed")


@query(
    "taxonomy_vocab",
    "SELECT facet, path, label, substr(definition, 1, 120) AS definition FROM x_node WHERE status = 'active' AND facet_status = 'active' AND facet IN ('value_chain', 'orbit_regime')",
)
def _(t):
    return reads.taxonomy_vocab(t.x_node, ["value_chain", "orbit_regime"])


@query("seen_urls", "SELECT DISTINCT entity_id, url FROM x_assertion JOIN x_document USING (document_id) WHERE url <> ''")
def _(t):
    return reads.seen_urls(t.x_document, t.x_assertion)


@query(
    "seen_urls_recent",
    "SELECT document_id, url FROM x_document WHERE url <> '' AND fetched_at >= TIMESTAMP '2001-07-01' - INTERVAL 20 DAY ORDER BY fetched_at DESC, document_id LIMIT 50",
)
def _(t):
    return reads.seen_urls_recent(t.x_document, F.lit("2001-07-01").cast("timestamp"), 20)


@query(
    "stranded_candidates",
    """SELECT assertion_id, CAST(floor((row_number() OVER (ORDER BY assertion_id) - 1) / 100) AS BIGINT) AS batch FROM x_assertion
 WHERE status = 'candidate' AND created_at < TIMESTAMP '2001-08-01' - INTERVAL 1 HOUR AND created_at >= TIMESTAMP '2001-08-01' - INTERVAL 24 HOUR""".replace(
        "FROM x_assertion", "FROM (SELECT *, TIMESTAMP '2001-08-01' - to_hours(CAST(assertion_id % 40 AS INT)) AS created_at FROM x_assertion) a"
    ),
)
def _(t):
    as_of = F.lit("2001-08-01").cast("timestamp")
    age = F.make_dt_interval(hours=(F.col("assertion_id") % 40).cast("int"))
    return reads.stranded_candidates(t.x_assertion.withColumn("created_at", as_of - age), as_of)


@query(
    "taxonomy_proposals",
    "SELECT facet, path, label, CASE length(definition) % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'deprecated' ELSE 'proposed' END AS status FROM x_node WHERE status = 'proposed'",
)
def _(t):
    action = F.expr("CASE length(definition) % 3 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' END")
    decisions = t.x_node.select("facet", "path", action.alias("action")).filter("action IS NOT NULL")
    return reads.taxonomy_proposals(t.x_node, decisions)


@query("live_facts", "SELECT assertion_id, status FROM x_assertion WHERE superseded_at IS NULL AND status IN ('accepted', 'candidate')")
def _(t):
    return reads.live_facts(t.x_assertion, with_candidates=True).select("assertion_id", "status")
