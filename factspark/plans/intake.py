"""Registered queries of sources, sinks and vocabulary jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from factspark.functions import vocab
from factspark.sources import documents as docs
from factspark.sources import responses, vocabulary
from factspark.sources.tables import AS_OF

from .columns import at, PRIORITY_SQL, sql_domain_trust
from .registry import query


@query(
    "ingest_documents",
    """WITH h AS (SELECT doc_id, source, text, sha256(text) AS content_sha256 FROM documents)
SELECT min(doc_id) AS document_id, content_sha256, 'fetched' AS pipeline_status FROM h
WHERE content_sha256 NOT IN (SELECT content_sha256 FROM x_document WHERE lang = 'fr') GROUP BY content_sha256""",
)
def _(t):
    raw = t.documents.select(
        F.col("doc_id").alias("fetch_id"), F.col("source").alias("source_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("content")
    )
    new = docs.ingest_documents(raw, t.x_document.filter("lang = 'fr'"))
    return new.select("document_id", "content_sha256", "pipeline_status")


def _entries(t):
    """Pages as feed entries: the feed is the host, the order is the page id."""
    return t.pages.select(
        F.regexp_extract("url", r"//([^/]+)", 1).alias("feed_id"),
        F.col("page_id").alias("position"),
        F.when(F.col("page_id") % 9 > 0, F.col("url")).alias("link"),
    )


ENTRY_SQL = """SELECT * FROM (SELECT regexp_extract(url, '//([^/]+)', 1) AS feed_id, page_id AS position, CASE WHEN page_id % 9 > 0 THEN url END AS link,
 row_number() OVER (PARTITION BY regexp_extract(url, '//([^/]+)', 1) ORDER BY page_id) AS rn FROM pages) e WHERE link IS NOT NULL"""
KNOWN_SQL = "SELECT url FROM pages WHERE page_id % 4 = 1"


@query("feed_new_urls", f"SELECT feed_id, position, link FROM ({ENTRY_SQL}) e WHERE link NOT IN ({KNOWN_SQL})")
def _(t):
    return docs.feed_new_urls(_entries(t), t.pages.filter("page_id % 4 = 1"))


@query(
    "feed_counts",
    f"SELECT feed_id, count(*) FILTER (WHERE link NOT IN ({KNOWN_SQL})) AS queued, count(*) FILTER (WHERE link IN ({KNOWN_SQL})) AS skipped FROM ({ENTRY_SQL}) e GROUP BY feed_id",
)
def _(t):
    return docs.feed_counts(_entries(t), t.pages.filter("page_id % 4 = 1"))


@query(
    "url_documents",
    f"""SELECT sha256(url) AS content_sha256, url, substr(url, 1, 200) AS title, 'done' AS pipeline_status, {sql_domain_trust('url')} AS trust_override
FROM (SELECT DISTINCT trim(regexp_replace(concat('  ', url, '  '), '\\s+', ' ', 'g')) AS url FROM (SELECT url FROM x_document WHERE url IS NOT NULL UNION ALL SELECT url FROM pages) a) u
WHERE sha256(url) NOT IN (SELECT sha256(url) FROM pages WHERE page_id % 2 = 0)""",
)
def _(t):
    cited = t.x_document.select("url").union(t.pages.select("url")).withColumn("url", F.concat(F.lit("  "), "url", F.lit("  ")))
    existing = t.pages.filter("page_id % 2 = 0").select(F.sha2("url", 256).alias("content_sha256"))
    return docs.url_documents(cited, existing)


@query("parse_pages")
def _(t):
    return docs.parse_pages(t.pages)


@query("triage_requests", "SELECT document_id, substr(text_content, 1, 2000) AS snippet FROM x_document WHERE coalesce(text_content, '') <> ''")
def _(t):
    return docs.triage_requests(t.x_document)


def _triage_verdicts(t):
    return t.labels.select(
        F.col("doc_id").alias("document_id"), F.when(F.col("doc_id") % 7 > 0, F.col("quality") == 1).alias("relevant")
    )


@query(
    "triage_apply",
    """SELECT document_id, CASE WHEN coalesce(text_content, '') = '' THEN 'skipped' WHEN l.doc_id IS NULL THEN pipeline_status
 WHEN l.doc_id % 7 > 0 AND quality = 1 THEN 'triaged' ELSE 'skipped' END AS pipeline_status
FROM x_document LEFT JOIN labels l ON l.doc_id = document_id""",
)
def _(t):
    return docs.triage_apply(t.x_document, _triage_verdicts(t))


def stored_responses(t):
    """Orders as research responses: well-formed, fenced and cut-off JSON texts."""
    item = F.expr("concat('{\"attribute_key\": \"', o_orderpriority, '\", \"value\": ', o_orderkey, ', \"note\": \"a } brace\"}')")
    event = F.expr("concat('{\"event_type\": \"ipo\", \"participants\": [{\"name\": \"p', o_custkey, '\"}]}')")
    body = F.concat(F.lit('{"claims": ['), item, F.lit(", "), item, F.lit('], "events": ['), event, F.lit("]"))
    text = (
        F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("Here:\n```json\n"), body, F.lit("}\n```\n")))
        .when(F.col("o_orderkey") % 4 == 1, F.concat(body, F.lit("}")))
        .when(F.col("o_orderkey") % 4 == 2, F.concat(body, F.lit(', "fragments": [{"category": "research", "te')))
        .otherwise(F.expr("substring(o_orderpriority, 1, 4)"))
    )
    return t.orders.select(F.col("o_orderkey").alias("response_id"), text.alias("response"))


@query(
    "salvage_responses",
    """SELECT o_orderkey AS response_id, section, count(*) AS n FROM (
 SELECT o_orderkey, 'claims' AS section FROM orders WHERE o_orderkey % 4 < 3 UNION ALL SELECT o_orderkey, 'claims' FROM orders WHERE o_orderkey % 4 < 3
 UNION ALL SELECT o_orderkey, 'events' FROM orders WHERE o_orderkey % 4 < 3 UNION ALL SELECT o_orderkey, 'error' FROM orders WHERE o_orderkey % 4 = 3) s GROUP BY ALL""",
)
def _(t):
    records = responses.salvage_responses(stored_responses(t))
    return records.groupBy("response_id", "section").agg(F.count("*").alias("n"))


def _seed_nodes(t):
    return t.part.select(
        F.when(F.col("p_size") % 2 == 0, "value_chain").otherwise("maturity").alias("facet"),
        F.expr("concat(lower(p_type), '.', lower(replace(p_brand, '#', '_')))").alias("path"),
        F.expr("concat(p_type, ' ', p_brand)").alias("label"),
    ).distinct()


SEED_SQL = "SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN 'value_chain' ELSE 'maturity' END AS facet, concat(lower(p_type), '.', lower(replace(p_brand, '#', '_'))) AS path, concat(p_type, ' ', p_brand) AS label FROM part"


@query(
    "upsert_vocabulary",
    f"""SELECT facet, path, coalesce(s.label, n.label) AS label, CASE WHEN s.path IS NULL THEN 'kept' WHEN n.path IS NULL THEN 'created' ELSE 'updated' END AS action
FROM ({SEED_SQL}) s FULL JOIN (SELECT facet, path, label FROM x_node WHERE status = 'active') n USING (facet, path)""",
)
def _(t):
    current = t.x_node.filter("status = 'active'").select("facet", "path", "label")
    return vocabulary.upsert_vocabulary(_seed_nodes(t), current, ["facet", "path"], overwrite=True)


INSERTED = f"""SELECT facet, path, coalesce(n.label, s.label) AS label, CASE WHEN s.path IS NULL THEN 'kept' WHEN n.path IS NULL THEN 'created' ELSE 'skipped' END AS action
FROM ({SEED_SQL}) s FULL JOIN (SELECT facet, path, label FROM x_node WHERE status = 'active') n USING (facet, path)"""


def _inserted(t):
    current = t.x_node.filter("status = 'active'").select("facet", "path", "label")
    return vocabulary.upsert_vocabulary(_seed_nodes(t), current, ["facet", "path"])


@query("insert_vocabulary", INSERTED)
def _(t):
    return _inserted(t)


@query("vocabulary_counts", f"SELECT action, count(*) AS n FROM ({INSERTED}) q WHERE action <> 'kept' GROUP BY 1")
def _(t):
    return _inserted(t).filter("action <> 'kept'").groupBy("action").agg(F.count("*").alias("n"))


MOVE_SQL = "SELECT facet, path, 'value_chain' AS new_facet, concat('merged.', path) AS new_path FROM x_node WHERE facet = 'orbit_regime'"


@query(
    "remap_nodes",
    f"""WITH m AS ({MOVE_SQL}) SELECT classification_id, entity_id, coalesce(new_facet, c.facet) AS facet, coalesce(new_path, c.path) AS path FROM x_classification c LEFT JOIN m ON m.facet = c.facet AND m.path = c.path""",
)
def _(t):
    moves = t.x_node.filter("facet = 'orbit_regime'").select(
        "facet", "path", F.lit("value_chain").alias("new_facet"), F.concat(F.lit("merged."), "path").alias("new_path")
    )
    moved, _nodes = vocabulary.remap_nodes(t.x_classification, t.x_node, moves)
    return moved.select("classification_id", "entity_id", "facet", "path")


@query(
    "remap_nodes_deprecated",
    "SELECT facet, path, CASE WHEN facet = 'orbit_regime' THEN 'deprecated' ELSE status END AS status FROM x_node",
)
def _(t):
    moves = t.x_node.filter("facet = 'orbit_regime'").select(
        "facet", "path", F.lit("value_chain").alias("new_facet"), F.concat(F.lit("merged."), "path").alias("new_path")
    )
    return vocabulary.remap_nodes(t.x_classification, t.x_node, moves)[1].select("facet", "path", "status")


@query(
    "rename_values",
    "SELECT entity_id, CASE entity_type WHEN 'facility' THEN 'company' WHEN 'end_user' THEN 'customer' ELSE entity_type END AS entity_type, CASE status WHEN 'dormant' THEN 'active' ELSE status END AS status FROM x_entity",
)
def _(t):
    typed = vocabulary.rename_values(t.x_entity, "entity_type", {"facility": "company", "end_user": "customer"})
    return vocabulary.rename_values(typed, "status", {"dormant": "active"}).select("entity_id", "entity_type", "status")


@query(
    "due_sources",
    f"""WITH p AS ({PRIORITY_SQL.replace('round(greatest', 'greatest').replace('0.01), 6)', '0.01)')})
SELECT feed_id, entity_hint, round(priority, 6) AS priority FROM (SELECT feed_id, entity_hint, coalesce(priority, 1.0) AS priority FROM x_feed LEFT JOIN p ON p.entity_id = entity_hint
 WHERE is_active AND (last_checked_at IS NULL OR floor((epoch_us(TIMESTAMP '2002-01-01') - epoch_us(last_checked_at)) / 86400000000) >= CASE cadence WHEN 'daily' THEN 1 WHEN 'weekly' THEN 7 WHEN 'monthly' THEN 30 ELSE 0 END)) d
""",
)
def _(t):
    due = docs.due_sources(t.x_feed, t.x_entity, t.x_assertion, at())
    return due.withColumn("priority", F.round("priority", 6))


@query(
    "country_preview",
    """SELECT entity_id, old_value, 'FR' AS new_value FROM (SELECT entity_id, value_text AS old_value, row_number() OVER (PARTITION BY entity_id ORDER BY assertion_id) AS rn
 FROM (SELECT entity_id, assertion_id, CASE assertion_id % 3 WHEN 0 THEN 'france' ELSE value_text END AS value_text FROM x_fact WHERE attribute_key = 'headquarters_country') f WHERE value_text = 'france') r WHERE rn = 1""",
)
def _(t):
    from factspark.operators.entities import country_preview

    return country_preview(
        t.x_fact.withColumn("value_text", F.when(F.col("assertion_id") % 3 == 0, "france").otherwise(F.col("value_text")))
    )
