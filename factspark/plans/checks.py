"""Registered queries of the data-quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from factspark.functions import names
from factspark.operators import checks

from .registry import query
from .totals import LIVE


@query(
    "overlap_violations",
    f"""WITH s AS (SELECT entity_id, attribute_key, assertion_id, coalesce(epoch_us(valid_lower), -4611686018427387904) AS lo, coalesce(epoch_us(valid_upper), 4611686018427387904) AS hi FROM x_assertion
 WHERE {LIVE} AND attribute_key IN (SELECT attribute_key FROM x_attribute_def WHERE cardinality = 'single')),
 c AS (SELECT b.entity_id, b.attribute_key, b.assertion_id, a.assertion_id AS other, row_number() OVER (PARTITION BY b.assertion_id ORDER BY CASE WHEN a.lo < b.lo THEN 0 ELSE 1 END, CASE WHEN a.lo < b.lo THEN a.hi END DESC, a.assertion_id) AS rn
 FROM s a JOIN s b ON a.entity_id = b.entity_id AND a.attribute_key = b.attribute_key AND (a.lo, a.assertion_id) < (b.lo, b.assertion_id) AND a.hi > b.lo WHERE a.lo < a.hi AND b.lo < b.hi)
SELECT entity_id, attribute_key, assertion_id, other AS conflicts_with FROM c WHERE rn = 1""",
)
def _(t):
    return checks.overlap_violations(t.x_assertion, t.x_attribute_def)


@query("unsourced_extractions", "SELECT assertion_id FROM x_assertion WHERE method = 'extracted' AND (document_id IS NULL OR quote IS NULL)")
def _(t):
    return checks.unsourced_extractions(t.x_assertion).select("assertion_id")


@query("event_key_violations", "SELECT entity_id, event_type, date, CAST(amount_usd AS DOUBLE) AS amount_usd, count(*) AS n FROM (SELECT *, ceil(amount_usd / 20000) * 20000 AS a2 FROM x_event) e WHERE false GROUP BY ALL".replace("WHERE false GROUP BY ALL", "WHERE a2 > 0 GROUP BY entity_id, event_type, date, a2 HAVING count(*) > 1").replace("CAST(amount_usd AS DOUBLE) AS", "CAST(a2 AS DOUBLE) AS"))
def _(t):
    rounded = t.x_event.withColumn("amount_usd", F.ceil(F.col("amount_usd") / 20000) * 20000)
    return checks.event_key_violations(rounded).withColumn("amount_usd", F.col("amount_usd").cast("double"))


@query("unique_key_violations", "SELECT scheme, value, count(*) AS n FROM x_identifier GROUP BY ALL HAVING count(*) > 1")
def _(t):
    return checks.unique_key_violations(t.x_identifier, ["scheme", "value"])


@query("unique_hash_violations", "SELECT content_sha256, count(*) AS n FROM x_document GROUP BY ALL HAVING count(*) > 1")
def _(t):
    return checks.unique_key_violations(t.x_document, ["content_sha256"])


@query("unique_pair_violations", """SELECT id_a, id_b, count(*) AS n FROM (SELECT least(a, b) AS id_a, greatest(a, b) AS id_b FROM (SELECT concat('C', c_custkey % 90) AS a, concat('C', c_custkey * 2 % 90) AS b FROM customer) p) q WHERE id_a <> id_b GROUP BY ALL HAVING count(*) > 1""")
def _(t):
    c = lambda k: F.concat(F.lit("C"), k.cast("string"))
    a, b = c(F.col("c_custkey") % 90), c(F.col("c_custkey") * 2 % 90)
    pairs = t.customer.select(F.least(a, b).alias("id_a"), F.greatest(a, b).alias("id_b")).filter("id_a <> id_b")
    return checks.unique_key_violations(pairs, ["id_a", "id_b"])


@query("unique_path_violations", "SELECT facet, path, count(*) AS n FROM (SELECT facet, path FROM x_node UNION ALL SELECT facet, path FROM x_classification) q GROUP BY ALL HAVING count(*) > 1")
def _(t):
    nodes = t.x_node.select("facet", "path").unionByName(t.x_classification.select("facet", "path"))
    return checks.unique_key_violations(nodes, ["facet", "path"])


@query("unique_slug_violations", "SELECT slug, count(*) AS n FROM (SELECT trim(regexp_replace(regexp_replace(lower(trim(alias)), '[^a-z0-9_ -]', '', 'g'), '[- ]+', '-', 'g'), '-_') AS slug FROM x_alias) q GROUP BY ALL HAVING count(*) > 1")
def _(t):
    return checks.unique_key_violations(t.x_alias.select(names.slug_base(F.col("alias")).alias("slug")), ["slug"])
