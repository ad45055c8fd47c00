"""Registered queries of the aggregate reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from factspark.functions import vocab
from factspark.operators import totals
from factspark.sources.tables import LEDGER_AS_OF

from .columns import at, COST_SQL, LEVEL_SQL, sql_case_map, sql_list
from .gaps import LIVE2, now, REPORT, _first
from .reads import CALLS_SQL, day
from .registry import query

SUPPLY = sql_list(vocab.SUPPLY_PREDICATES)
LIVE = "status = 'accepted' AND superseded_at IS NULL"

ENTITY_COUNTS = "SELECT entity_type, status, count(*) AS n FROM x_entity GROUP BY ALL"
ASSERTION_COUNTS = "SELECT status, count(*) AS n FROM x_assertion GROUP BY ALL"
FUNDING_TOTAL = f"SELECT CAST(coalesce(sum(value_num), 0) AS DOUBLE) AS total_usd, count(*) AS data_points FROM x_assertion WHERE {LIVE} AND attribute_key = 'total_funding_usd'"
TOP_NODES = """SELECT facet, path, n FROM (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, path) AS rn FROM (
 SELECT facet, path, count(DISTINCT entity_id) AS n FROM x_classification WHERE is_primary AND (facet, path) IN (SELECT (facet, path) FROM x_node WHERE facet_status = 'active') GROUP BY ALL) c) r WHERE rn <= 10"""
COST_DAY = f"""SELECT count(*) AS calls, round(coalesce(sum({COST_SQL}), 0), 6) AS cost_usd, (SELECT count(*) FROM x_entity WHERE watchlist) AS watchlist
 FROM x_call LEFT JOIN x_rate USING (model) WHERE called_at >= TIMESTAMP '{LEDGER_AS_OF}' - INTERVAL 1 DAY"""


@query("entity_counts", ENTITY_COUNTS)
def _(t):
    return totals.entity_counts(t.x_entity)


@query("assertion_counts", ASSERTION_COUNTS)
def _(t):
    return totals.assertion_counts(t.x_assertion)


@query("funding_total", FUNDING_TOTAL)
def _(t):
    return totals.funding_total(t.x_assertion).withColumn("total_usd", F.col("total_usd").cast("double"))


@query("facet_top_nodes", TOP_NODES)
def _(t):
    return totals.facet_top_nodes(t.x_classification, t.x_node)


@query("cost_last_24h", COST_DAY)
def _(t):
    return totals.cost_last_24h(t.x_call, t.x_rate, t.x_entity, now()).withColumn("cost_usd", F.round("cost_usd", 6))


@query(
    "cost_report",
    f"""SELECT CASE WHEN grouping(task) = 1 AND grouping(model) = 1 THEN 'total' WHEN grouping(task) = 0 THEN 'task' ELSE 'model' END AS level, coalesce(task, model, '') AS key, count(*) AS calls,
 CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, round(sum({COST_SQL}), 6) AS cost_usd FROM x_call LEFT JOIN x_rate USING (model)
WHERE called_at >= TIMESTAMP '{LEDGER_AS_OF}' - INTERVAL 30 DAY GROUP BY GROUPING SETS ((), (task), (model))""",
)
def _(t):
    return totals.cost_report(t.x_call, t.x_rate, now()).withColumn("cost_usd", F.round("cost_usd", 6))


FUND8 = sql_list(totals.REPORT_FUNDING)
WEEK = "TIMESTAMP '2002-01-01' - INTERVAL 150 DAY"


@query(
    "dashboard_health",
    f"""WITH k AS (SELECT count(*) FILTER (WHERE status <> 'merged') AS active, count(*) FILTER (WHERE status <> 'merged' AND space_relevance IS NOT NULL) AS scored,
 count(*) FILTER (WHERE status <> 'merged' AND created_at >= TIMESTAMP '2001-08-05' - INTERVAL 7 DAY) AS new_entities FROM x_entity),
 s AS (SELECT count(*) AS summarised FROM x_summary),
 e AS (SELECT count(*) FILTER (WHERE created_at >= TIMESTAMP '2001-08-05' - INTERVAL 7 DAY) AS new_events, count(*) FILTER (WHERE event_type IN ({FUND8}) AND date >= DATE '2001-07-06' AND amount_usd IS NOT NULL) AS fe,
  coalesce(sum(amount_usd) FILTER (WHERE event_type IN ({FUND8}) AND date >= DATE '2001-07-06'), 0) AS fu FROM x_event),
 r AS (SELECT count(*) FILTER (WHERE superseded_at IS NULL) AS relations, count(*) FILTER (WHERE superseded_at IS NULL AND observed_at >= TIMESTAMP '2001-08-05' - INTERVAL 7 DAY) AS nr FROM x_relation),
 m AS (SELECT 'active' AS metric, '' AS key, active AS value FROM k UNION ALL SELECT 'scored', '', scored FROM k UNION ALL SELECT 'new_entities', '', new_entities FROM k UNION ALL SELECT 'summarised', '', summarised FROM s
  UNION ALL SELECT 'new_events', '', new_events FROM e UNION ALL SELECT 'funding_30d_events', '', fe FROM e UNION ALL SELECT 'funding_30d_usd', '', CAST(fu AS DOUBLE) FROM e
  UNION ALL SELECT 'new_fragments', '', count(*) FILTER (WHERE created_at >= TIMESTAMP '2001-08-05' - INTERVAL 7 DAY) FROM x_fragment UNION ALL SELECT 'relations', '', relations FROM r UNION ALL SELECT 'new_relations', '', nr FROM r
  UNION ALL SELECT 'candidates', '', count(*) FILTER (WHERE status = 'candidate') FROM x_assertion
  UNION ALL SELECT 'summarised_pct', '', round_even(100 * summarised / active, 0) FROM s, k UNION ALL SELECT 'scored_pct', '', round_even(100 * scored / active, 0) FROM k
  UNION ALL SELECT 'relevance', CAST(space_relevance AS VARCHAR), count(*) FROM x_entity WHERE status <> 'merged' AND space_relevance IS NOT NULL GROUP BY space_relevance)
SELECT metric, key, CAST(value AS DOUBLE) AS value FROM m""",
)
def _(t):
    return totals.dashboard_health(t.x_entity, t.x_summary, t.x_event, t.x_fragment, t.x_relation, t.x_assertion, F.lit("2001-08-05").cast("timestamp"))


@query("run_totals", "SELECT count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'running') AS running FROM x_run")
def _(t):
    return totals.run_totals(t.x_run)


@query(
    "node_entity_counts",
    """SELECT facet, path, CAST(length(path) - length(replace(path, '.', '')) AS INT) AS depth, coalesce(n, 0) AS n FROM x_node LEFT JOIN (SELECT facet, path, count(DISTINCT entity_id) AS n FROM x_classification GROUP BY ALL) c USING (facet, path) WHERE facet_status = 'active'""",
)
def _(t):
    return totals.node_entity_counts(t.x_node, t.x_classification)


@query(
    "funding_type_counts",
    f"SELECT event_type, count(event_id) AS n FROM (SELECT unnest([{sql_list(vocab.FUNDING_TYPES)}]) AS event_type) k LEFT JOIN x_event USING (event_type) GROUP BY event_type",
)
def _(t):
    return totals.funding_type_counts(t.x_event)


@query(
    "top_investors",
    "SELECT entity_id, canonical_name, deals FROM (SELECT subject_id AS entity_id, count(*) AS deals FROM x_relation WHERE predicate = 'invested_in' AND superseded_at IS NULL GROUP BY 1 ORDER BY deals DESC, 1 LIMIT 10) i JOIN x_entity USING (entity_id)",
)
def _(t):
    return totals.top_investors(t.x_relation, t.x_entity)


@query(
    "program_board",
    f"""WITH p AS (SELECT entity_id, canonical_name FROM x_entity WHERE entity_type = 'funding_program' AND status = 'active' ORDER BY canonical_name, entity_id LIMIT 60),
 c AS (SELECT entity_id, string_agg(event_id, ',' ORDER BY event_id) AS open_calls FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY date DESC NULLS FIRST, created_at DESC NULLS FIRST, event_id DESC) AS rn FROM x_event WHERE {CALLS_SQL}) q WHERE rn <= 3 GROUP BY 1),
 a AS (SELECT p.entity_id, count(*) AS award_count FROM x_participant p JOIN x_event e USING (event_id) WHERE event_type IN ({sql_list(totals.AWARD_TYPES)}) GROUP BY 1)
SELECT p.entity_id, canonical_name, administrator, coalesce(open_calls, '') AS open_calls, coalesce(award_count, 0) AS award_count, fragment_id FROM p
LEFT JOIN (SELECT object_id AS entity_id, arg_min(subject_id, relation_id) AS administrator FROM x_relation WHERE predicate = 'administers' AND superseded_at IS NULL GROUP BY 1) d USING (entity_id)
LEFT JOIN c USING (entity_id) LEFT JOIN a USING (entity_id) LEFT JOIN (SELECT entity_id, fragment_id FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY confidence DESC, fragment_id) AS rn FROM x_fragment) q WHERE rn = 1) f USING (entity_id)""",
)
def _(t):
    board = totals.program_board(t.x_entity, t.x_relation, t.x_event, t.x_participant, t.x_fragment, day())
    return board.withColumn("open_calls", F.array_join(F.col("open_calls").cast("array<string>"), ","))


@query("source_counts", "SELECT entity_id, attribute_key, count(DISTINCT document_id) AS n FROM x_assertion WHERE superseded_at IS NULL GROUP BY ALL")
def _(t):
    return totals.source_counts(t.x_assertion)


EVIDENCE = f"""SELECT entity_id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(c) AS BIGINT) AS n_claims FROM (SELECT entity_id, count(*) AS n, count(*) AS c FROM x_assertion WHERE {LIVE} GROUP BY 1
 UNION ALL SELECT entity_id, count(*), 0 FROM x_fragment GROUP BY 1 UNION ALL SELECT entity_id, count(*), 0 FROM x_event GROUP BY 1) q GROUP BY 1"""


@query("evidence_counts", f"SELECT entity_id, n FROM ({EVIDENCE}) e")
def _(t):
    return totals.evidence_counts(t.x_assertion, t.x_fragment, t.x_event)


DEGREES = f"""SELECT entity_id, count(*) FILTER (WHERE o = 0) AS n_in, count(*) FILTER (WHERE o = 1) AS n_out FROM (SELECT subject_id AS entity_id, 1 AS o FROM x_relation WHERE superseded_at IS NULL AND predicate IN ({SUPPLY})
 UNION ALL SELECT object_id, 0 FROM x_relation WHERE superseded_at IS NULL AND predicate IN ({SUPPLY})) d GROUP BY 1"""


@query("supply_degrees", DEGREES)
def _(t):
    return totals.supply_degrees(t.x_relation)


def _prof(key, col):
    return f"coalesce(string_agg(DISTINCT value_text, '|' ORDER BY value_text) FILTER (WHERE attribute_key = '{key}'), '') AS {col}"


PROFILES = f"""(SELECT entity_id, {_prof('value_chain_tier', 'tiers')}, {_prof('output', 'outputs')}, {_prof('input', 'inputs')},
 list_distinct(list_filter(list({LEVEL_SQL}) FILTER (WHERE attribute_key = 'value_chain_tier'), lambda x: x IS NOT NULL)) AS levels
 FROM x_fact WHERE {LIVE2} AND value_text <> '' AND attribute_key IN ('value_chain_tier', 'output', 'input') GROUP BY 1)"""
LANES = f"""WITH h AS (SELECT e.entity_id, canonical_name, tiers, outputs, inputs, levels FROM x_entity e JOIN {PROFILES} p ON p.entity_id = e.entity_id WHERE status = 'active' AND entity_type IN ({sql_list(totals.SUPPLY_ENTITY_TYPES)}) {{where}}),
 l AS (SELECT CASE WHEN len(levels) > 0 THEN unnest(levels) END AS lane, * EXCLUDE levels FROM h WHERE len(levels) > 0 UNION ALL SELECT 'pending', * EXCLUDE levels FROM h WHERE levels IS NULL OR len(levels) = 0)"""


def _joined(df):
    return df.withColumns({c: F.array_join(c, "|") for c in ("tiers", "outputs", "inputs")})


@query(
    "supply_lanes",
    LANES.format(where="") + f" SELECT lane, l.entity_id, canonical_name, tiers, outputs, inputs, coalesce(country, '') AS country, coalesce(n_in, 0) AS supply_in, coalesce(n_out, 0) AS supply_out FROM l LEFT JOIN {_first('headquarters_country', 'country', LIVE2)} c USING (entity_id) LEFT JOIN ({DEGREES}) d USING (entity_id)",
)
def _(t):
    return _joined(totals.supply_lanes(t.x_entity, t.x_alias, t.x_fact, t.x_relation))


@query(
    "supply_lanes_filtered",
    LANES.format(where="AND list_contains(levels, 'upstream') AND contains(lower(tiers), 'brand_1') AND (contains(lower(canonical_name), 'r#0') OR e.entity_id IN (SELECT entity_id FROM x_alias WHERE contains(lower(alias), 'r#0')))") + " SELECT lane, entity_id, tiers FROM l",
)
def _(t):
    lanes = totals.supply_lanes(t.x_entity, t.x_alias, t.x_fact, t.x_relation, q="r#0", level="upstream", cat="Brand_1")
    return _joined(lanes).select("lane", "entity_id", "tiers")


@query(
    "supply_lane_counts",
    LANES.format(where="") + f" SELECT k.lane, count(l.lane) AS n FROM (SELECT unnest([{sql_list([*vocab.LEVELS, 'pending'])}]) AS lane) k LEFT JOIN l ON l.lane = k.lane GROUP BY 1",
)
def _(t):
    return totals.lane_counts(totals.supply_lanes(t.x_entity, t.x_alias, t.x_fact, t.x_relation))


@query(
    "tier_categories",
    f"SELECT DISTINCT split_part(value_text, '.', 2) AS category FROM x_fact WHERE attribute_key = 'value_chain_tier' AND {LIVE2} AND contains(value_text, '.') AND split_part(value_text, '.', 1) IN ({sql_list(vocab.LEVELS)})",
)
def _(t):
    return totals.tier_categories(t.x_fact)


DUP_EVENTS = "SELECT entity_id, event_type, title, date, count(*) AS n, min(event_id) AS oldest FROM x_event GROUP BY ALL HAVING count(*) > 1"


@query("duplicate_events", DUP_EVENTS)
def _(t):
    return totals.duplicate_events(t.x_event)


@query(
    "evidence_flag",
    f"SELECT entity_id, entity_id IN (SELECT entity_id FROM x_assertion WHERE {LIVE}) OR entity_id IN (SELECT entity_id FROM x_event) OR entity_id IN (SELECT entity_id FROM x_fragment) AS has_evidence FROM x_entity",
)
def _(t):
    return totals.evidence_flag(t.x_entity, t.x_assertion, t.x_event, t.x_fragment)


AGED = f"""(SELECT entity_id, assertion_id, CAST(floor((epoch_us(TIMESTAMP '2002-01-01') - epoch_us(coalesce(valid_lower, observed_at))) / 86400000000) AS INT) - volatility_days AS excess_days,
 attribute_key || '=' || CAST(CAST(value_num AS DOUBLE) AS VARCHAR) AS sample FROM x_assertion JOIN x_attribute_def USING (attribute_key) WHERE {LIVE} AND volatility_days IS NOT NULL)"""


@query(
    "stale_entities",
    f"""SELECT entity_id, excess_days, sample, {REPORT} AS frame FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY excess_days DESC, assertion_id) AS rn FROM {AGED} a WHERE excess_days > 0) w
JOIN x_entity USING (entity_id) WHERE rn = 1 AND status <> 'merged' AND entity_type NOT IN ('geography', 'document_node') AND space_relevance >= 50
 AND canonical_name NOT IN (SELECT stats->>'$.topic' FROM x_run WHERE started_at - INTERVAL 8065 DAY >= TIMESTAMP '2002-01-01' - INTERVAL 7 DAY AND stats->>'$.topic' IS NOT NULL)
""",
)
def _(t):
    runs = t.x_run.withColumn("started_at", F.col("started_at") - F.make_dt_interval(F.lit(8065)))
    return totals.stale_entities(t.x_assertion, t.x_attribute_def, t.x_entity, runs, at())


@query(
    "stale_programs",
    """SELECT * FROM (SELECT entity_id, last_observed IS NULL OR last_observed < TIMESTAMP '2001-08-01' - INTERVAL 30 DAY AS stale, coalesce(last_call < DATE '2001-08-01', false) AS deadline_passed
 FROM (SELECT entity_id FROM x_entity WHERE entity_type = 'funding_program' AND status = 'active') p LEFT JOIN (SELECT entity_id, max(observed_at) AS last_observed FROM x_assertion GROUP BY 1) a USING (entity_id)
 LEFT JOIN (SELECT entity_id, max(date) AS last_call FROM x_event WHERE event_type = 'grant_call' GROUP BY 1) c USING (entity_id)) q WHERE stale OR deadline_passed""",
)
def _(t):
    return totals.stale_programs(t.x_entity, t.x_assertion, t.x_event, F.lit("2001-08-01").cast("timestamp"))


def _pack(sql, key):
    return f"(SELECT string_agg({key} || '=' || CAST(CAST(n AS DOUBLE) AS VARCHAR), ';' ORDER BY {key}) FROM ({sql}) q)"


@query(
    "snapshot",
    f"""SELECT {_pack(ENTITY_COUNTS, "entity_type || '/' || status")} AS entities, {_pack(ASSERTION_COUNTS, 'status')} AS assertions, {_pack(TOP_NODES, "facet || '/' || path")} AS nodes,
 'data_points=' || CAST(CAST(data_points AS DOUBLE) AS VARCHAR) || ';total_usd=' || CAST(total_usd AS VARCHAR) AS funding, 'calls=' || CAST(CAST(calls AS DOUBLE) AS VARCHAR) || ';watchlist=' || CAST(CAST(watchlist AS DOUBLE) AS VARCHAR) AS cost
FROM ({FUNDING_TOTAL}) f, ({COST_DAY}) c""",
)
def _(t):
    row = totals.snapshot(t.x_entity, t.x_assertion, t.x_classification, t.x_node, t.x_call, t.x_rate, now())
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ";").alias(c)
    no_cost = row.withColumn("cost", F.filter("cost", lambda x: x["key"] != "cost_usd"))
    return no_cost.select(*[text(c) for c in ("entities", "assertions", "nodes", "funding", "cost")])
