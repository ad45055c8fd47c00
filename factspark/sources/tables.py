"""The given tables and the graph tables derived from them.

Each derived table is one SQL text.  The same text runs in Spark (over the given
Parquet files) and in the checking engine (as a leading common table expression), so
both sides of a comparison start from identical rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factspark.session import prepare

GIVEN = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]
# Fixed clocks: one for order and line-item rows, one for the event ledger.
AS_OF = "2002-01-01 00:00:00"
LEDGER_AS_OF = "2024-01-31 00:00:00"


class SparkDialect:
    name = "spark"
    lb, rb = "{{", "}}"  # braces of JSON literals; Spark formats the text once more

    def t(self, table: str) -> str:
        return "{" + table + "}"

    def days(self, expr: str) -> str:
        return f"make_dt_interval(CAST({expr} AS INT))"

    def hours(self, expr: str) -> str:
        return f"make_dt_interval(0, CAST({expr} AS INT))"

    def sha(self, expr: str) -> str:
        return f"sha2({expr}, 256)"


class DuckDialect:
    name = "duckdb"
    lb, rb = "{", "}"

    def t(self, table: str) -> str:
        return table

    def days(self, expr: str) -> str:
        return f"to_days(CAST({expr} AS INT))"

    def hours(self, expr: str) -> str:
        return f"to_hours(CAST({expr} AS INT))"

    def sha(self, expr: str) -> str:
        return f"sha256({expr})"


# name -> (tables it reads, SQL builder)
DERIVED: dict[str, tuple[list[str], Callable]] = {}


def derived(*reads: str):
    def register(builder):
        DERIVED[builder.__name__] = (list(reads), builder)
        return builder

    return register


#: One number per line item from all that tells lines apart; (order, line) alone names several lines.
LINE_ID = ("(l_orderkey * 10 + l_linenumber) * 10000000000 + (l_partkey * 7919 + l_suppkey * 104729"
           " + CAST(round(l_extendedprice * 100) AS BIGINT)) % 10000000000")


@derived("documents")
def x_source(d):
    return f"""SELECT DISTINCT source AS source_id, source AS name,
  CASE CAST(substr(source,4) AS INT) % 5 WHEN 0 THEN 'regulator' WHEN 1 THEN 'primary' WHEN 2 THEN 'trade_press' WHEN 3 THEN 'aggregator' ELSE 'social' END AS kind,
  concat(source, '.example.com') AS domain,
  CASE CAST(substr(source,4) AS INT) % 5 WHEN 0 THEN 95 WHEN 1 THEN 80 WHEN 2 THEN 60 WHEN 3 THEN 50 ELSE 28 END AS base_trust
FROM {d.t('documents')}"""


@derived("documents")
def x_document(d):
    return f"""SELECT doc_id AS document_id, source AS source_id,
  CASE WHEN doc_id % 13 = 0 THEN NULL ELSE concat('https://', CASE WHEN doc_id % 3 = 0 THEN 'www.' ELSE '' END, source, '.example.com/a/', CAST(doc_id AS STRING)) END AS url,
  {d.sha('text')} AS content_sha256, lang, text AS text_content,
  CASE WHEN doc_id % 6 = 0 THEN NULL ELSE text END AS raw_content,
  concat('Title ', CAST(doc_id % 40 AS STRING)) AS title,
  CASE doc_id % 5 WHEN 0 THEN 'fetched' WHEN 1 THEN 'parsed' WHEN 2 THEN 'triaged' WHEN 3 THEN 'skipped' ELSE 'done' END AS pipeline_status,
  CASE WHEN doc_id % 4 = 0 THEN NULL ELSE TIMESTAMP '1995-01-01 00:00:00' + {d.days('doc_id % 3000')} END AS published_at,
  TIMESTAMP '2001-06-01 00:00:00' + {d.hours('doc_id % 5000')} AS fetched_at,
  CASE WHEN doc_id % 10 = 0 THEN CAST(doc_id % 100 AS INT) END AS trust_override
FROM {d.t('documents')}"""


@derived("customer", "supplier", "nation")
def x_entity(d):
    return f"""SELECT concat('C', CAST(c_custkey AS STRING)) AS entity_id, c_name AS canonical_name,
  CASE WHEN c_custkey % 23 = 0 THEN 'funding_program' WHEN c_custkey % 19 = 0 THEN 'person' WHEN c_custkey % 17 = 0 THEN 'asset' WHEN c_custkey % 37 = 0 THEN 'program'
    ELSE CASE c_mktsegment WHEN 'BUILDING' THEN 'facility' WHEN 'HOUSEHOLD' THEN 'end_user' WHEN 'FURNITURE' THEN 'university' ELSE 'company' END END AS entity_type,
  CASE WHEN c_custkey % 31 = 0 THEN 'merged' WHEN c_custkey % 29 = 0 THEN 'dormant' ELSE 'active' END AS status,
  CASE WHEN c_custkey % 31 = 0 THEN concat('C', CAST(c_custkey - CASE WHEN c_custkey % 62 = 0 THEN 31 ELSE 1 END AS STRING)) END AS redirects_to,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CASE c_custkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 20 WHEN 2 THEN 50 ELSE 100 END END AS space_relevance,
  c_custkey % 50 = 0 AS watchlist, c_nationkey AS nation_key,
  TIMESTAMP '2001-06-01 00:00:00' + {d.hours('c_custkey * 7 % 5131')} AS created_at,
  CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 90 AS DOUBLE) END AS latitude,
  CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 170 AS DOUBLE) END AS longitude,
  c_custkey % 6 = 0 AS has_street_address
FROM {d.t('customer')}
UNION ALL SELECT concat('S', CAST(s_suppkey AS STRING)), s_name, CASE WHEN s_suppkey % 3 = 0 THEN 'investor' ELSE 'company' END, 'active', NULL, 100, false, s_nationkey,
  TIMESTAMP '2001-01-01 00:00:00' + {d.hours('s_suppkey')}, NULL, NULL, false FROM {d.t('supplier')}
UNION ALL SELECT concat('N', CAST(n_nationkey AS STRING)), n_name, 'geography', 'active', NULL, NULL, false, n_nationkey,
  TIMESTAMP '2000-01-01 00:00:00' + {d.hours('n_nationkey')},
  CASE WHEN n_nationkey % 4 > 0 THEN n_nationkey + 0.25E0 END, CASE WHEN n_nationkey % 4 > 0 THEN n_nationkey * 2 + 0.5E0 END, false FROM {d.t('nation')}"""


@derived()
def x_attribute_def(d):
    return """SELECT * FROM (VALUES
 ('1-URGENT','employee_count','int','single',180),
 ('2-HIGH','satellite_count','int','single',30),
 ('3-MEDIUM','total_funding_usd','money','multi',30),
 ('4-NOT SPECIFIED','payload_leo_kg','decimal','single',730),
 ('5-LOW','founding_year','int','single',CAST(NULL AS INT))) AS t(src, attribute_key, datatype, cardinality, volatility_days)"""


@derived("orders", "documents", "x_attribute_def")
def x_assertion(d):
    return f"""SELECT o_orderkey AS assertion_id, concat('C', CAST(o_custkey AS STRING)) AS entity_id, d.attribute_key,
  CAST(floor(o_totalprice / 50000) AS DECIMAL(30,10)) AS value_num, CAST(NULL AS STRING) AS value_text,
  CAST(NULL AS BOOLEAN) AS value_bool, CAST(NULL AS DATE) AS value_date,
  CAST(35 + o_orderkey % 60 AS INT) AS confidence,
  CASE WHEN o_orderkey % 13 = 0 THEN 'rejected' WHEN o_orderstatus = 'P' THEN 'candidate' ELSE 'accepted' END AS status,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) - {d.days('o_orderkey % 400')} END AS valid_lower,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS TIMESTAMP) + {d.days('o_orderkey % 300')} END AS valid_upper,
  CAST(o_orderdate AS TIMESTAMP) AS observed_at,
  CASE WHEN o_orderkey % 11 = 0 THEN CAST(o_orderdate AS TIMESTAMP) END AS superseded_at,
  o_orderkey % (SELECT count(*) FROM {d.t('documents')}) AS document_id,
  CASE WHEN o_orderkey % 5 = 0 THEN 'extracted' WHEN o_orderkey % 41 = 0 THEN 'derived' ELSE 'structured_api' END AS method,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat('quote ', CAST(o_orderkey % 900 AS STRING)) END AS quote,
  o_orderkey % 1500 AS run_id
FROM {d.t('orders')} JOIN {d.t('x_attribute_def')} d ON d.src = o_orderpriority"""


@derived("customer", "supplier", "part", "nation")
def x_fact(d):
    """Text-valued claims: location, outputs, inputs, tiers and websites."""
    keys = "CAST(-1 AS BIGINT)"
    out = []
    place = [
        ("headquarters_country", "n_name", "c_custkey % 2 = 0", 0),
        ("headquarters_city", "concat('NATION_', CAST((c_nationkey + c_custkey % 2) % 25 AS STRING))", "c_custkey % 5 < 3", 1),
        ("headquarters_address", "concat(CAST(c_custkey AS STRING), ' Main St, ', CAST(10000 + c_custkey % 80000 AS STRING), ' ', n_name, ', Land')", "c_custkey % 7 = 1", 2),
        ("website", "concat(CASE WHEN c_custkey % 3 = 0 THEN 'https://www.' WHEN c_custkey % 3 = 1 THEN 'http://' ELSE '' END, 'site', CAST(c_custkey % 400 AS STRING), CASE WHEN c_custkey % 11 = 0 THEN '' ELSE '.example.org/about' END)", "c_custkey % 3 < 2", 3),
    ]
    for key, value, where, tag in place:
        out.append(f"""SELECT c_custkey * 16 + {tag} AS assertion_id, concat('C', CAST(c_custkey AS STRING)) AS entity_id, '{key}' AS attribute_key,
  {value} AS value_text, CAST(50 + c_custkey % 45 AS INT) AS confidence,
  CASE c_custkey % 9 WHEN 0 THEN 'candidate' WHEN 1 THEN 'rejected' ELSE 'accepted' END AS status, 'structured_api' AS method,
  CASE WHEN c_custkey % 13 = 0 THEN TIMESTAMP '2001-01-01 00:00:00' END AS superseded_at,
  TIMESTAMP '2000-01-01 00:00:00' + {d.days('c_custkey % 700')} AS observed_at
  FROM {d.t('customer')} JOIN {d.t('nation')} ON n_nationkey = c_nationkey WHERE {where}""")
    tiers = "concat(CASE p_type WHEN 'ECONOMY' THEN 'upstream' WHEN 'STANDARD' THEN 'midstream' WHEN 'PROMO' THEN 'downstream' WHEN 'SMALL' THEN 'component' ELSE 'institutional' END, '.', CASE WHEN p_size % 6 = 0 THEN 'launch' ELSE lower(replace(p_brand, '#', '_')) END, '.x')"
    owner = f"CASE WHEN p_partkey % 3 = 0 THEN concat('C', CAST(p_partkey % 500 AS STRING)) ELSE concat('S', CAST(p_partkey % (SELECT count(*) FROM {d.t('supplier')}) AS STRING)) END"
    for key, value, where, tag in [
        ("output", "p_name", "p_partkey % 4 < 2", 8),
        ("input", "concat(p_type, ' ', p_name)", "p_partkey % 4 = 2", 9),
        ("value_chain_tier", tiers, "p_partkey % 8 < 3", 10),
    ]:
        out.append(f"""SELECT p_partkey * 16 + {tag}, {owner}, '{key}', {value}, CAST(50 + p_size AS INT),
  CASE p_size % 7 WHEN 0 THEN 'rejected' WHEN 1 THEN 'candidate' ELSE 'accepted' END, 'structured_api',
  CASE WHEN p_size % 10 = 0 THEN TIMESTAMP '2001-01-01 00:00:00' END,
  TIMESTAMP '2000-01-01 00:00:00' + {d.days('p_partkey % 700')} FROM {d.t('part')} WHERE {where}""")
    return "\nUNION ALL ".join(out)


@derived("lineitem")
def x_event(d):
    return f"""SELECT {LINE_ID} AS event_id,
  CASE WHEN l_orderkey % 6 = 0 THEN concat('C', CAST(l_partkey % 1400 AS STRING)) ELSE concat('S', CAST(l_suppkey AS STRING)) END AS entity_id,
  CASE concat(l_returnflag, l_linestatus) WHEN 'AF' THEN 'funding_round' WHEN 'AO' THEN 'grant_call' WHEN 'NF' THEN 'ipo' WHEN 'NO' THEN 'grant_award' WHEN 'RF' THEN 'debt_financing' ELSE CASE WHEN l_linenumber < 4 THEN 'publication' ELSE 'research_grant' END END AS event_type,
  concat('Round ', CAST(l_partkey % 5 AS STRING)) AS title,
  concat('Part ', CAST(l_partkey AS STRING), ' shipped in lot ', CAST(l_suppkey % 7 AS STRING), repeat(' and again', CAST(l_linenumber % 3 AS INT))) AS description,
  CASE WHEN l_orderkey % 37 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS date,
  CASE WHEN l_orderkey % 29 = 0 THEN NULL ELSE CAST(l_extendedprice AS DECIMAL(20,2)) END AS amount_usd,
  CAST(40 + l_partkey % 60 AS INT) AS confidence,
  CASE l_orderkey % 5 WHEN 0 THEN 'open' WHEN 1 THEN 'closed' WHEN 2 THEN 'upcoming' END AS call_status,
  CASE WHEN l_orderkey % 4 = 0 THEN concat('https://calls.example.com/', CAST(l_partkey AS STRING)) END AS call_url,
  TIMESTAMP '2001-06-01 00:00:00' + {d.hours('l_orderkey % 5132')} AS created_at,
  l_partkey % 250 AS source_document_id
FROM {d.t('lineitem')} l"""


@derived("lineitem", "orders")
def x_participant(d):
    return f"""SELECT {LINE_ID} AS event_id, concat('C', CAST(o_custkey AS STRING)) AS entity_id
FROM {d.t('lineitem')} l JOIN {d.t('orders')} ON o_orderkey = l_orderkey WHERE l_linenumber % 2 = 1"""


@derived("lineitem", "orders")
def x_relation(d):
    return f"""SELECT {LINE_ID} AS relation_id,
  CASE WHEN l_linenumber = 7 AND l_orderkey % 3 = 0 THEN concat('C', CAST(l_partkey % 1400 AS STRING)) ELSE concat('S', CAST(l_suppkey AS STRING)) END AS subject_id,
  CASE l_linenumber WHEN 1 THEN 'supplies' WHEN 2 THEN 'contracted_by' WHEN 3 THEN 'customer_of' WHEN 4 THEN 'manufactures' WHEN 5 THEN 'administers' WHEN 6 THEN 'invested_in' ELSE CASE WHEN l_orderkey % 3 = 0 THEN 'has_office_in' ELSE 'partnered_with' END END AS predicate,
  CASE WHEN l_linenumber = 7 AND l_orderkey % 3 = 0 THEN CASE WHEN l_orderkey % 21 = 0 THEN concat('C', CAST(o_custkey AS STRING)) ELSE concat('N', CAST(o_custkey % 25 AS STRING)) END ELSE concat('C', CAST(o_custkey AS STRING)) END AS object_id,
  CAST(30 + l_partkey % 70 AS INT) AS confidence,
  CASE WHEN 30 + l_partkey % 70 >= 65 THEN 'accepted' ELSE 'candidate' END AS status,
  l_partkey % 250 AS document_id,
  CASE l_suppkey % 4 WHEN 0 THEN concat('{d.lb}"product":"p', CAST(l_partkey % 50 AS STRING), '"{d.rb}')
    WHEN 1 THEN concat('{d.lb}"address":"', CAST(l_partkey AS STRING), ' Road","office_type":"hq"{d.rb}')
    WHEN 2 THEN concat('{d.lb}"address":"x","lat":', CAST(l_partkey % 80 AS STRING), '.5,"lon":', CAST(l_partkey % 100 AS STRING), '.25{d.rb}') END AS qualifiers,
  CAST(l_shipdate AS TIMESTAMP) AS observed_at,
  CASE WHEN l_orderkey % 19 = 0 THEN CAST(l_shipdate AS TIMESTAMP) END AS superseded_at
FROM {d.t('lineitem')} l JOIN {d.t('orders')} ON o_orderkey = l_orderkey"""


@derived("customer", "part")
def x_alias(d):
    return f"""SELECT concat('C', CAST(c_custkey AS STRING)) AS entity_id,
  concat(p_name, CASE c_custkey % 4 WHEN 0 THEN ' Inc.' WHEN 1 THEN ' Labs' WHEN 2 THEN '' ELSE concat(' ', CAST(c_custkey % 9 AS STRING)) END) AS alias
FROM {d.t('customer')} JOIN {d.t('part')} ON p_partkey = c_custkey % 1000"""


@derived("documents")
def x_fragment(d):
    return f"""SELECT doc_id AS fragment_id, CASE WHEN doc_id % 3 = 0 THEN concat('S', CAST(doc_id % 10 AS STRING)) ELSE concat('C', CAST(doc_id AS STRING)) END AS entity_id,
  CASE doc_id % 4 WHEN 0 THEN 'research' WHEN 1 THEN 'technical' WHEN 2 THEN 'strategic' ELSE 'financial' END AS category,
  text, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE DATE '1999-01-01' + CAST(doc_id % 1000 AS INT) END AS date_of_information,
  CAST(40 + doc_id % 50 AS INT) AS confidence, TIMESTAMP '2001-06-01 00:00:00' + {d.hours('doc_id * 5 % 5133')} AS created_at
FROM {d.t('documents')}"""


@derived("customer")
def x_summary(d):
    return f"""SELECT concat('C', CAST(c_custkey AS STRING)) AS entity_id, concat('Overview of ', c_name) AS overview, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE CAST(c_custkey % 12 AS INT) END AS source_count
FROM {d.t('customer')} WHERE c_custkey % 2 = 0"""


@derived("part")
def x_node(d):
    return f"""SELECT DISTINCT facet, path, path AS label, concat('Definition of ', path) AS definition,
  CASE WHEN length(path) % 5 = 0 THEN 'proposed' WHEN length(path) % 13 = 0 THEN 'deprecated' ELSE 'active' END AS status,
  CASE facet WHEN 'orbit_regime' THEN 'deprecated' ELSE 'active' END AS facet_status
FROM (SELECT CASE WHEN p_size % 5 = 0 THEN 'orbit_regime' WHEN p_size % 2 = 0 THEN 'value_chain' ELSE 'maturity' END AS facet,
  concat(lower(p_type), '.', lower(replace(p_brand, '#', '_'))) AS path FROM {d.t('part')}) n"""


@derived("part")
def x_classification(d):
    return f"""SELECT p_partkey AS classification_id, concat('C', CAST(p_partkey % 150 AS STRING)) AS entity_id,
  CASE WHEN p_size % 5 = 0 THEN 'orbit_regime' WHEN p_size % 2 = 0 THEN 'value_chain' ELSE 'maturity' END AS facet,
  concat(lower(p_type), '.', lower(replace(p_brand, '#', '_'))) AS path,
  p_size % 3 = 0 AS is_primary, CAST(p_size / 50.0 AS DECIMAL(4,3)) AS weight
FROM {d.t('part')}"""


@derived("events")
def x_call(d):
    """Model calls: the cost ledger."""
    return f"""SELECT event_id AS call_id, concat('C', CAST(user_id AS STRING)) AS entity_id,
  CASE event_type WHEN 'error' THEN 'triage' WHEN 'click' THEN 'extract' WHEN 'view' THEN 'resolve' WHEN 'signup' THEN 'analysis' ELSE 'dedup' END AS task,
  concat('model-', CAST(user_id % 3 AS STRING)) AS model, CAST(floor(value * 10) AS INT) AS tokens_in, CAST(floor(value) AS INT) AS tokens_out, CAST(ts AS TIMESTAMP) AS called_at
FROM {d.t('events')}"""


@derived()
def x_rate(d):
    return "SELECT * FROM (VALUES ('model-0', 0.00059E0, 0.00079E0), ('model-1', 0.003E0, 0.015E0)) AS t(model, rate_in, rate_out)"


@derived("events", "customer")
def x_run(d):
    """Research runs; topics are entity names, some in another case, some unknown."""
    return f"""SELECT event_id AS run_id, concat('research_', CASE event_id % 3 WHEN 0 THEN 'company' WHEN 1 THEN 'question' ELSE 'person' END) AS task,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'running' ELSE 'completed' END AS status,
  CASE event_id % 11 WHEN 0 THEN NULL WHEN 1 THEN concat('{d.lb}"topic":"unknown ', CAST(event_id % 70 AS STRING), '"{d.rb}') WHEN 2 THEN concat('{d.lb}"topic":"CUSTOMER#', lpad(CAST(event_id % (SELECT count(*) FROM {d.t('customer')}) AS STRING), 9, '0'), '"{d.rb}')
    ELSE concat('{d.lb}"topic":"Customer#', lpad(CAST(event_id % (SELECT count(*) FROM {d.t('customer')}) AS STRING), 9, '0'), '"{d.rb}') END AS stats,
  CAST(ts AS TIMESTAMP) AS started_at
FROM {d.t('events')}"""


@derived("customer")
def x_feed(d):
    return f"""SELECT c_custkey AS feed_id, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE concat('C', CAST(c_custkey AS STRING)) END AS entity_hint,
  CASE c_custkey % 4 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' WHEN 2 THEN 'monthly' ELSE 'event_driven' END AS cadence,
  c_custkey % 6 > 0 AS is_active,
  CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE TIMESTAMP '2002-01-01 00:00:00' - {d.hours('c_custkey % 900')} END AS last_checked_at
FROM {d.t('customer')}"""


@derived("customer")
def x_identifier(d):
    return f"""SELECT concat('C', CAST(c_custkey AS STRING)) AS entity_id, 'wikidata' AS scheme,
  concat('Q', CAST(c_custkey % 700 AS STRING)) AS value FROM {d.t('customer')} WHERE c_custkey % 4 = 1
UNION ALL SELECT concat('C', CAST(c_custkey AS STRING)), 'domain', concat('site', CAST(c_custkey % 300 AS STRING), '.example.org') FROM {d.t('customer')} WHERE c_custkey % 9 = 4"""


def derived_sql(name: str, dialect) -> str:
    return DERIVED[name][1](dialect)


class Tables:
    """Lazy access to given and derived tables of one scale folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = prepare(spark)
        self.folder = str(folder).rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in DERIVED and name not in GIVEN:
            raise AttributeError(name)
        if name not in self._cache:
            if name in GIVEN:
                frame = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                reads = {r: getattr(self, r) for r in DERIVED[name][0]}
                frame = self.spark.sql(derived_sql(name, SparkDialect()), **reads)
            self._cache[name] = frame
        return self._cache[name]


def with_derived(sql: str) -> str:
    """Prefix a checking query with the derived tables it mentions."""
    text = re.sub(r"^\s*WITH\s+(RECURSIVE\s+)?", "", sql, flags=re.I) if re.match(r"^\s*WITH\b", sql, re.I) else None
    needed: list[str] = []

    def visit(name):
        for dep in DERIVED[name][0]:
            if dep in DERIVED:
                visit(dep)
        if name not in needed:
            needed.append(name)

    for name in DERIVED:
        if re.search(rf"\b{name}\b", sql):
            visit(name)
    parts = [f"{n} AS ({derived_sql(n, DuckDialect())})" for n in needed]
    if text is not None:
        return "WITH RECURSIVE " + ",\n".join(parts + [text]) if parts else "WITH RECURSIVE " + text
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" + sql) if parts else sql
