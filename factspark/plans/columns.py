"""Registered queries of the column-level computations."""

from __future__ import annotations

from pyspark.sql import functions as F

from factspark.functions import names, trust, values, vocab
from factspark.operators import entities as ent
from factspark.sources.tables import AS_OF

from .registry import query

def at():
    return F.lit(AS_OF).cast("timestamp")


def sql_list(items) -> str:
    return ", ".join("'" + i.replace("'", "''") + "'" for i in items)


def sql_case_map(expr: str, mapping: dict) -> str:
    def lit(v):
        return f"'{v}'" if isinstance(v, str) else str(v)

    return f"CASE {expr} " + " ".join(f"WHEN '{k}' THEN {lit(v)}" for k, v in mapping.items()) + " END"


SUFFIX_RE = "(?:" + "|".join(vocab.NAME_SUFFIXES) + ")"


def sql_norm(expr: str) -> str:
    folded = f"trim(regexp_replace(lower({expr}), '[^a-z0-9_]+', ' ', 'g'))"
    return (
        f"CASE WHEN regexp_full_match({folded}, '{SUFFIX_RE}( {SUFFIX_RE})*') THEN {folded} "
        f"ELSE regexp_replace({folded}, '( {SUFFIX_RE})+$', '') END"
    )


def sql_domain(expr: str) -> str:
    return f"regexp_replace(lower(regexp_extract(coalesce({expr}, ''), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)), '^www\\.', '')"


def sql_domain_trust(expr: str) -> str:
    host = sql_domain(expr)
    ends = " ".join(f"WHEN ends_with({host}, '{e}') THEN {t}" for e, t in vocab.DOMAIN_ENDING_TRUST)
    return f"coalesce({sql_case_map(host, vocab.DOMAIN_TRUST)}, CASE {ends} ELSE {vocab.DEFAULT_TRUST} END)"


def sql_odds(expr: str) -> str:
    t = f"CAST(least(greatest({expr}, 0), 100) AS DOUBLE)"
    return f"({t} / greatest(1.0::DOUBLE, 100.0::DOUBLE - {t}))"


def sql_conf(odds: str) -> str:
    return f"CAST(least(greatest(round_even(100.0::DOUBLE * (({odds}) / (1.0::DOUBLE + ({odds}))), 0), 1.0), 99.0) AS INT)"


def sql_trigrams(expr: str) -> str:
    return (
        f"list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({expr}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) > 0), "
        "lambda w: list_transform(generate_series(1, length(w) + 1), lambda i: substr('  ' || w || ' ', i, 3)))))"
    )


def sql_jaccard(a: str, b: str) -> str:
    shared = f"len(list_intersect({a}, {b}))"
    return f"({shared} / (len({a}) + len({b}) - {shared}))"


def sql_words(expr: str) -> str:
    return f"list_distinct(list_filter(string_split_regex(lower({expr}), '\\s+'), lambda w: length(w) > 0))"


@query("normalize_names", f"SELECT entity_id, alias, {sql_norm('alias')} AS alias_norm FROM x_alias")
def _(t):
    return t.x_alias.withColumn("alias_norm", names.normalize_name(F.col("alias")))


COUNTRY_ORACLE = """SELECT n_nationkey, raw,
 CASE WHEN length(trim(raw)) = 2 THEN CASE WHEN upper(trim(raw)) IN ({codes}) THEN upper(trim(raw)) END
 ELSE {names} END AS iso2
FROM (SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN ' France.' WHEN 1 THEN 'us' WHEN 2 THEN 'The  Netherlands' WHEN 3 THEN n_name ELSE 'xx' END AS raw FROM nation
 UNION ALL SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'UK' WHEN 1 THEN 'U.S.A.' WHEN 2 THEN 'south  korea' ELSE c_mktsegment END FROM customer) r""".format(
    codes=sql_list(sorted(set(vocab.COUNTRY_CODES.values()))),
    names=sql_case_map("trim(regexp_replace(trim(regexp_replace(lower(trim(raw)), '\\s+', ' ', 'g')), '\\.+$', ''))", vocab.COUNTRY_CODES),
)


@query("normalize_countries", COUNTRY_ORACLE)
def _(t):
    raw = t.nation.select(
        F.col("n_nationkey").cast("long").alias("n_nationkey"),
        F.expr("CASE n_nationkey % 5 WHEN 0 THEN ' France.' WHEN 1 THEN 'us' WHEN 2 THEN 'The  Netherlands' WHEN 3 THEN n_name ELSE 'xx' END").alias("raw"),
    ).union(
        t.customer.select(
            "c_custkey",
            F.expr("CASE c_custkey % 4 WHEN 0 THEN 'UK' WHEN 1 THEN 'U.S.A.' WHEN 2 THEN 'south  korea' ELSE c_mktsegment END"),
        )
    )
    return raw.withColumn("iso2", names.normalize_country(F.col("raw")))


@query(
    "country_backfill",
    """SELECT count(*) FILTER (WHERE iso2 IS NOT NULL AND iso2 <> value_text) AS changed,
 count(*) FILTER (WHERE iso2 IS NULL OR iso2 = value_text) AS unchanged
FROM (SELECT value_text, CASE WHEN length(value_text) = 2 THEN value_text END AS iso2 FROM (
  SELECT CASE assertion_id % 3 WHEN 0 THEN 'FR' ELSE value_text END AS value_text FROM x_fact WHERE attribute_key = 'headquarters_country') a) b""",
)
def _(t):
    facts = t.x_fact.withColumn(
        "value_text", F.when(F.col("assertion_id") % 3 == 0, "FR").otherwise(F.col("value_text"))
    )
    return ent.country_backfill(facts)[1]


@query("domain_trust", f"SELECT page_id, {sql_domain_trust('url')} AS trust FROM pages")
def _(t):
    return t.pages.select("page_id", trust.domain_trust(F.col("url")).alias("trust"))


@query(
    "document_domain",
    f"SELECT document_id, coalesce(nullif({sql_domain('d.url')}, ''), regexp_replace(lower(s.domain), '^www\\.', '')) AS domain FROM x_document d JOIN x_source s USING (source_id)",
)
def _(t):
    return ent.documents_with_source(t.x_document, t.x_source).select("document_id", "domain")


@query(
    "effective_trust",
    "SELECT document_id, CAST(coalesce(trust_override, base_trust) AS INT) AS trust FROM x_document JOIN x_source USING (source_id)",
)
def _(t):
    return ent.documents_with_source(t.x_document, t.x_source).select("document_id", "trust")


@query(
    "combine_trust",
    f"""SELECT doc_id, {sql_conf(sql_odds('base') + " * greatest(1.0, " + sql_odds('t1') + ") * greatest(1.0, " + sql_odds('t2') + ")")} AS confidence
FROM (SELECT doc_id, CAST(doc_id % 101 AS INT) AS base, CAST(n_chars % 101 AS INT) AS t1, CAST((doc_id * 7) % 101 AS INT) AS t2 FROM documents) d""",
)
def _(t):
    d = t.documents
    base = (F.col("doc_id") % 101).cast("int")
    trusts = F.array((F.col("n_chars") % 101).cast("int"), (F.col("doc_id") * 7 % 101).cast("int"))
    return d.select("doc_id", trust.combine_trust(base, trusts).alias("confidence"))


@query(
    "relation_bump",
    """SELECT relation_id, CAST(c AS INT) AS confidence, CASE WHEN c >= 65 THEN 'accepted' ELSE status END AS status FROM (
 SELECT relation_id, status, least(99, confidence + greatest(3, CAST(floor((100 - confidence) * (relation_id % 101) / 300.0::DOUBLE) AS INT))) AS c FROM x_relation) r""",
)
def _(t):
    bumped = trust.relation_bump(F.col("confidence"), F.col("relation_id") % 101)
    return t.x_relation.select("relation_id", bumped.alias("confidence"), "status").withColumn(
        "status", F.when(F.col("confidence") >= 65, "accepted").otherwise(F.col("status"))
    )


STALE_SQL = """CAST(greatest(0, CAST(floor((epoch_us(TIMESTAMP '2002-01-01') - epoch_us(coalesce(valid_lower, observed_at))) / 86400000000) AS INT) - coalesce(volatility_days, 3650)) AS INT)"""


@query(
    "staleness",
    f"""SELECT assertion_id, days_stale, round_even(days_stale / greatest(coalesce(volatility_days, 3650), 1), 2) AS periods_stale, days_stale > 0 AS stale
FROM (SELECT assertion_id, volatility_days, {STALE_SQL} AS days_stale FROM x_assertion JOIN x_attribute_def USING (attribute_key)) s""",
)
def _(t):
    a = t.x_assertion.join(t.x_attribute_def, "attribute_key")
    anchor = F.coalesce("valid_lower", "observed_at")
    return a.select(
        "assertion_id",
        trust.days_stale(anchor, F.col("volatility_days"), at()).alias("days_stale"),
        trust.periods_stale(anchor, F.col("volatility_days"), at()).alias("periods_stale"),
    ).withColumn("stale", F.col("days_stale") > 0)


def sql_tenths(share):
    """One decimal by the exact binary value, halves to even: times 2 ** 56 the share is a whole number."""
    parts = f"(CAST({share} * 72057594037927936.0::DOUBLE AS BIGINT) * 10)"
    return f"(({parts} >> 56) + CAST({parts} % 72057594037927936 * 2 + ({parts} >> 56) % 2 > 72057594037927936 AS BIGINT)) / 10.0::DOUBLE"


TRUST_SQL = sql_tenths("greatest(0.1::DOUBLE, least(1.0::DOUBLE, confidence / 100.0::DOUBLE - least(0.7::DOUBLE, 0.05::DOUBLE * round_even(days_stale / greatest(coalesce(volatility_days, 3650), 1), 2))))")


@query(
    "display_trust",
    f"SELECT assertion_id, {TRUST_SQL} AS trust FROM (SELECT assertion_id, confidence, volatility_days, {STALE_SQL} AS days_stale FROM x_assertion JOIN x_attribute_def USING (attribute_key)) s",
)
def _(t):
    a = t.x_assertion.join(t.x_attribute_def, "attribute_key")
    anchor = F.coalesce("valid_lower", "observed_at")
    return a.select(
        "assertion_id",
        trust.display_trust(F.col("confidence"), anchor, F.col("volatility_days"), at()).alias("trust"),
    )


EFFECTIVE_SQL = """CAST(greatest(a.confidence - CASE WHEN d.volatility_days IS NULL THEN 0 ELSE
  CAST(least(30, floor(greatest(0, (epoch_us(TIMESTAMP '2002-01-01') - epoch_us(coalesce(a.valid_lower, a.observed_at))) / 86400000000.0::DOUBLE - d.volatility_days) / greatest(d.volatility_days, 1) * 10)) AS INT) END, 0) AS INT)"""


@query(
    "effective_confidence",
    f"SELECT assertion_id, {EFFECTIVE_SQL} AS effective_confidence FROM x_assertion a LEFT JOIN x_attribute_def d USING (attribute_key)",
)
def _(t):
    a = t.x_assertion.join(t.x_attribute_def, "attribute_key", "left")
    score = trust.effective_confidence(
        F.col("confidence"), F.coalesce("valid_lower", "observed_at"), F.col("volatility_days"), at()
    )
    return a.select("assertion_id", score.alias("effective_confidence"))


@query(
    "type_values",
    """SELECT id, CASE WHEN dt IN ('int','decimal','money') THEN TRY_CAST(raw AS DOUBLE) END AS value_num,
 CASE WHEN dt = 'date' THEN TRY_CAST(CASE WHEN regexp_full_match(raw, '\\d{4}-\\d{1,2}-\\d{1,2}') THEN raw END AS DATE) END AS value_date,
 CASE WHEN dt = 'bool' THEN lower(raw) NOT IN ('', 'false', '0') END AS value_bool,
 CASE WHEN dt IN ('int','decimal','money') AND TRY_CAST(raw AS DOUBLE) IS NOT NULL THEN NULL
      WHEN dt = 'date' AND TRY_CAST(CASE WHEN regexp_full_match(raw, '\\d{4}-\\d{1,2}-\\d{1,2}') THEN raw END AS DATE) IS NOT NULL THEN NULL
      WHEN dt = 'bool' THEN NULL ELSE substr(raw, 1, 500) END AS value_text
FROM (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'int' WHEN 1 THEN 'date' WHEN 2 THEN 'bool' WHEN 3 THEN 'money' ELSE 'text' END AS dt,
 CASE o_orderkey % 7 WHEN 0 THEN CAST(o_orderkey AS VARCHAR) WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN 'false' WHEN 3 THEN '1e3' WHEN 4 THEN '12.50' WHEN 5 THEN '2001-02-30' ELSE o_orderpriority END AS raw FROM orders) r""",
)
def _(t):
    o = t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.expr("CASE o_orderkey % 5 WHEN 0 THEN 'int' WHEN 1 THEN 'date' WHEN 2 THEN 'bool' WHEN 3 THEN 'money' ELSE 'text' END").alias("dt"),
        F.expr("CASE o_orderkey % 7 WHEN 0 THEN CAST(o_orderkey AS STRING) WHEN 1 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 2 THEN 'false' WHEN 3 THEN '1e3' WHEN 4 THEN '12.50' WHEN 5 THEN '2001-02-30' ELSE o_orderpriority END").alias("raw"),
    )
    typed = values.typed_value(F.col("raw"), F.lit(None).cast("string"), F.col("dt"))
    return o.select("id", *[typed[k].alias(k) for k in ("value_num", "value_date", "value_bool", "value_text")])


@query(
    "parse_flexible_dates",
    """SELECT id, TRY_CAST(CASE WHEN length(raw) >= 10 THEN substr(raw, 1, 10) WHEN length(raw) = 7 THEN raw || '-01' WHEN length(raw) = 4 THEN raw || '-01-01' END AS DATE) AS date,
 CASE WHEN length(raw) >= 10 THEN 'day' WHEN length(raw) = 7 THEN 'month' ELSE 'year' END AS date_precision
FROM (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T00:00' WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y') WHEN 3 THEN '2001-02-30' ELSE 'soon' END AS raw FROM orders) o""",
)
def _(t):
    raw = F.expr("CASE o_orderkey % 5 WHEN 0 THEN concat(date_format(o_orderdate, 'yyyy-MM-dd'), 'T00:00') WHEN 1 THEN date_format(o_orderdate, 'yyyy-MM') WHEN 2 THEN date_format(o_orderdate, 'yyyy') WHEN 3 THEN '2001-02-30' ELSE 'soon' END")
    date, precision = values.flexible_date(raw)
    return t.orders.select(F.col("o_orderkey").alias("id"), date.alias("date"), precision.alias("date_precision"))


@query(
    "parse_addresses",
    """SELECT assertion_id, CASE WHEN p >= 2 THEN CASE WHEN p >= 3 AND length(parts[2]) <= 6 THEN parts[1] || ' ' || parts[2] ELSE parts[1] END END AS street,
 CASE WHEN p > 0 THEN regexp_extract(parts[p], '\\b(\\d{4,6})\\b', 1) END AS postalcode,
 CASE WHEN p > 0 THEN nullif(trim(regexp_extract(parts[p], '^.*?\\b\\d{4,6}\\b(.*)$', 1)), '') END AS city,
 CASE WHEN p > 0 AND len(parts) > 1 THEN parts[len(parts)] END AS country
FROM (SELECT *, coalesce(list_position(list_transform(parts, lambda x: regexp_matches(x, '\\b\\d{4,6}\\b')), true), 0) AS p FROM (
 SELECT assertion_id, list_filter(list_transform(string_split(value_text, ','), lambda x: trim(x)), lambda x: length(x) > 0) AS parts FROM x_fact
 WHERE attribute_key IN ('headquarters_address', 'headquarters_city')) a) b""",
)
def _(t):
    facts = t.x_fact.filter(F.col("attribute_key").isin("headquarters_address", "headquarters_city"))
    return facts.select("assertion_id", values.address_parts(F.col("value_text")).alias("a")).select(
        "assertion_id", "a.street", "a.postalcode", "a.city", "a.country"
    )


WEBSITE_SQL = "regexp_replace(regexp_replace(lower(regexp_extract(CASE WHEN contains({0}, '://') THEN {0} ELSE 'https://' || {0} END, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)), '^www\\.', ''), '^/+|/+$', '', 'g')"


@query(
    "website_domains",
    f"SELECT assertion_id, CASE WHEN contains(h, '.') THEN h END AS domain FROM (SELECT assertion_id, {WEBSITE_SQL.format('value_text')} AS h FROM x_fact WHERE attribute_key = 'website') w",
)
def _(t):
    return t.x_fact.filter("attribute_key = 'website'").select(
        "assertion_id", values.website_domain(F.col("value_text")).alias("domain")
    )


@query(
    "normalize_qids",
    """SELECT c_custkey, CASE WHEN regexp_full_match(tail, 'Q[0-9]+') THEN tail END AS qid FROM (
 SELECT c_custkey, CASE WHEN starts_with(v, 'HTTP') THEN regexp_extract(v, '([^/]*)$', 1) ELSE v END AS tail FROM (
 SELECT c_custkey, upper(trim(CASE c_custkey % 4 WHEN 0 THEN concat(' q', c_custkey, ' ') WHEN 1 THEN concat('http://reg.example.org/entity/Q', c_custkey) WHEN 2 THEN c_name ELSE concat('Q', c_custkey, 'x') END)) AS v FROM customer) a) b""",
)
def _(t):
    raw = F.expr("CASE c_custkey % 4 WHEN 0 THEN concat(' q', c_custkey, ' ') WHEN 1 THEN concat('http://reg.example.org/entity/Q', c_custkey) WHEN 2 THEN c_name ELSE concat('Q', c_custkey, 'x') END")
    return t.customer.select("c_custkey", values.normalize_qid(raw).alias("qid"))


@query(
    "unique_slugs",
    """WITH b AS (SELECT entity_id, trim(regexp_replace(regexp_replace(lower(trim(alias)), '[^a-z0-9_ -]', '', 'g'), '[- ]+', '-', 'g'), '-_') AS base FROM x_alias),
 n AS (SELECT entity_id, base, row_number() OVER (PARTITION BY base ORDER BY entity_id) - 1 AS k FROM b)
SELECT entity_id, CASE WHEN k = 0 THEN base ELSE concat(base, '-', k) END AS slug FROM n""",
)
def _(t):
    return ent.unique_slugs(t.x_alias.select("entity_id", F.col("alias").alias("name")), None)


PRIORITY_SQL = """SELECT entity_id, round(greatest(CASE WHEN last_obs IS NULL THEN 365 ELSE floor((epoch_us(TIMESTAMP '2002-01-01') - epoch_us(last_obs)) / 86400000000) END / 180.0::DOUBLE
 * CASE WHEN watchlist THEN 2.0 ELSE 1.0 END * CASE WHEN status = 'dormant' THEN 0.3::DOUBLE ELSE 1.0 END * ln(1 + coalesce(n, 0)), 0.01), 6) AS priority
FROM x_entity LEFT JOIN (SELECT entity_id, max(observed_at) AS last_obs, count(*) AS n FROM x_assertion GROUP BY entity_id) a USING (entity_id)"""


@query("entity_priority", PRIORITY_SQL)
def _(t):
    return ent.entity_priority(t.x_entity, t.x_assertion, at()).select(
        "entity_id", F.round("priority", 6).alias("priority")
    )


COST_SQL = "round_even(tokens_in / 1000.0::DOUBLE * coalesce(rate_in, 0.001::DOUBLE) + tokens_out / 1000.0::DOUBLE * coalesce(rate_out, 0.003::DOUBLE), 6)"


@query("estimate_cost", f"SELECT call_id, {COST_SQL} AS cost_usd FROM x_call LEFT JOIN x_rate USING (model)")
def _(t):
    return ent.priced_calls(t.x_call, t.x_rate).select("call_id", "cost_usd")


def _sql_any(expr, terms):
    return "(" + " OR ".join(f"contains({expr}, '{w}')" for w in terms) + ")"


@query(
    "keyword_relevance",
    f"""SELECT entity_id, CASE WHEN entity_type = 'geography' THEN false WHEN entity_type IN ({sql_list(vocab.ALWAYS_RELEVANT_TYPES)}) THEN true
 WHEN {_sql_any('n', vocab.FIELD_WORDS)} THEN true WHEN {_sql_any('n', vocab.OFF_FIELD_WORDS)} THEN false ELSE true END AS relevant
FROM (SELECT entity_id, entity_type, lower(CASE length(canonical_name) + nation_key WHEN 25 THEN concat(canonical_name, ' Retail Bank') WHEN 26 THEN concat(canonical_name, ' Lunar Steel Manufacturer') ELSE canonical_name END) AS n FROM x_entity) e""",
)
def _(t):
    name = F.expr("CASE length(canonical_name) + nation_key WHEN 25 THEN concat(canonical_name, ' Retail Bank') WHEN 26 THEN concat(canonical_name, ' Lunar Steel Manufacturer') ELSE canonical_name END")
    return t.x_entity.select("entity_id", names.keyword_relevance(name, F.col("entity_type")).alias("relevant"))


@query(
    "lookup_eligible",
    f"""SELECT entity_id, length(regexp_replace(alias, '[ .]', '', 'g')) <= 6 OR NOT regexp_full_match(regexp_replace(alias, '[ .]', '', 'g'), '[\\x00-\\x7F]*')
 OR rtrim(lower(regexp_extract(trim(alias), '(\\S+)$', 1)), '.') NOT IN ({sql_list(vocab.LEGAL_SUFFIXES)}) AS eligible FROM x_alias""",
)
def _(t):
    return t.x_alias.select("entity_id", names.lookup_eligible(F.col("alias")).alias("eligible"))


CALL_SQL = """CASE WHEN event_type = 'grant_call' THEN CASE WHEN date < DATE '2002-01-01' THEN 'closed' WHEN coalesce(call_status, '') <> '' THEN call_status WHEN date IS NOT NULL THEN 'open' ELSE 'closed' END END"""


@query("call_status", f"SELECT event_id, {CALL_SQL.replace('2002-01-01', '1999-01-01')} AS display_status FROM x_event")
def _(t):
    status = values.call_status(F.col("event_type"), F.col("date"), F.col("call_status"), F.lit("1999-01-01").cast("date"))
    return t.x_event.select("event_id", status.alias("display_status"))


LEVEL_SQL = f"CASE WHEN split_part(value_text, '.', 1) IN ({sql_list(vocab.LEVELS)}) THEN split_part(value_text, '.', 1) ELSE {sql_case_map('split_part(value_text, chr(46), 1)', vocab.FLAT_TIER_LEVEL)} END"


@query("tier_level", f"SELECT assertion_id, {LEVEL_SQL} AS level FROM x_fact WHERE attribute_key IN ('value_chain_tier', 'output')")
def _(t):
    f = t.x_fact.filter(F.col("attribute_key").isin("value_chain_tier", "output"))
    return f.select("assertion_id", values.tier_level(F.col("value_text")).alias("level"))


@query(
    "clean_tiers",
    f"""SELECT id, tier FROM (SELECT id, trim(trim(unnest(string_split_regex(raw, '[;,]'))), '''"[] ') AS tier FROM (
 SELECT p_partkey AS id, concat('["', CASE WHEN p_size % 2 = 0 THEN 'upstream' ELSE p_type END, '.', p_size, '"; ''downstream.x''', CASE WHEN p_size % 3 = 0 THEN ', bogus.y,' ELSE '' END, ']') AS raw FROM part) a) b
 WHERE length(tier) > 0 AND split_part(tier, '.', 1) IN ({sql_list(vocab.LEVELS)})""",
)
def _(t):
    raw = F.expr("concat('[\"', CASE WHEN p_size % 2 = 0 THEN 'upstream' ELSE p_type END, '.', p_size, '\"; \\'downstream.x\\'', CASE WHEN p_size % 3 = 0 THEN ', bogus.y,' ELSE '' END, ']')")
    return t.part.select(F.col("p_partkey").alias("id"), F.explode(values.clean_tiers(raw)).alias("tier"))


@query(
    "token_jaccard",
    f"""SELECT conv_id, turn, round({sql_jaccard('a', 'b')}, 6) AS jaccard FROM (
 SELECT c.conv_id, c.turn, {sql_words('c.text')} AS a, {sql_words('n.text')} AS b FROM conversations c JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1) p WHERE len(a) > 0 AND len(b) > 0""",
)
def _(t):
    c = t.conversations.select("conv_id", "turn", "text")
    n = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next_text"))
    pairs = c.join(n, ["conv_id", "turn"])
    return pairs.select(
        "conv_id", "turn", F.round(names.token_jaccard(F.col("text"), F.col("next_text")), 6).alias("jaccard")
    ).filter("jaccard IS NOT NULL")


@query(
    "trigram_similarity",
    f"""SELECT entity_id, round(CAST(CAST({sql_jaccard('a', 'b')} AS FLOAT) AS DOUBLE), 5) AS similarity FROM (
 SELECT x.entity_id, {sql_trigrams('x.alias')} AS a, {sql_trigrams("concat(p_type, ' ', p_name)")} AS b FROM x_alias x JOIN part ON p_partkey = CAST(substr(x.entity_id, 2) AS BIGINT)) p""",
)
def _(t):
    p = t.part.withColumn("entity_id", F.concat(F.lit("C"), F.col("p_partkey").cast("string")))
    sim = names.trigram_similarity(F.col("alias"), F.concat_ws(" ", "p_type", "p_name"))
    return t.x_alias.join(p, "entity_id").select("entity_id", F.round(sim.cast("double"), 5).alias("similarity"))


@query(
    "value_rules",
    """SELECT n.assertion_id AS new_id, o.assertion_id AS old_id, n.value_num = o.value_num AS equal,
 coalesce(CASE WHEN o.value_num <> 0 THEN CAST(n.value_num AS DOUBLE) / CAST(o.value_num AS DOUBLE) > 5 OR CAST(n.value_num AS DOUBLE) / CAST(o.value_num AS DOUBLE) < 0.2 END, false) AS jump,
 coalesce(floor((epoch_us(nd.published_at) - epoch_us(od.published_at)) / 86400000000), floor((epoch_us(n.observed_at) - epoch_us(o.observed_at)) / 86400000000)) > 30 AS newer
FROM x_assertion n JOIN x_assertion o ON o.entity_id = n.entity_id AND o.attribute_key = n.attribute_key AND o.assertion_id < n.assertion_id AND o.confidence = n.confidence
LEFT JOIN x_document nd ON nd.document_id = n.document_id LEFT JOIN x_document od ON od.document_id = o.document_id""",
)
def _(t):
    docs = t.x_document.select("document_id", "published_at")
    a = t.x_assertion.join(docs, "document_id", "left").select(
        "assertion_id", "entity_id", "attribute_key", "confidence", "value_text", "value_num", "value_bool", "value_date", "observed_at", "published_at"
    )
    n, o = a.alias("n"), a.alias("o")
    pairs = n.join(o, (F.col("n.entity_id") == F.col("o.entity_id")) & (F.col("n.attribute_key") == F.col("o.attribute_key"))
                   & (F.col("n.confidence") == F.col("o.confidence")) & (F.col("o.assertion_id") < F.col("n.assertion_id")))
    side = lambda s: {k: F.col(f"{s}.{k}") for k in ("value_text", "value_num", "value_bool", "value_date")}
    return pairs.select(
        F.col("n.assertion_id").alias("new_id"),
        F.col("o.assertion_id").alias("old_id"),
        values.values_equal(side("n"), side("o")).alias("equal"),
        values.out_of_range(F.col("n.value_num"), F.col("o.value_num")).alias("jump"),
        values.clearly_newer(F.col("n.published_at"), F.col("o.published_at"), F.col("n.observed_at"), F.col("o.observed_at")).alias("newer"),
    )


@query(
    "documents_independent",
    f"""WITH d AS (SELECT document_id, content_sha256, coalesce(nullif({sql_domain('url')}, ''), domain) AS domain FROM x_document JOIN x_source USING (source_id))
SELECT a.document_id AS a_id, b.document_id AS b_id, a.content_sha256 <> b.content_sha256 AND a.domain <> '' AND b.domain <> '' AND a.domain <> b.domain AS independent
FROM d a JOIN d b ON b.document_id = a.document_id + 1""",
)
def _(t):
    d = ent.documents_with_source(t.x_document, t.x_source).select("document_id", "content_sha256", "domain")
    a, b = d.alias("a"), d.withColumn("k", F.col("document_id") - 1).alias("b")
    return a.join(b, F.col("a.document_id") == F.col("b.k")).select(
        F.col("a.document_id").alias("a_id"),
        F.col("b.document_id").alias("b_id"),
        trust.documents_independent(
            F.col("a.document_id"), F.col("a.content_sha256"), F.col("a.domain"),
            F.col("b.document_id"), F.col("b.content_sha256"), F.col("b.domain"),
        ).alias("independent"),
    )


@query(
    "ranges_overlap",
    """SELECT a.assertion_id, (a.valid_lower IS NULL AND a.valid_upper IS NULL) OR (b.valid_lower IS NULL AND b.valid_upper IS NULL)
 OR ((a.valid_lower IS NULL OR b.valid_upper IS NULL OR a.valid_lower < b.valid_upper) AND (b.valid_lower IS NULL OR a.valid_upper IS NULL OR b.valid_lower < a.valid_upper)) AS overlap
FROM x_assertion a JOIN x_assertion b ON b.assertion_id = a.assertion_id + 1""",
)
def _(t):
    a = t.x_assertion.select("assertion_id", "valid_lower", "valid_upper")
    b = a.select((F.col("assertion_id") - 1).alias("assertion_id"), F.col("valid_lower").alias("bl"), F.col("valid_upper").alias("bu"))
    return a.join(b, "assertion_id").select(
        "assertion_id", trust.ranges_overlap(F.col("valid_lower"), F.col("valid_upper"), F.col("bl"), F.col("bu")).alias("overlap")
    )


@query(
    "should_reopen",
    """SELECT o_orderkey, (ca >= 3 AND ra < 3) OR (cb >= 3 AND rb < 3) OR ca - ra >= 3 OR cb - rb >= 3 AS reopen FROM (
 SELECT o_orderkey, o_orderkey % 6 AS ra, o_custkey % 5 AS rb, o_orderkey % 7 AS ca, o_custkey % 8 AS cb FROM orders) o""",
)
def _(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return t.orders.select("o_orderkey", trust.should_reopen(k % 6, c % 5, k % 7, c % 8).alias("reopen"))


@query(
    "name_variants",
    f"""SELECT DISTINCT entity_id, variant FROM (SELECT entity_id, {sql_norm('form')} AS variant FROM (
 SELECT entity_id, raw AS form FROM r UNION ALL SELECT entity_id, regexp_replace(raw, '\\([^)]*\\)', ' ', 'g') FROM r) f) v WHERE variant <> ''""".replace(
        "FROM r", "FROM (SELECT entity_id, concat(canonical_name, ' (', entity_type, ')') AS raw FROM x_entity UNION ALL SELECT entity_id, alias FROM x_alias) r"
    ),
)
def _(t):
    e = t.x_entity.withColumn("canonical_name", F.expr("concat(canonical_name, ' (', entity_type, ')')"))
    return ent.name_variants(e, t.x_alias)


def sql_alnum(expr: str) -> str:
    return f"list_distinct(list_filter(string_split_regex(lower({expr}), '[^a-z0-9]+'), lambda w: length(w) > 0))"


@query(
    "quote_match",
    f"""SELECT fragment_id, CASE WHEN coalesce(contains(raw_content, quote), false) OR coalesce(contains(text_content, quote), false) THEN true
 ELSE len(q) >= 6 AND len(list_intersect(q, h)) / len(q) >= 0.8 END AS found FROM (
 SELECT fragment_id, quote, raw_content, text_content, {sql_alnum('quote')} AS q, {sql_alnum("coalesce(raw_content, '') || ' ' || text_content")} AS h
 FROM (SELECT fragment_id, concat('so ', split_part(text, '.', 1)) AS quote FROM x_fragment) f JOIN x_document ON document_id = fragment_id) m""",
)
def _(t):
    docs = t.x_document.select("document_id", "raw_content", "text_content")
    lines = t.x_fragment.select(
        F.col("fragment_id"), F.col("fragment_id").alias("document_id"), F.concat(F.lit("so "), F.split_part("text", F.lit("."), F.lit(1))).alias("quote")
    )
    return lines.join(docs, "document_id").select(
        "fragment_id", values.quote_found(F.col("quote"), F.col("raw_content"), F.col("text_content")).alias("found")
    )
