"""Claim lifecycle: acceptance, supersession, synthesis, verification, review.

Operators that decide by a person or a model come in two halves: a table of requests,
and an apply step that joins a table of verdicts.  Nothing is updated in place; every
operator returns new rows or the changed state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factspark.functions import names, trust, values, vocab
from factspark.session import checkpointed

from .entities import evidence, frame_of, live, not_merged, top_rows
from .gaps import ids

ACCEPT_AT = 50
MIN_QUOTE = 20
VERIFY_BONUS, FAIL_PENALTY, FAIL_FLOOR = 5, 20, 20
SYNTHESIS_RANGE = (30, 90)
MIN_FRAGMENT = 40


def clamp_score(score: Column) -> Column:
    """Score kept within 0..100; null stays null."""
    return F.when(score.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), score)))


# ── acceptance ────────────────────────────────────────────────────────────────


def accept_extracted(claims, documents, attribute_def, as_of: Column) -> DataFrame:
    """Decide extracted claims against their document.

    ``claims``: claim_id, document_id, entity_id, attribute_key, value, unit, as_of_date,
    quote, label.  ``documents``: document_id, text_content, trust.
    """
    docs = documents.select("document_id", "text_content", "trust")
    defs = attribute_def.select("attribute_key", "datatype")
    joined = claims.join(docs, "document_id").join(defs, "attribute_key", "left")
    quoted = F.contains("text_content", F.trim("quote"))
    reason = F.when(~quoted, "quote_not_found").when(F.col("datatype").isNull(), "unknown_attribute")
    country = F.when(F.col("attribute_key") == "headquarters_country", names.normalize_country(F.col("value")))
    value = F.coalesce(country, F.col("value"))
    score = trust.single_source(F.col("trust"))
    status = (
        F.when(reason.isNotNull(), "rejected")
        .when((score < ACCEPT_AT) | (F.col("label") == "low"), "candidate")
        .otherwise("accepted")
    )
    return joined.select(
        "claim_id", "document_id", "entity_id", "attribute_key",
        status.alias("status"), reason.alias("reason"), score.alias("confidence"),
        F.coalesce(F.col("as_of_date").cast("timestamp"), as_of).alias("valid_lower"),
        *[c.alias(n) for n, c in values.typed_value(value, F.col("unit"), F.col("datatype")).items()],
    )


def acceptance_counts(decided: DataFrame) -> DataFrame:
    """Stored and rejected claims per document."""
    rejected = F.col("status") == "rejected"
    return decided.groupBy("document_id").agg(F.count_if(~rejected).alias("accepted"), F.count_if(rejected).alias("rejected"))


def accept_research(claims, attribute_def, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(stored candidate claims, rejected rows with a reason) of research answers.

    ``claims``: claim_id, topic, attribute_key, mention, value, unit, as_of_text, quote, source_url.
    """
    defs = attribute_def.select("attribute_key", "datatype")
    joined = claims.join(defs, "attribute_key", "left")
    mention = F.coalesce(F.nullif("mention", F.lit("")), F.col("topic"))
    country = F.when(F.col("attribute_key") == "headquarters_country", names.normalize_country(F.col("value")))
    url = F.nullif("source_url", F.lit(""))
    as_of_day = F.when(F.col("as_of_text").rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.col("as_of_text").try_cast("date"))
    typed = values.typed_value(F.coalesce(country, F.col("value")), F.col("unit"), F.col("datatype"))
    stored = joined.filter("datatype IS NOT NULL").select(
        "claim_id", "attribute_key", mention.alias("mention"),
        F.coalesce(F.nullif("quote", F.lit("")), mention).alias("quote"),
        F.when(url.isNotNull(), F.sha2(F.trim(F.regexp_replace(url, r"\s+", " ")), 256)).alias("document_sha256"),
        trust.single_source(trust.domain_trust(url)).alias("confidence"),
        F.lit("candidate").alias("status"), F.lit("structured_api").alias("method"),
        F.coalesce(as_of_day.cast("timestamp"), as_of).alias("valid_lower"),
        *[c.alias(n) for n, c in typed.items()],
    )
    rejected = joined.filter("datatype IS NULL").select(
        "claim_id", F.lit("unknown_attribute").alias("reason"), "attribute_key", F.coalesce("mention", F.lit("?")).alias("subject")
    )
    return stored, rejected


def store_fragments(fragments) -> DataFrame:
    """Narrative fragments worth keeping.  ``fragments``: fragment_id, mention, text, category, date_text."""
    text = F.trim("text")
    date, _ = values.flexible_date(F.col("date_text"))
    kept = fragments.filter((F.trim("mention") != "") & (F.length(text) >= MIN_FRAGMENT))
    category = F.when(F.col("category").isin(vocab.FRAGMENT_CATEGORIES), F.col("category")).otherwise("strategic")
    return kept.select("fragment_id", "mention", text.alias("text"), category.alias("category"), date.alias("date_of_information"), F.lit(65).alias("confidence"))


# ── supersession and synthesis ────────────────────────────────────────────────


def supersede(pairs, assertion, as_of: Column) -> DataFrame:
    """Change rows that close the old claim at the new one's start and accept the new one.

    ``pairs``: old_id, new_id.  A pair whose new start lies before the old start would
    invert the range; it is left unchanged and reported as ``inverted``.
    """
    bounds = assertion.select("assertion_id", F.coalesce("valid_lower", as_of).alias("lower"))
    old = bounds.select(F.col("assertion_id").alias("old_id"), F.col("lower").alias("old_lower"))
    new = bounds.select(F.col("assertion_id").alias("new_id"), F.col("lower").alias("new_lower"))
    both = pairs.join(old, "old_id").join(new, "new_id")
    inverted = F.col("new_lower") < F.col("old_lower")
    row = lambda key, status, upper, at: F.struct(
        F.col(key).alias("assertion_id"), F.lit(status).alias("status"), upper.alias("valid_upper"), at.alias("superseded_at")
    )
    none = F.lit(None).cast("timestamp")
    changes = F.when(
        inverted, F.array(row("old_id", "inverted", none, none), row("new_id", "inverted", none, none))
    ).otherwise(F.array(row("old_id", "superseded", F.col("new_lower"), as_of), row("new_id", "accepted", none, none)))
    return both.select(F.explode(changes).alias("c")).select("c.*")


def claim_value(prefix: str = "") -> Column:
    c = lambda n: F.col(prefix + n)
    return F.coalesce(c("value_text"), c("value_num").cast("double").cast("string"), c("value_bool").cast("string"), c("value_date").cast("string"), F.lit("?"))


def synthesis_requests(conflicts, assertion, documents) -> DataFrame:
    """One request per conflicting pair with both sides' value, source trust and quote.

    ``conflicts``: entity_id, attribute_key, old_id, new_id.
    """
    docs = documents.select("document_id", "source_name", "trust")
    side = assertion.join(docs, "document_id", "left").select(
        "assertion_id",
        F.concat(
            F.lit("- Source: "), F.coalesce("source_name", F.lit("unknown")), F.lit(" (trust "), F.coalesce("trust", F.lit(55)).cast("string"),
            F.lit("/100) Value: "), claim_value(), F.lit(" Quote: "), F.coalesce("quote", F.lit("(none)")),
        ).alias("line"),
    )
    old = side.select(F.col("assertion_id").alias("old_id"), F.col("line").alias("old_line"))
    new = side.select(F.col("assertion_id").alias("new_id"), F.col("line").alias("new_line"))
    return conflicts.join(old, "old_id").join(new, "new_id").select(
        "entity_id", "attribute_key", "old_id", "new_id", F.concat_ws("\n", "old_line", "new_line").alias("evidence")
    )


def synthesis_apply(verdicts, assertion, attribute_def, open_conflicts) -> dict[str, DataFrame]:
    """Results of synthesis verdicts: new claims, superseded claims with lineage, conflicts.

    ``verdicts``: entity_id, attribute_key, value, confidence, reasoning.  All claims in
    force for the attribute are superseded; ``lineage`` keeps one row per source claim.
    """
    keys = ["entity_id", "attribute_key"]
    low, high = SYNTHESIS_RANGE
    given = verdicts.filter("value IS NOT NULL").join(attribute_def.select("attribute_key", "datatype"), "attribute_key")
    typed = values.typed_value(F.col("value"), F.lit(None).cast("string"), F.col("datatype"))
    created = given.select(
        *keys, F.lit("synthesis").alias("method"), F.lit("accepted").alias("status"),
        F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce("confidence", F.lit(60)))).alias("confidence"),
        F.concat(F.lit("[Synthesised] "), F.coalesce("reasoning", F.lit(""))).alias("quote"),
        *[c.alias(n) for n, c in typed.items()],
    )
    lineage = assertion.filter("superseded_at IS NULL").join(given.select(*keys).distinct(), keys, "left_semi").select(
        *keys, "assertion_id", F.lit("superseded").alias("status")
    )
    first = top_rows(lineage, keys, [F.col("assertion_id")], 10).groupBy(*keys).agg(F.array_sort(F.collect_list("assertion_id")).alias("assertion_ids"))
    conflicts = (
        given.select(*keys, F.substring("reasoning", 1, 500).alias("notes"))
        .join(open_conflicts.select(*keys), keys, "left_anti")
        .join(first, keys, "left")
        .select(*keys, "assertion_ids", F.lit("medium").alias("severity"), F.lit("picked").alias("resolution"), "notes")
    )
    return {"created": created, "lineage": lineage, "conflicts": conflicts}


# ── quote verification ────────────────────────────────────────────────────────


def verify_quotes(assertion, documents, as_of: Column | None = None) -> DataFrame:
    """Outcome of checking each claim's quote against its page.

    ``documents``: document_id, url, raw_content, text_content (readable prose).  Claims
    already verified stay out, claims without a document are skipped.  With ``as_of`` a checked
    claim bears ``verified_at``.
    """
    docs = documents.select("document_id", "url", "raw_content", "text_content")
    todo = assertion.filter(~F.coalesce(F.col("quote_verified"), F.lit(False)))
    joined = todo.join(docs, "document_id", "left").withColumn("_quote", F.trim("quote"))
    outcome = (
        F.when((F.coalesce("url", F.lit("")) == "") | (F.coalesce("_quote", F.lit("")) == ""), "skipped")
        .when(F.length("_quote") < MIN_QUOTE, "weak")
        .when(F.coalesce("raw_content", F.lit("")) == "", "unfetchable")
        .when(values.quote_found(F.col("_quote"), F.col("raw_content"), F.col("text_content")), "verified")
        .otherwise("failed")
    )
    judged = joined.withColumn("outcome", outcome)
    lowered = F.greatest(F.lit(FAIL_FLOOR), F.col("confidence") - FAIL_PENALTY)
    confidence = F.when(F.col("outcome") == "verified", F.col("confidence") + VERIFY_BONUS).when(F.col("outcome") == "failed", lowered).otherwise(F.col("confidence"))
    demoted = (F.col("outcome") == "failed") & (F.col("status") == "accepted") & (lowered < ACCEPT_AT)
    return judged.select(
        "assertion_id", "outcome",
        F.when(F.col("outcome") == "verified", True).when(F.col("outcome").isin("failed", "weak"), False).alias("quote_verified"),
        confidence.cast("int").alias("confidence"),
        F.when(demoted, "candidate").otherwise(F.col("status")).alias("status"),
        *([] if as_of is None else [F.when(F.col("outcome").isin("verified", "failed", "weak"), as_of).alias("verified_at")]),
    )


def outcome_counts(judged: DataFrame) -> DataFrame:
    return judged.groupBy("outcome").agg(F.count("*").alias("n"))


# ── supply chain ──────────────────────────────────────────────────────────────


def supply_chain_apply(answers, assertion) -> tuple[DataFrame, DataFrame]:
    """(new output and input claims, ids of the claims they replace).

    ``answers``: entity_id, outputs[], inputs[].
    """
    clean = lambda c: F.slice(F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda v: F.trim(v)), lambda v: F.length(v) > 0))), 1, 10)
    lists = answers.select("entity_id", clean(F.col("outputs")).alias("output"), clean(F.col("inputs")).alias("input"))
    lists = lists.filter((F.size("output") > 0) | (F.size("input") > 0))
    long = lists.select("entity_id", F.explode(F.map_from_arrays(F.array(F.lit("output"), F.lit("input")), F.array("output", "input"))).alias("attribute_key", "items"))
    created = long.select(
        "entity_id", "attribute_key", F.explode("items").alias("value_text"),
        F.lit("structured_api").alias("method"), F.lit(80).alias("confidence"), F.lit("candidate").alias("status"),
    )
    replaced = assertion.filter(
        F.col("superseded_at").isNull() & (F.col("method") == "structured_api") & F.col("attribute_key").isin("output", "input")
    ).join(ids(lists), "entity_id", "left_semi").select("assertion_id", "entity_id")
    return created, replaced


def tier_apply(answers, assertion) -> tuple[DataFrame, DataFrame]:
    """(new tier claims, ids of the tiers they replace).  ``answers``: entity_id, tiers[]."""
    parts = F.flatten(F.transform("tiers", lambda t: values.clean_tiers(t)))
    good = answers.select("entity_id", parts.alias("tiers")).filter(F.size("tiers") > 0)
    created = good.select(
        "entity_id", F.lit("value_chain_tier").alias("attribute_key"), F.explode("tiers").alias("value_text"),
        F.lit("structured_api").alias("method"), F.lit(85).alias("confidence"), F.lit("candidate").alias("status"),
    )
    replaced = assertion.filter("superseded_at IS NULL AND attribute_key = 'value_chain_tier'").join(ids(good), "entity_id", "left_semi")
    return created, replaced.select("assertion_id", "entity_id")


# ── classification and relevance ──────────────────────────────────────────────

_PATH = r"^[a-z][a-z0-9_]*(\.[a-z][a-z0-9_]*)*$"


def facet_grants() -> Column:
    """Facets an entity type may be classified in, as an expression of ``entity_type``."""
    flat = [x for k, v in vocab.FACETS_FOR_TYPE.items() for x in (F.lit(k), F.array(*[F.lit(f) for f in v]))]
    return F.try_element_at(F.create_map(*flat), F.col("entity_type"))


def classification_items(items, entity, node, facets: DataFrame | None = None) -> DataFrame:
    """Answer items with ``stored`` and ``is_new_node``, taken in the order of ``pos`` per entity.

    ``items``: entity_id, pos, facet, path, weight, is_primary, label.  An item is stored on an
    active node, or on one added one level at a time: its parent is active or stored by an
    earlier item of the same answer, or it is a root of a known facet.  A path that is
    stored already, whatever its status, takes the item without a new node.  ``facets`` (facet) adds
    facets that have no node yet.  Items of equal ``pos`` go by path; one without ``pos`` neither
    waits for a parent nor stands for one.

    An item under a parent of the same answer is stored if the parent's smallest stored
    ``pos`` is not above its own, so open items are judged by one join per depth of their
    paths, the shallow first, against minima aggregated before the shuffle.
    """
    key = ["facet", "path"]
    typed = items.join(entity.select("entity_id", "entity_type"), "entity_id").withColumn("allowed", F.coalesce(F.array_contains(facet_grants(), F.col("facet")), F.lit(False)))
    parent = F.regexp_extract("path", r"^(.*)\.[^.]*$", 1)
    state = node.groupBy(*key).agg(F.max((F.col("status") == "active") & (F.col("facet_status") == "active")).alias("active"))
    above = state.filter("active").select("facet", F.col("path").alias("parent"), F.lit(True).alias("parent_active"))
    known = node.filter("facet_status = 'active'").select("facet")
    known = (known if facets is None else known.union(facets.select("facet"))).distinct().withColumn("facet_known", F.lit(True))
    flagged = typed.withColumn("parent", parent).join(state, key, "left").join(above, ["facet", "parent"], "left").join(known, "facet", "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    valid = no(F.col("path").rlike(_PATH)) & no(F.col("facet_known"))
    rooted = no(F.col("parent_active")) | no(F.col("parent") == "")
    flagged = flagged.withColumn("reached", F.col("allowed") & (no(F.col("active")) | (valid & rooted)))
    flagged = flagged.withColumns({"open": F.col("allowed") & valid & ~F.col("reached"), "depth": F.size(F.split("path", r"\."))})
    flagged = checkpointed(flagged.drop("parent_active", "facet_known"))
    judged = flagged.filter("NOT open").withColumn("stored", F.col("reached"))
    level, above_depth = None, None
    for depth in sorted(r.depth for r in flagged.filter("open").select("depth").distinct().collect()):
        held = flagged.filter(F.col("reached") & (F.col("depth") == depth - 1))
        if above_depth == depth - 1:
            held = held.unionByName(level.filter("stored").drop("stored"))
        first = held.groupBy("entity_id", "facet", F.col("path").alias("parent")).agg(F.min("pos").alias("first_pos"))
        level = flagged.filter(F.col("open") & (F.col("depth") == depth)).join(first, ["entity_id", "facet", "parent"], "left")
        level = checkpointed(level.withColumn("stored", no(F.col("first_pos") <= F.col("pos"))).drop("first_pos"))
        judged, above_depth = judged.unionByName(level), depth
    return judged.withColumn("is_new_node", F.col("stored") & F.col("active").isNull()).drop("active", "parent", "reached", "open", "depth")


def classification_apply(judged: DataFrame) -> DataFrame:
    """One membership per entity and node; the last answer wins."""
    score = F.when(F.col("label") == "high", 85).when(F.col("label") == "low", 45).otherwise(65)
    latest = top_rows(judged.filter("stored"), ["entity_id", "facet", "path"], [F.desc("pos")])
    return latest.select(
        "entity_id", "facet", "path",
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("weight", F.lit(0.5)))).alias("weight"),
        F.coalesce("is_primary", F.lit(False)).alias("is_primary"), score.alias("confidence"),
    )


def classification_counts(judged: DataFrame) -> DataFrame:
    return judged.groupBy("entity_id").agg(F.count_if("stored").alias("created"), F.count_if(~F.col("stored")).alias("skipped"))


def new_nodes(judged: DataFrame) -> DataFrame:
    """Taxonomy nodes the answers add, with a readable label."""
    last = F.element_at(F.split("path", r"\."), -1)
    return judged.filter("is_new_node").select("facet", "path").distinct().select(
        "facet", "path", F.initcap(F.replace(last, F.lit("_"), F.lit(" "))).alias("label"), F.lit("active").alias("status")
    )


def relevance_update(entity, scores, assertion, event, fragment) -> DataFrame:
    """Relevance after classification, which may raise it, and lower it only on evidence.

    ``scores``: entity_id, score, created.
    """
    scored = entity.filter(F.col("entity_type").isin(vocab.SCORED_TYPES)).join(scores, "entity_id")
    new = F.coalesce(clamp_score(F.col("score")), F.when(F.col("created") > 0, 100))
    proof = evidence(assertion, fragment, event).select("entity_id", "n", "n_claims")
    joined = scored.withColumn("new", new).join(proof, "entity_id", "left")
    old = F.col("space_relevance")
    promoted = old.isNull() | (F.col("new") > old)
    allowed = F.col("new").isNotNull() & (promoted | F.coalesce(F.col("n") > 0, F.lit(False)))
    final = F.when(allowed, F.col("new")).otherwise(old)
    no_data = F.coalesce(F.col("n") - F.col("n_claims"), F.lit(0)) == 0
    ask = allowed & promoted & (F.col("new") >= 50) & (F.col("entity_type") == "person") & no_data
    return joined.select("entity_id", final.cast("int").alias("space_relevance"), (~final.eqNullSafe(old)).alias("changed"), F.coalesce(ask, F.lit(False)).alias("request_research"))


def raise_relevance(entity, scores) -> DataFrame:
    """Relevance after a summary: it can only rise."""
    new = clamp_score(F.col("score"))
    return entity.join(scores, "entity_id").select("entity_id", F.greatest("space_relevance", new).cast("int").alias("space_relevance"))


def type_audit_requests(entity, assertion, event, fragment) -> DataFrame:
    """Entities whose type can be judged, with up to 1,200 characters of evidence."""
    stated = [F.nullif("value_text", F.lit("")), F.col("value_num").cast("double"), F.col("value_date"), F.col("value_bool")]
    value = F.coalesce(*[v.cast("string") for v in stated])
    zero, blank = F.lit(0).cast("long"), F.lit("")

    def lines_of(df, part, a, b, c, line):
        return df.select("entity_id", F.lit(part).alias("part"), a.cast("long").alias("a"), b.cast("long").alias("b"), c.alias("c"), line.alias("line"))

    pieces = top_rows(fragment, ["entity_id"], [F.desc("confidence"), F.col("fragment_id")], 3)
    pieces = lines_of(pieces, 0, -F.col("confidence"), F.col("fragment_id"), blank, F.substring("text", 1, 220))
    stories = top_rows(event, ["entity_id"], [F.desc_nulls_first("created_at"), F.desc("event_id")], 5)
    stories = lines_of(stories, 1, -F.coalesce(F.unix_micros("created_at"), F.lit(2**62)), -F.col("event_id"), blank, F.concat_ws(": ", "event_type", "title"))
    head = lines_of(entity, 2, zero, zero, blank, F.concat(F.lit("Name: "), "canonical_name"))
    # a fact line has at least six characters, so 400 of them fill the 1,200 that can show
    facts = top_rows(live(assertion).filter(value.isNotNull()), ["entity_id"], [F.col("attribute_key"), F.col("assertion_id")], 400)
    place = F.concat_ws("|", "attribute_key", F.lpad(F.col("assertion_id").cast("string"), 20, "0"))
    facts = lines_of(facts, 3, zero, zero, place, F.concat(F.lit("  "), "attribute_key", F.lit(": "), value))
    lines = pieces.unionByName(stories).unionByName(head).unionByName(facts)
    text = lines.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("part", "a", "b", "c", "line"))).alias("x"))
    text = text.select("entity_id", F.substring(F.array_join(F.transform("x", lambda r: r["line"]), "\n"), 1, 1200).alias("evidence"))
    return auditable(entity).join(text, "entity_id").filter(F.length(F.trim("evidence")) >= 80).select("entity_id", "entity_type", "evidence")


def auditable(entity: DataFrame) -> DataFrame:
    """Entities whose type may be corrected; confirmed place names keep theirs."""
    place = (F.col("entity_type") == "geography") & names.normalize_name(F.col("canonical_name")).isin(vocab.PLACE_NAMES)
    return entity.filter(F.col("entity_type").isin(vocab.CORRECTABLE_TYPES) & ~place)


def type_audit_apply(entity, requests, verdicts) -> DataFrame:
    """Corrected types: only high-confidence answers to actual requests count.

    ``verdicts``: entity_id, new_type, label.
    """
    sure = verdicts.filter((F.col("label") == "high") & F.col("new_type").isin(vocab.CORRECTABLE_TYPES))
    asked = sure.join(ids(requests), "entity_id", "left_semi").select("entity_id", "new_type")
    joined = entity.join(asked, "entity_id", "left")
    new = F.coalesce("new_type", "entity_type")
    return joined.select("entity_id", new.alias("entity_type"), (new != F.col("entity_type")).alias("changed"))


# ── summaries ─────────────────────────────────────────────────────────────────


def summary_inputs(entity, event, fragment) -> DataFrame:
    """Events and fragments each summary is written from, and how many there are."""
    shown = not_merged(entity).select("entity_id", "space_relevance")
    condensed = F.coalesce(F.col("space_relevance") < 100, F.lit(False))
    first = top_rows(event.select("entity_id", "event_id", "date", "created_at"), ["entity_id"], [F.asc_nulls_last("date"), F.asc_nulls_last("created_at"), F.col("event_id")], 25)
    newest = top_rows(fragment.select("entity_id", "fragment_id", "date_of_information", "created_at"), ["entity_id"], [F.desc_nulls_first("date_of_information"), F.desc_nulls_first("created_at"), F.desc("fragment_id")], 30)
    e = first.groupBy("entity_id").agg(F.count("*").alias("n_events"))
    f = newest.groupBy("entity_id").agg(F.count("*").alias("n_fragments"))
    joined = shown.join(e, "entity_id", "left").join(f, "entity_id", "left")
    cut = lambda c, full: F.least(F.coalesce(c, F.lit(0)), F.when(condensed, 10).otherwise(full)).cast("int")
    return joined.select("entity_id", condensed.alias("condensed"), cut("n_events", 25).alias("n_events"), cut("n_fragments", 30).alias("n_fragments"))


def summary_apply(entity, summary, inputs, verdicts) -> DataFrame:
    """Written summaries with their source count and the follow-ups they trigger.

    ``verdicts``: entity_id, overview, challenges[], score.
    """
    joined = verdicts.join(inputs, "entity_id").join(entity.select("entity_id", "entity_type", "space_relevance"), "entity_id")
    joined = joined.join(summary.select("entity_id", F.lit(True).alias("_existed")), "entity_id", "left")
    sources = F.col("n_events") + F.col("n_fragments")
    score = clamp_score(F.col("score"))
    irrelevant = (sources == 0) & F.coalesce(score == 0, F.lit(False))
    created = F.col("_existed").isNull()
    relevance = F.greatest("space_relevance", score)
    frame = frame_of(F.col("entity_type"))
    skip_types = F.when(sources == 0, F.lit(False)).otherwise(F.col("entity_type").isin("geography", "document_node", "event"))
    no_data_skip = (sources == 0) & F.col("entity_type").isin("person", "geography", "document_node")
    return joined.filter(~no_data_skip).select(
        "entity_id", "overview",
        F.when(irrelevant, F.array().cast("array<string>")).otherwise(F.coalesce("challenges", F.array().cast("array<string>"))).alias("challenges"),
        sources.alias("source_count"), relevance.cast("int").alias("space_relevance"),
        F.when((sources == 0) & (relevance >= 50), F.when((frame == "company") & (relevance < 100), "space_angle").otherwise(frame)).alias("research_frame"),
        (created & (F.coalesce("overview", F.lit("")) != "") & ~skip_types).alias("request_aliases"),
    )


# ── review ────────────────────────────────────────────────────────────────────


def review_claims(assertion, decisions) -> DataFrame:
    """Reviewed claims.  ``decisions``: assertion_id, action (accept / reject / flag)."""
    a = F.col("action")
    queued = F.col("status") == "candidate"
    status = F.when(queued & (a == "accept"), "accepted").when(queued & (a == "reject"), "rejected").otherwise(F.col("status"))
    state = F.when(queued & (a == "accept"), "approved").when(queued & (a == "reject"), "corrected").when(a == "flag", "pending")
    return assertion.join(decisions, "assertion_id").select("assertion_id", status.alias("status"), state.alias("review_state"))


def review_entities(entity, edits) -> DataFrame:
    """Edited entities; unknown types or states are ignored.  ``edits``: entity_id, new_type, new_name, new_status."""
    name = F.trim("new_name")
    return entity.join(edits, "entity_id").select(
        "entity_id",
        F.when(F.col("new_type").isin(vocab.ENTITY_TYPES), F.col("new_type")).otherwise(F.col("entity_type")).alias("entity_type"),
        F.when(name != "", name).otherwise(F.col("canonical_name")).alias("canonical_name"),
        F.when(F.col("new_status").isin(vocab.ENTITY_STATUS), F.col("new_status")).otherwise(F.col("status")).alias("status"),
    )


def review_merges(merges, reverted, as_of: Column) -> DataFrame:
    """Merge audit rows with the time of their reversal stamped once.  ``reverted``: merged_id."""
    hit = reverted.select("merged_id", F.lit(True).alias("_hit")).distinct()
    stamped = F.when(F.col("_hit") & F.col("reverted_at").isNull(), as_of).otherwise(F.col("reverted_at"))
    return merges.join(hit, "merged_id", "left").withColumn("reverted_at", stamped).drop("_hit")


def review_conflicts(conflict, flagged) -> DataFrame:
    hit = flagged.select("conflict_id", F.lit(True).alias("_hit")).distinct()
    return conflict.join(hit, "conflict_id", "left").withColumn("resolution", F.when(F.col("_hit"), "pending").otherwise(F.col("resolution"))).drop("_hit")


def review_feeds(scheduled, switches) -> DataFrame:
    """Feeds switched on or off.  ``switches``: feed_id, active."""
    return scheduled.join(switches, "feed_id", "left").withColumn("is_active", F.coalesce("active", "is_active")).drop("active")


def ready_for_classification(triggers, assertion, max_deferrals: int = 8) -> DataFrame:
    """Entities whose run has no candidate left, or that waited long enough.

    ``triggers``: entity_id, run_id, deferrals.
    """
    pending = assertion.filter("status = 'candidate'").select("run_id").distinct()
    free = triggers.filter(F.col("run_id").isNull() | (F.col("deferrals") >= max_deferrals))
    waiting = triggers.filter(F.col("run_id").isNotNull() & (F.col("deferrals") < max_deferrals))
    return free.unionByName(waiting.join(pending, "run_id", "left_anti").select(*triggers.columns)).select("entity_id", "run_id")
