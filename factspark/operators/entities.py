"""Whole-table jobs around entities, documents and calls that other operators reuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factspark.functions import names, trust, values, vocab


def live(assertion: DataFrame, with_candidates: bool = False) -> DataFrame:
    """Claims in force: accepted (or also candidate) and not superseded."""
    wanted = ["accepted", "candidate"] if with_candidates else ["accepted"]
    return assertion.filter(F.col("superseded_at").isNull() & F.col("status").isin(wanted))


def not_merged(entity: DataFrame) -> DataFrame:
    return entity.filter(F.col("status") != "merged")


def top_rows(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """First ``n`` rows per key.

    The rank filter lets Spark keep only ``n`` rows per key inside every map task, so
    a hot key ships at most ``n`` rows from each task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= n).drop("_rank")


def head(df: DataFrame, order: list[Column], n: int | None) -> DataFrame:
    """The first ``n`` rows of a listing; all rows, unsorted, without ``n``."""
    return df if n is None else df.orderBy(*order).limit(n)


def documents_with_source(document: DataFrame, source: DataFrame) -> DataFrame:
    """Documents with publication domain and effective trust."""
    s = source.select("source_id", F.col("name").alias("source_name"), F.col("domain").alias("source_domain"), "base_trust")
    return (
        document.join(s, "source_id", "left")
        .withColumn("domain", trust.document_domain(F.col("url"), F.col("source_domain")))
        .withColumn("trust", trust.effective_trust(F.col("trust_override"), F.col("base_trust")).cast("int"))
    )


def country_backfill(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(country claims with ISO codes, counts of changed and unchanged rows)."""
    country = facts.filter("attribute_key = 'headquarters_country'").withColumn(
        "iso2", names.normalize_country(F.col("value_text"))
    )
    changed = F.col("iso2").isNotNull() & (F.col("iso2") != F.col("value_text"))
    rewritten = country.withColumn("value_text", F.coalesce("iso2", "value_text")).drop("iso2")
    counts = country.agg(
        F.count_if(changed).alias("changed"), F.count_if(~changed).alias("unchanged")
    )
    return rewritten, counts


def country_preview(facts: DataFrame) -> DataFrame:
    """One planned country rewrite per entity."""
    country = facts.filter("attribute_key = 'headquarters_country'").withColumn(
        "iso2", names.normalize_country(F.col("value_text"))
    )
    changed = country.filter(F.col("iso2").isNotNull() & (F.col("iso2") != F.col("value_text")))
    return top_rows(changed, ["entity_id"], [F.col("assertion_id")]).select(
        "entity_id", F.col("value_text").alias("old_value"), F.col("iso2").alias("new_value")
    )


def unique_slugs(named: DataFrame, existing: DataFrame | None) -> DataFrame:
    """Slugs per entity, numbered ``-1``, ``-2`` ... where the base repeats.

    Ranks are built from counts per (base, block) plus a rank inside each block, so a
    base shared by very many names is numbered by many tasks.
    """
    based = named.select("entity_id", names.slug_base(F.col("name")).alias("base"))
    ranked = block_rank(based, ["base"], "entity_id")
    if existing is not None:
        taken = (
            existing.select(F.regexp_extract("slug", r"^(.*?)(?:-(\d+))?$", 1).alias("base"),
                            F.regexp_extract("slug", r"^(.*?)(?:-(\d+))?$", 2).alias("n"))
            .groupBy("base")
            .agg((F.max(F.coalesce(F.nullif("n", F.lit("")).try_cast("int"), F.lit(0))) + 1).alias("used"))
        )
        whole = existing.select(F.col("slug").alias("base"), F.lit(1).alias("used"))
        taken = taken.unionByName(whole).groupBy("base").agg(F.max("used").alias("used"))
        ranked = ranked.join(taken, "base", "left")
    else:
        ranked = ranked.withColumn("used", F.lit(0))
    n = F.col("rank") - 1 + F.coalesce("used", F.lit(0))
    return ranked.select(
        "entity_id", F.when(n == 0, F.col("base")).otherwise(F.concat_ws("-", "base", n.cast("string"))).alias("slug")
    )


def block_rank(df: DataFrame, keys: list[str], order: str, block: Column | None = None) -> DataFrame:
    """``rank`` of ``order`` (unique per row) inside ``keys`` without one task per key.

    Rows are cut into blocks that follow the order (for text: its leading characters).
    Block sizes are added up first, then rows are ranked inside their own block only.
    """
    blocked = df.withColumn("_block", F.substring(F.col(order), 1, 4) if block is None else block)
    sizes = blocked.groupBy(*keys, "_block").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    return (
        blocked.withColumn("_in", F.row_number().over(inside))
        .join(sizes, [*keys, "_block"])
        .withColumn("rank", F.col("_in") + F.col("_before"))
        .drop("_block", "_in", "_before")
    )


def entity_priority(entity: DataFrame, assertion: DataFrame, as_of: Column) -> DataFrame:
    """Entities with their re-check urgency."""
    seen = assertion.groupBy("entity_id").agg(
        F.max("observed_at").alias("last_observed"), F.count("*").alias("n_claims")
    )
    days = F.coalesce(trust.whole_days(as_of, F.col("last_observed")), F.lit(365))
    score = (
        days / F.lit(180.0)
        * F.when(F.col("watchlist"), 2.0).otherwise(1.0)
        * F.when(F.col("status") == "dormant", 0.3).otherwise(1.0)
        * F.log1p(F.coalesce("n_claims", F.lit(0)))
    )
    return entity.join(seen, "entity_id", "left").withColumn("priority", F.greatest(score, F.lit(0.01)))


def priced_calls(calls: DataFrame, rates: DataFrame) -> DataFrame:
    """Calls with their estimated cost."""
    priced = calls.join(rates, "model", "left")
    cost = values.estimate_cost(F.col("tokens_in"), F.col("tokens_out"), F.col("rate_in"), F.col("rate_out"))
    return priced.withColumn("cost_usd", cost).drop("rate_in", "rate_out")


def name_variants(entity: DataFrame, alias: DataFrame) -> DataFrame:
    """Distinct normalised names of an entity, with and without parentheses."""
    raw = entity.select("entity_id", F.col("canonical_name").alias("raw")).unionByName(
        alias.select("entity_id", F.col("alias").alias("raw"))
    )
    forms = raw.select(
        "entity_id", F.explode(F.array("raw", names.without_parentheses(F.col("raw")))).alias("form")
    )
    return (
        forms.select("entity_id", names.normalize_name(F.col("form")).alias("variant"))
        .filter("variant <> ''")
        .distinct()
    )


def evidence(assertion: DataFrame, fragment: DataFrame, event: DataFrame) -> DataFrame:
    """Evidence per entity: live accepted claims, fragments and events, and their sum."""
    parts = [
        live(assertion).groupBy("entity_id").agg(F.count("*").alias("n")).withColumn("kind", F.lit("claim")),
        fragment.groupBy("entity_id").agg(F.count("*").alias("n")).withColumn("kind", F.lit("fragment")),
        event.groupBy("entity_id").agg(F.count("*").alias("n")).withColumn("kind", F.lit("event")),
    ]
    counts = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return counts.groupBy("entity_id").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("kind") == "claim", F.col("n")).otherwise(0)).alias("n_claims"),
    )


def frame_of(entity_type: Column, mapping: dict[str, str] = vocab.RESEARCH_FRAME) -> Column:
    return F.coalesce(names.literal_map(mapping, entity_type), F.lit("company"))
