"""Registered queries of the streaming jobs, run to the end of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factspark.operators import folds, projections
from factspark.operators.entities import priced_calls
from factspark.session import scratch_folder
from factspark.sources.tables import SparkDialect, derived_sql
from factspark.streaming import streams

from .columns import COST_SQL, at
from .lifecycle import ADJUDICATED, docs
from .projections import DBL
from .registry import ORACLES, query


def source(t, name):
    """A given table, one file or a folder of part files, as a file stream.

    A pattern names either one; a plain path would have to be a folder.
    """
    schema = getattr(t, name).schema
    return t.spark.readStream.schema(schema).parquet(f"{t.folder}/{name}[.]parquet")


def finish(writer):
    """Run a stream to the end of its input."""
    running = writer.start()
    running.awaitTermination()
    if running.exception():
        raise running.exception()


def written(t, path):
    return t.spark.read.parquet(path).drop("batch")


@query("stream_ingest", "SELECT content_sha256, 'fetched' AS pipeline_status, count(DISTINCT content_sha256) AS n FROM (SELECT sha256(text) AS content_sha256 FROM documents) d GROUP BY 1")
def _(t):
    base = scratch_folder(t.spark, "ingest")
    pages = source(t, "documents").select(
        F.col("doc_id").alias("fetch_id"), F.col("source").alias("source_id"), F.lit(None).cast("string").alias("url"),
        F.col("text").alias("content"), F.lit("2024-01-01").cast("timestamp").alias("fetched_at"),
    )
    finish(streams.stream_ingest(pages, f"{base}/table", f"{base}/state"))
    return written(t, f"{base}/table").groupBy("content_sha256", "pipeline_status").agg(F.count("*").alias("n"))


@query("stream_status")
def _(t):
    base = scratch_folder(t.spark, "status")
    verdicts = t.labels.select(F.col("doc_id").alias("document_id"), (F.col("quality") == 1).alias("relevant"))
    finish(streams.stream_status(source(t, "pages"), verdicts, f"{base}/table", f"{base}/state"))
    return written(t, f"{base}/table")


@query("stream_adjudicate", f"WITH {ADJUDICATED} SELECT * FROM ad")
def _(t):
    base = scratch_folder(t.spark, "adjudicate")
    reads = {"orders": source(t, "orders"), "documents": t.documents, "x_attribute_def": t.x_attribute_def}
    arriving = t.spark.sql(derived_sql("x_assertion", SparkDialect()), **reads)
    d = docs(t).select("document_id", "published_at", "content_sha256", "domain", "trust")
    defs = t.x_attribute_def.select("attribute_key", "cardinality", "volatility_days")
    wanted = arriving.filter("superseded_at IS NULL AND (status = 'candidate' OR (status = 'accepted' AND method <> 'derived'))")
    cols = ["assertion_id", "entity_id", "attribute_key", *folds.CLAIM_VALUES, "confidence", "status", "method", "observed_at", "document_id"]
    claims = wanted.select(*cols, (F.col("status") == "candidate").alias("is_new")).join(d, "document_id", "left").join(defs, "attribute_key")
    judged = streams.stream_adjudicate(claims)
    finish(streams.batch_writer(judged, lambda batch, i: streams.append_once(batch, f"{base}/table", i), f"{base}/state"))
    return written(t, f"{base}/table")


@query(
    "stream_cost",
    f"SELECT date_trunc('day', called_at) AS window_start, date_trunc('day', called_at) + INTERVAL 1 DAY AS window_end, count(*) AS calls, round(sum({COST_SQL}), 6) AS cost_usd FROM x_call LEFT JOIN x_rate USING (model) GROUP BY 1, 2",
)
def _(t):
    return streams.cost_windows(priced_calls(t.x_call, t.x_rate)).withColumn("cost_usd", F.round("cost_usd", 6))


@query(
    "stream_cost_trailing",
    f"""SELECT h AS window_start, h + INTERVAL 1 DAY AS window_end, count(*) AS calls, round(sum(cost), 6) AS cost_usd FROM (SELECT {COST_SQL} AS cost, unnest(generate_series(date_trunc('hour', called_at) - INTERVAL 23 HOUR, date_trunc('hour', called_at), INTERVAL 1 HOUR)) AS h FROM x_call LEFT JOIN x_rate USING (model)) q GROUP BY 1, 2""",
)
def _(t):
    return streams.cost_windows(priced_calls(t.x_call, t.x_rate), "1 day", "1 hour").withColumn("cost_usd", F.round("cost_usd", 6))


COOL = """(SELECT event_id AS id, event_id % 2 = 0 AS ask, concat('Customer#', lpad(CAST(CAST(floor(event_id / 2) AS BIGINT) % 40 AS VARCHAR), 9, '0')) AS topic, event_type <> 'error' AS done, ts AS "at" FROM events)"""


@query(
    "stream_cooldown",
    f'''SELECT id, topic, 'company' AS frame, "at" FROM {COOL} q WHERE ask AND NOT EXISTS (SELECT 1 FROM {COOL} r WHERE NOT r.ask AND r.done AND r.topic = q.topic AND r."at" < q."at" AND q."at" - r."at" <= INTERVAL 6 HOUR)''',
)
def _(t):
    base = scratch_folder(t.spark, "cooldown")
    topic = F.concat(F.lit("Customer#"), F.lpad((F.floor(F.col("event_id") / 2) % 40).cast("string"), 9, "0"))
    events = source(t, "events").select(
        F.col("event_id").alias("id"), F.when(F.col("event_id") % 2 == 0, "request").otherwise("run").alias("kind"), topic.alias("topic"),
        F.lit("company").alias("frame"), F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"), F.col("ts").cast("timestamp").alias("at"),
    )
    passed = streams.stream_cooldown(events)
    finish(streams.batch_writer(passed, lambda batch, i: streams.append_once(batch, f"{base}/table", i), f"{base}/state"))
    return written(t, f"{base}/table")


@query("stream_projection", ORACLES["entity_current"])
def _(t):
    current = projections.entity_current(t.x_assertion.filter("observed_at < TIMESTAMP '2000-01-01'"), t.x_entity, t.x_attribute_def, at())
    touched = t.x_assertion.filter("observed_at >= TIMESTAMP '2000-01-01'")
    renewed = streams.refresh_entity_current(current, touched, t.x_assertion, t.x_entity, t.x_attribute_def, at())
    return DBL(renewed).select("entity_id", "canonical_name", "entity_type", "attribute_key", "assertion_id", "value_num", "confidence", "effective_confidence", "valid_from", "volatility_days")


@query("stream_relation_projection", ORACLES["relation_current"])
def _(t):
    current = projections.relation_current(t.x_relation.filter("observed_at < TIMESTAMP '2000-01-01'"), t.x_entity)
    touched = t.x_relation.filter("observed_at >= TIMESTAMP '2000-01-01'")
    renewed = streams.refresh_relation_current(current, touched, t.x_relation, t.x_entity)
    return renewed.select("subject_id", "predicate", "object_id", "relation_id", "confidence", "subject_name", "object_name")
