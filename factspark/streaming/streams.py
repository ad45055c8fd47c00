"""Structured Streaming forms of the incremental steps."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor

from factspark.functions import values
from factspark.operators.folds import CLAIM_VALUES, OUTCOMES, uncontested
from factspark.operators.gaps import ids
from factspark.operators.projections import entity_current, relation_current
from factspark.sources.documents import ingest_documents, parse_pages, triage_apply

DOCUMENT_COLUMNS = "document_id long, source_id string, url string, content_sha256 string, raw_content string, text_content string, pipeline_status string"


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table that may not have been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as exc:  # the first batch finds no folder
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return spark.createDataFrame([], schema)


def batch_writer(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> DataStreamWriter:
    """Writer that works off everything available; restart goes on from the checkpoint."""
    return (
        stream.writeStream.outputMode(mode).foreachBatch(handle)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True)
    )


def append_once(rows: DataFrame, path: str, batch_id: int) -> None:
    """Write one batch to its own folder, so a replayed batch replaces itself."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def stream_ingest(pages: DataFrame, path: str, checkpoint: str, delay: str = "6 hours") -> DataStreamWriter:
    """New documents of a page stream.

    ``pages``: fetch_id, source_id, url, content, fetched_at.  Repeats inside the
    watermark are dropped by state, older ones by an anti join with the stored table.
    """
    keyed = pages.withColumn("content_sha256", F.sha2("content", 256))
    fresh = keyed.withWatermark("fetched_at", delay).dropDuplicatesWithinWatermark(["content_sha256"])

    def handle(batch: DataFrame, batch_id: int) -> None:
        known = stored(batch.sparkSession, path, DOCUMENT_COLUMNS + ", batch int").filter(F.col("batch") < batch_id)
        append_once(ingest_documents(batch.drop("content_sha256", "fetched_at"), known), path, batch_id)

    return batch_writer(fresh, handle, checkpoint)


def stream_status(pages: DataFrame, verdicts: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Status of each page after parsing and triage.  ``pages``: page_id, url, html."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        parsed = parse_pages(batch).withColumnRenamed("page_id", "document_id")
        good = parsed.filter("pipeline_status = 'parsed'")
        judged = triage_apply(good, verdicts)
        rest = parsed.filter("pipeline_status <> 'parsed'").select("document_id", "pipeline_status")
        append_once(judged.unionByName(rest), path, batch_id)

    return batch_writer(pages, handle, checkpoint)


#: Keyed state of one row per entry needs this store.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY = 86_400_000_000
JUDGED = [*CLAIM_VALUES, "confidence", "document_id", "content_sha256", "domain", "published_at", "observed_at"]


def rival_outcome(claim: dict, best: dict) -> str:
    """What one claim does to the best rival; the row form of ``folds.judge`` (times in microseconds)."""
    filled = [c for c in CLAIM_VALUES if claim[c] is not None and best[c] is not None]
    if filled and claim[filled[0]] == best[filled[0]]:
        if claim["document_id"] is None or best["document_id"] is None:
            return "echo"
        if claim["document_id"] == best["document_id"]:
            return "same_document"
        copied = claim["content_sha256"] is not None and claim["content_sha256"] == best["content_sha256"]
        return "corroborates" if not copied and claim["domain"] and best["domain"] and claim["domain"] != best["domain"] else "echo"
    day = "observed_at" if claim["published_at"] is None or best["published_at"] is None else "published_at"
    if claim["volatility_days"] is not None and (claim[day] - best[day]) // DAY > values.NEWER_DAYS:
        return "supersedes"
    if claim["value_num"] is not None and best["value_num"]:
        ratio = float(claim["value_num"]) / float(best["value_num"])
        if ratio > values.OUT_OF_RANGE_RATIO or ratio < 1.0 / values.OUT_OF_RANGE_RATIO:
            return "out_of_range"
    return "synthesis"


def confirmed(confidence: int, other: int) -> int:
    """Confidence after one independent confirmation; the row form of ``trust.combine``."""
    odds = lambda t: min(100, max(0, t)) / max(1, 100 - min(100, max(0, t)))
    joined = odds(confidence) * max(1.0, odds(other))
    return max(1, min(99, round(100 * (joined / (1 + joined)))))


class _Adjudicator(StatefulProcessor):
    """One entity and attribute: every claim in force is a state row of its own.

    ``order`` has the confidence of each claim in force and is read once per batch; the
    claims themselves are fetched only when they are the best rival.
    """

    def __init__(self, columns: list[str], schema: str):
        self.columns, self.schema = columns, schema

    def init(self, handle) -> None:
        self.order = handle.getMapState("order", "assertion_id bigint", "confidence int")
        self.force = handle.getMapState("force", "assertion_id bigint", self.schema)

    def handleInputRows(self, key, rows, timers) -> Iterator[Row]:
        arrivals = sorted((dict(zip(self.columns, r)) for r in rows), key=lambda r: (r["is_new"], r["assertion_id"]))
        order = {k[0]: v[0] for k, v in self.order.iterator()}
        known = dict(order)
        fetched, outcomes, changed = {}, {}, {}

        def enter(claim):
            fetched[claim["assertion_id"]] = claim
            order[claim["assertion_id"]] = claim["confidence"]
            heappush(heap, (-claim["confidence"], claim["assertion_id"]))

        def look(number):
            if number not in fetched:
                fetched[number] = dict(zip(JUDGED, self.force.getValue((number,))))
            return fetched[number]

        def rival(own):
            """The most trusted other claim in force; outdated entries of the heap are dropped."""
            aside = None
            while heap:
                confidence, number = heap[0]
                if order.get(number) != -confidence:
                    heappop(heap)
                elif number == own:
                    aside = heappop(heap)
                else:
                    break
            found = heap[0][1] if heap else None
            if aside:
                heappush(heap, aside)
            return found

        heap = [(-c, number) for number, c in order.items()]
        heapify(heap)
        for claim in arrivals:
            if claim["status"] == "accepted":
                enter(claim)
        for claim in (r for r in arrivals if r["is_new"]):
            own, status, review = claim["assertion_id"], claim["status"], None
            best = rival(own)
            if best is None:
                outcome = "accepted" if status == "candidate" and claim["confidence"] >= 50 else "kept"
                if outcome == "accepted":
                    status = "accepted"
                    enter(claim)
            else:
                outcome = rival_outcome(claim, look(best))
                if outcome == "supersedes":
                    status = "accepted"
                    del order[best]
                    changed[best] = {**changed.get(best, {}), "status": "superseded", "confidence": changed.get(best, look(best))["confidence"]}
                    enter(claim)
                elif outcome != "synthesis":
                    status, review = ("candidate", "pending") if outcome == "out_of_range" else ("rejected", None)
                    order.pop(own, None)
                if outcome == "corroborates":
                    raised = confirmed(order[best], 50 if claim["trust"] is None else claim["trust"])
                    order[best] = raised
                    heappush(heap, (-raised, best))
                    changed[best] = {"status": "accepted", "confidence": raised, "count": changed.get(best, {}).get("count", 0) + 1}
            outcomes[own] = (outcome, status, review, best)
        for number in known.keys() - order.keys():
            self.order.removeKey((number,))
            self.force.removeKey((number,))
        for number, confidence in order.items():
            if known.get(number) != confidence:
                self.order.updateValue((number,), (confidence,))
            if number not in known:
                self.force.updateValue((number,), tuple(fetched[number][c] for c in JUDGED))
        news = {r["assertion_id"]: r for r in arrivals if r["is_new"]}
        for number in sorted(news.keys() | changed.keys()):
            outcome, status, review, best = outcomes.get(number, ("changed", "accepted", None, None))
            late = changed.get(number, {})
            status = late.get("status", status)
            confidence = late["confidence"] if late else news[number]["confidence"]
            yield Row(assertion_id=number, outcome=outcome, status=status, review_state=review, confidence=confidence, corroboration_count=late.get("count", 0), other_id=best)


def stream_adjudicate(claims: DataFrame) -> DataFrame:
    """Outcomes of a claim stream, with the claims in force per entity and attribute as state.

    ``claims`` has the columns of ``adjudication_input``; rows with ``is_new`` false seed
    the state.  Each batch is judged in id order against all that came before, as
    ``folds.adjudicate`` does with the table it would have left.  There is no watermark: a
    claim about an old date is ordinary input.
    """
    claims.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    contested = claims.filter("method <> 'derived' AND cardinality <> 'multi'")
    contested = contested.withColumns({c: F.unix_micros(c) for c in ("published_at", "observed_at")})
    columns = [c.strip().rsplit(" ", 1) for c in OUTCOMES.replace("\n", " ").split(",")]
    schema = ", ".join(f"{name} {contested.schema[name].dataType.simpleString()}" for name in JUDGED)
    judged = contested.groupBy("entity_id", "attribute_key").transformWithState(
        _Adjudicator(contested.columns, schema), ", ".join(" ".join(c) for c in columns), "append", "none")
    return uncontested(claims.filter("is_new")).unionByName(judged)


def cost_windows(calls: DataFrame, window: str = "1 day", slide: str | None = None, delay: str = "2 hours") -> DataFrame:
    """Calls and cost per window; a sliding window gives the trailing total.

    Works on a stream (``calls``: called_at, cost_usd) and on a stored table alike.
    """
    span = F.window("called_at", window, slide) if slide else F.window("called_at", window)
    timed = calls.withWatermark("called_at", delay) if calls.isStreaming else calls
    return timed.groupBy(span.alias("w")).agg(F.count("*").alias("calls"), F.sum("cost_usd").alias("cost_usd")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "calls", "cost_usd"
    )


def _cooldown(hours: int):
    span = pd.Timedelta(hours=hours)

    def pass_requests(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = pd.Timestamp(state.get[0]) if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["at", "kind", "id"])
        passed = []
        for row in rows.itertuples():
            if row.kind == "run":
                if row.status == "completed" and (last is None or row.at > last):
                    last = row.at
            elif last is None or row.at - last > span:
                passed.append((row.id, row.topic, row.frame, row.at))
        if last is not None:
            state.update((last.isoformat(),))
            until = int((last + span).timestamp() * 1000) + 1
            state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(passed, columns=["id", "topic", "frame", "at"])

    return pass_requests


def stream_cooldown(events: DataFrame, hours: int = 6, delay: str = "1 hour") -> DataFrame:
    """Requests that no completed run of the same topic and frame preceded by ``hours``.

    ``events``: id, kind (request / run), topic, frame, status, at.  Failed runs do not
    suppress; the state of a topic is dropped once its cooldown has passed.
    """
    keyed = events.filter("topic IS NOT NULL").withColumn("topic_key", F.lower("topic")).withWatermark("at", delay)
    return keyed.groupBy("topic_key", "frame").applyInPandasWithState(
        _cooldown(hours), "id long, topic string, frame string, at timestamp", "last_completed string", "append", "EventTimeTimeout"
    )


def refresh_entity_current(current, touched, assertion, entity, attribute_def, as_of: Column) -> DataFrame:
    """Projection with the rows of the touched entities computed anew."""
    keys = ids(touched)
    renewed = entity_current(assertion.join(keys, "entity_id", "left_semi"), entity, attribute_def, as_of)
    kept = current.join(keys, "entity_id", "left_anti")
    return kept.unionByName(renewed.select(*kept.columns))


def refresh_relation_current(current, touched, relation, entity) -> DataFrame:
    """Relation projection with the rows of the touched subjects computed anew.  ``touched``: subject_id."""
    keys = touched.select("subject_id").distinct()
    renewed = relation_current(relation.join(keys, "subject_id", "left_semi"), entity)
    kept = current.join(keys, "subject_id", "left_anti")
    return kept.unionByName(renewed.select(*kept.columns))


def stream_projection(claims: DataFrame, assertion: Callable[[], DataFrame], entity, attribute_def, as_of: Column, path: str, checkpoint: str) -> DataStreamWriter:
    """Changed projection rows of every batch of claims, one folder per batch.

    Only entities named in the batch are recomputed; readers take the newest row per
    entity and attribute.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        touched = assertion().join(ids(batch), "entity_id", "left_semi")
        append_once(entity_current(touched, entity, attribute_def, as_of), path, batch_id)

    return batch_writer(claims, handle, checkpoint)
