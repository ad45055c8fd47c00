"""Document intake: new pages, feeds, cited URLs, triage, parsing."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factspark.functions import trust, vocab
from factspark.operators.entities import entity_priority, head, top_rows

TRIAGE_CHARS = 2000    # characters shown to the triage decision
TITLE_CHARS = 500


def ingest_documents(raw: DataFrame, existing: DataFrame) -> DataFrame:
    """New document rows for fetched content that is not stored yet.

    ``raw``: fetch_id, source_id, url, content.  One row per content hash survives,
    the earliest fetch; content already stored is dropped.
    """
    hashed = raw.withColumn("content_sha256", F.sha2(F.col("content"), 256))
    first = top_rows(hashed, ["content_sha256"], [F.col("fetch_id")])
    return first.join(existing.select("content_sha256"), "content_sha256", "left_anti").select(
        F.col("fetch_id").alias("document_id"),
        "source_id",
        "url",
        "content_sha256",
        F.col("content").alias("raw_content"),
        F.col("content").alias("text_content"),
        F.lit("fetched").alias("pipeline_status"),
    )


def feed_entries(entries: DataFrame, documents: DataFrame, per_feed: int | None = None) -> DataFrame:
    """The entries of each feed (the first ``per_feed`` if given) with ``is_new`` = URL not fetched before."""
    read = entries if per_feed is None else top_rows(entries, ["feed_id"], [F.col("position")], per_feed)
    read = read.filter(F.coalesce(F.col("link"), F.lit("")) != "")
    known = documents.select(F.col("url").alias("link")).distinct().withColumn("known", F.lit(True))
    return read.join(known, "link", "left").select(
        "feed_id", "position", "link", F.col("known").isNull().alias("is_new")
    )


def feed_new_urls(entries: DataFrame, documents: DataFrame, per_feed: int | None = None) -> DataFrame:
    return feed_entries(entries, documents, per_feed).filter("is_new").drop("is_new")


def feed_counts(entries: DataFrame, documents: DataFrame, per_feed: int | None = None) -> DataFrame:
    return feed_entries(entries, documents, per_feed).groupBy("feed_id").agg(
        F.count_if("is_new").alias("queued"), F.count_if(~F.col("is_new")).alias("skipped")
    )


def clean_url(url: Column) -> Column:
    return F.trim(F.regexp_replace(url, r"\s+", " "))


def url_documents(cited: DataFrame, existing: DataFrame) -> DataFrame:
    """One document per cited URL, keyed by the hash of the cleaned URL."""
    urls = cited.filter(F.coalesce(F.col("url"), F.lit("")) != "").select(clean_url(F.col("url")).alias("url")).distinct()
    keyed = urls.withColumn("content_sha256", F.sha2("url", 256))
    return keyed.join(existing.select("content_sha256"), "content_sha256", "left_anti").select(
        "content_sha256",
        "url",
        F.substring("url", 1, 200).alias("title"),
        F.lit("done").alias("pipeline_status"),
        trust.domain_trust(F.col("url")).alias("trust_override"),
    )


def triage_requests(document: DataFrame) -> DataFrame:
    """Documents to judge, with the leading part of their text."""
    return document.filter(F.coalesce(F.col("text_content"), F.lit("")) != "").select(
        "document_id", F.substring("text_content", 1, TRIAGE_CHARS).alias("snippet")
    )


def triage_apply(document: DataFrame, verdicts: DataFrame) -> DataFrame:
    """New status per document; without a verdict a document keeps its status.

    ``verdicts``: document_id, relevant (null = the answer was empty).
    """
    v = verdicts.select("document_id", "relevant", F.lit(True).alias("answered"))
    no_text = F.coalesce(F.col("text_content"), F.lit("")) == ""
    status = (
        F.when(no_text, "skipped")
        .when(F.col("answered").isNull(), F.col("pipeline_status"))
        .when(F.col("relevant"), "triaged")
        .otherwise("skipped")
    )
    return document.join(v, "document_id", "left").select("document_id", status.alias("pipeline_status"))


class _PageReader(HTMLParser):
    """Collects title, date and running text of one page."""

    DROPPED = {"script", "style", "noscript", "nav", "header", "footer", "aside", "form", "svg", "template"}
    BLOCKS = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "td", "th", "blockquote"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip, self.in_title, self.title, self.date, self.parts = [], False, [], None, []

    def handle_starttag(self, tag, attrs):
        fields = dict(attrs)
        advert = tag == "div" and "ad" in (fields.get("class") or "").split()
        if self.skip:
            if tag == self.skip[-1]:
                self.skip.append(tag)
        elif tag in self.DROPPED or advert:
            self.skip.append(tag)
        elif tag == "title":
            self.in_title = True
        elif tag == "meta" and (fields.get("property") or fields.get("name") or "") in (
            "article:published_time", "date", "pubdate", "dc.date"
        ):
            self.date = self.date or fields.get("content")
        elif tag == "time":
            self.date = self.date or fields.get("datetime")
        if tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if self.skip:
            if tag == self.skip[-1]:
                self.skip.pop()
        elif tag == "title":
            self.in_title = False
        if tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if self.skip:
            return
        (self.title if self.in_title else self.parts).append(data)


def read_page(html: str) -> tuple[str, str | None, str | None]:
    """(text, title, published date text) of one page; repeated lines are kept once."""
    reader = _PageReader()
    reader.feed(html)
    reader.close()
    lines = (re.sub(r"\s+", " ", line).strip() for line in "".join(reader.parts).split("\n"))
    text = "\n".join(dict.fromkeys(line for line in lines if line))
    title = re.sub(r"\s+", " ", "".join(reader.title)).strip()[:TITLE_CHARS]
    return text, title or None, reader.date


def parse_pages(pages: DataFrame) -> DataFrame:
    """Clean text, title and date of each page, with its new status.

    ``pages``: page_id, url, html and optionally a known title.  Rows stay in their
    scan partitions; nothing is shuffled.
    """
    known = F.col("title") if "title" in pages.columns else F.lit(None).cast("string")
    slim = pages.select("page_id", "url", "html", known.alias("known_title"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [read_page(h) if h else (None, None, None) for h in batch["html"]]
            out = batch[["page_id", "url", "known_title"]].copy()
            out["has_html"] = [bool(h) for h in batch["html"]]
            out["text_content"], out["found_title"], out["found_date"] = (
                zip(*found) if found else ((), (), ())
            )
            yield out

    parsed = slim.mapInPandas(
        parse,
        "page_id long, url string, known_title string, has_html boolean, text_content string, found_title string, found_date string",
    )
    empty = F.coalesce(F.col("text_content"), F.lit("")) == ""
    return parsed.select(
        "page_id",
        "url",
        F.when(~empty, F.col("text_content")).alias("text_content"),
        F.coalesce("known_title", "found_title").alias("title"),
        F.col("found_date").try_cast("timestamp").alias("published_at"),
        F.when(~F.col("has_html"), "failed").when(empty, "skipped").otherwise("parsed").alias("pipeline_status"),
    )


def due_sources(scheduled: DataFrame, entity: DataFrame, assertion: DataFrame, as_of: Column, limit: int | None = None) -> DataFrame:
    """Feeds to check now; with ``limit`` only those of the most urgent entities."""
    cadence = F.lit(7)
    for name, days in vocab.CADENCE_DAYS.items():
        cadence = F.when(F.col("cadence") == name, days).otherwise(cadence)
    due = scheduled.filter("is_active").filter(
        F.col("last_checked_at").isNull() | (trust.whole_days(as_of, F.col("last_checked_at")) >= cadence)
    )
    ranked = entity_priority(entity, assertion, as_of).select(
        F.col("entity_id").alias("entity_hint"), "priority"
    )
    found = due.join(ranked, "entity_hint", "left").withColumn("priority", F.coalesce("priority", F.lit(1.0)))
    return head(found, [F.desc("priority"), F.col("feed_id")], limit).select("feed_id", "entity_hint", "priority")
