"""Main text of web pages: element subtrees that recur across a site's pages are its template.

Each page is parsed once into text blocks and hashed subtrees.  Subtrees are counted per host
over distinct articles, recurring ones are cut out, and so is what is marked as furniture.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

#: A subtree is template if it stands beside so many different articles of its host ...
MIN_PAGES = 3
#: ... and beside this share of them.
MIN_SHARE = 0.2
#: Templates (8 bytes each) that are given to every task; more are joined.
KNOWN_TEMPLATES = 1_000_000

# Fixed values of HTML: elements without content, without text of the page, within a line, and of prose.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
UNSEEN = {"audio", "button", "canvas", "head", "iframe", "noscript", "object", "script", "select", "style", "svg", "template", "textarea", "title", "video"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby",
    "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "td", "th", "time", "tt", "u", "var",
}
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "dt", "dd", "tr", "figcaption"}
SELF_ENDING = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
# Furniture by element, role, and words of class names and ids.
FURNITURE = {"nav", "footer", "aside", "form", "dialog", "menu"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}
WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "colophon", "comment", "comments", "consent", "cookie",
    "cookies", "copyright", "disqus", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices",
    "overlay", "pager", "pagination", "popup", "promo", "recommended", "related", "replies", "search", "share", "sharing", "side", "sidebar", "signup", "skip",
    "social", "sponsor", "sponsored", "subscribe", "subscription", "teaser", "teasers", "toolbar", "topbar", "widget",
}
STATES = {"has", "is", "js", "no", "not", "with", "without"}
#: A tag that the page breaks off in.
CUT_TAG = re.compile(r"</?[A-Za-z][^<>]*\Z")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

ARTICLE, MAIN, INNER, OTHER = 3, 2, 1, 0
BLOCKS = "array<struct<text:string,level:int,marked:int>>"
SUBTREES = "array<struct<hash:bigint,inside:boolean,start:int,stop:int>>"


def words_of(name: str) -> set[str]:
    parts = [w.lower() for w in NAME_PART.findall(name)]
    return set() if not parts or parts[0] in STATES else set(parts)


class _Element:
    """An open element: what it is, where its blocks begin, what its subtree holds so far."""

    __slots__ = ("tag", "furniture", "main", "unseen", "first", "parts", "holds_main")

    def __init__(self, tag, furniture, main, unseen, first):
        self.tag, self.furniture, self.main, self.unseen, self.first = tag, furniture, main, unseen, first
        self.parts, self.holds_main = [], False


class Page(HTMLParser):
    """Blocks and subtrees of one page, from whatever tags it has."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.blocks: list[list] = []  # text, level, marked, tag, depth of the article in the stack
        self.subtrees: list[tuple] = []
        self.line: list[str] = []
        self.stack = [_Element("", False, False, False, 0)]
        self.hidden = self.mains = 0
        self.articles: list[bytes] = []
        self.feed(CUT_TAG.sub("", html))
        self.close()
        self.end_line()
        while len(self.stack) > 1:
            self.leave(False)

    def end_line(self):
        if not self.line:
            return
        text = " ".join("".join(self.line).split())
        self.line = []
        if not text:
            return
        level, at = OTHER, 0
        if self.mains:
            at = next(i for i, e in enumerate(self.stack) if e.main)
            outside = any(e.furniture for e in self.stack[:at])
            level = INNER if outside else ARTICLE if any(e.main and e.tag == "article" for e in self.stack) else MAIN
        tag = next((e.tag for e in reversed(self.stack) if e.tag not in INLINE), "")
        self.blocks.append([text, level, 0, tag, at])
        self.stack[-1].parts.append(text.encode("utf-8", "replace"))

    def enter(self, tag, attrs):
        given = dict(attrs)
        names = set()
        for name in (given.get("class") or "").split() + [given.get("id") or ""]:
            names |= words_of(name)
        role = (given.get("role") or "").lower()
        main = tag in ("article", "main") or role == "main" or (given.get("itemprop") or "").lower() == "articlebody"
        furniture = tag in FURNITURE or role in ROLES or bool(names & WORDS) or (not self.mains and (tag == "header" or "header" in names))
        if tag in ("html", "body") or main:
            furniture = bool(main and tag not in ("html", "body") and self.mains and names & WORDS)
        element = _Element(tag, furniture, main, tag in UNSEEN, len(self.blocks))
        self.hidden += element.unseen
        self.mains += main
        if main:
            for e in self.stack:
                e.holds_main = True
        self.stack.append(element)

    def leave(self, named: bool):
        """Close the innermost element; ``named`` if its end tag stands in the page."""
        if self.stack[-1].tag not in INLINE | UNSEEN:
            self.end_line()
        e = self.stack.pop()
        depth, up = len(self.stack), self.stack[-1]
        self.hidden -= e.unseen
        self.mains -= e.main
        if e.tag in INLINE:
            if e.furniture and self.blocks[e.first :]:
                self.mark(e, depth, len(self.blocks))
            up.parts += e.parts
            return
        stop = len(self.blocks)
        if e.furniture:
            self.mark(e, depth, stop if named else next((i for i in range(e.first, stop) if self.blocks[i][3] in PROSE - {"li", "dt", "dd"}), stop))
        if stop == e.first:
            return
        import hashlib

        digest = hashlib.blake2b(e.tag.encode() + b"\0" + b"\1".join(e.parts), digest_size=8).digest()
        up.parts.append(digest)
        if e.main and not self.mains:
            self.articles.append(digest)
        elif not e.holds_main and e.tag not in ("html", "body") and not (self.mains and e.tag in PROSE):
            self.subtrees.append((int.from_bytes(digest, "little", signed=True), self.mains > 0, e.first, stop))

    def mark(self, e, depth, stop):
        for block in self.blocks[e.first : stop]:
            block[2] |= 1 if block[4] > depth else 2

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if tag in ("br", "hr") and not self.hidden:
                self.end_line()
            elif self.line and tag == "wbr":
                self.line.append("")
            return
        if tag not in INLINE and tag not in UNSEEN and self.stack[-1].tag in ("head", "title"):
            while self.stack[-1].tag in ("head", "title"):
                self.leave(False)
        if tag in SELF_ENDING:
            self.end_open(tag, SELF_ENDING[tag])
        if tag in ("td", "th"):
            self.line.append(" ")
        elif tag not in INLINE:
            if tag not in UNSEEN:
                self.end_open("p", None)
            if tag not in UNSEEN or tag in ("video", "audio", "iframe"):
                self.end_line()
        self.enter(tag, attrs)

    def end_open(self, tag, bounds):
        """An open ``tag`` ends where its own kind (or, for p, any block) begins."""
        for at in range(len(self.stack) - 1, 0, -1):
            open_tag = self.stack[at].tag
            if open_tag == tag:
                while len(self.stack) > at:
                    self.leave(True)
                return
            if open_tag in bounds if bounds is not None else open_tag not in INLINE:
                return

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # in HTML the slash means nothing

    def handle_endtag(self, tag):
        for at in range(len(self.stack) - 1, 0, -1):
            open_tag = self.stack[at].tag
            if open_tag == tag:
                while len(self.stack) > at + 1:
                    self.leave(False)
                self.leave(True)
                return
            if tag in INLINE and open_tag not in INLINE:
                return

    def handle_data(self, data):
        if not self.hidden:
            self.line.append(data)


def parsed_pages(pages: DataFrame) -> DataFrame:
    """Rows row, page_id, url, host, article (hash), blocks, subtrees; each page is read once, whole."""
    kind = pages.schema["page_id"].dataType.simpleString()
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    given = pages.select("page_id", F.col("url").cast("string").alias("url"), F.nullif(host, F.lit("")).alias("host"), F.col("html").cast("string").alias("html"))

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 33
        blocks_type = pa.list_(pa.struct([("text", pa.string()), ("level", pa.int32()), ("marked", pa.int32())]))
        trees_type = pa.list_(pa.struct([("hash", pa.int64()), ("inside", pa.bool_()), ("start", pa.int32()), ("stop", pa.int32())]))
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                blocks, trees, articles = [], [], []
                for html in part.column(3).to_pylist():
                    page = Page(html or "")
                    blocks.append([{"text": t, "level": level, "marked": marked} for t, level, marked, _, _ in page.blocks])
                    trees.append([dict(zip(("hash", "inside", "start", "stop"), s)) for s in page.subtrees])
                    whole = b"\1".join(page.articles or page.stack[0].parts)
                    articles.append(int.from_bytes(hashlib.blake2b(whole, digest_size=8).digest(), "little", signed=True))
                n = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(at, at + n), pa.int64()), *part.columns[:3], pa.array(articles, pa.int64()), pa.array(blocks, blocks_type), pa.array(trees, trees_type)],
                    names=["row", "page_id", "url", "host", "article", "blocks", "subtrees"])
                at += n

    return given.mapInArrow(run, f"row bigint, page_id {kind}, url string, host string, article bigint, blocks {BLOCKS}, subtrees {SUBTREES}")


def templates(parsed: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """Rows host, hash, inside of the subtrees that recur beside many different articles of a host.

    Copies of an article count once, so an article that a host shows often is no template.
    Pages without a host share no template.
    """
    seen = parsed.where(F.col("host").isNotNull())
    sizes = seen.select("host", "article").distinct().groupBy("host").agg(F.count("*").alias("n_articles"))
    trees = seen.select("host", "article", F.explode("subtrees").alias("s")).select("host", "article", "s.hash", "s.inside").distinct()
    often = trees.groupBy("host", "hash", "inside").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    return often.join(sizes, "host").where(F.col("n") >= min_share * F.col("n_articles")).select("host", "hash", "inside", "n", "n_articles")


def with_cuts(parsed: DataFrame, found: DataFrame, known_templates: int = KNOWN_TEMPLATES) -> DataFrame:
    """The parsed rows with ``cuts``: the block ranges of their template subtrees (null or empty: none).

    Up to ``known_templates`` templates their 64-bit keys are counted, collected and given to
    every task, so no text is shuffled; beyond it the subtrees are joined with the templates and
    the ranges with the rows.
    """
    spark = parsed.sparkSession
    key = F.xxhash64("host", "hash", "inside").alias("key")
    keys = saved(found.select("host", "hash", "inside", key), "templates")
    if keys.count() <= known_templates:
        known = spark.sparkContext.broadcast(sorted(r.key for r in keys.select("key").distinct().collect()))
        named = F.when(F.col("host").isNotNull(), F.transform("subtrees", lambda s: F.xxhash64(F.col("host"), s["hash"], s["inside"])))

        @F.pandas_udf("array<boolean>")
        def hits(names: pd.Series) -> pd.Series:
            import numpy as np

            wanted = np.array(known.value, np.int64)
            return names.map(lambda x: None if x is None or not len(wanted) else wanted[np.searchsorted(wanted, x).clip(max=len(wanted) - 1)] == x)

        met = F.filter(F.arrays_zip(F.col("subtrees").alias("s"), hits(named).alias("hit")), lambda z: z["hit"])
        return parsed.withColumn("cuts", F.transform(met, lambda z: F.struct(z["s"]["start"].alias("start"), z["s"]["stop"].alias("stop"))))
    # a site's template stands on all its pages: deal its rows over several tasks
    salts = 16
    dealt = keys.select("host", "hash", "inside", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    trees = parsed.where(F.col("host").isNotNull()).select("row", "host", F.explode("subtrees").alias("s"))
    trees = trees.select("row", "host", "s.*", F.pmod("row", F.lit(salts)).cast("int").alias("salt"))
    cuts = trees.join(dealt, ["host", "hash", "inside", "salt"]).groupBy("row").agg(F.collect_list(F.struct("start", "stop")).alias("cuts"))
    return parsed.join(cuts, "row", "left")


def main_text(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, known_templates: int = KNOWN_TEMPLATES) -> DataFrame:
    """Rows page_id, url, text, n_chars, n_blocks, n_cut (blocks cut as template): one per page row.

    Null html is an empty page.  Blocks are the lines a reader sees: white space within is one
    space, character references are decoded, blocks are joined by a line break in page order.
    Cut are scripts, styles, form controls, elements marked as furniture (navigation, page
    header, footer, aside, form, and names of classes and ids such as ad, notice, comments)
    and recurring subtrees; prose inside an article is never cut for recurring.  What stays
    is the articles; without any, ``main``; without both, the rest of the page.  An element
    without end tag marks only what stands before the next prose.  Equal rows each give a
    row; other columns are ignored.
    """
    parsed = saved(parsed_pages(pages), "parsed", compression="zstd")
    rows = with_cuts(parsed, templates(parsed, min_pages, min_share), known_templates)

    def uncut(block: Column, at: Column) -> Column:
        return ~F.coalesce(F.exists("cuts", lambda c: (c["start"] <= at) & (at < c["stop"])), F.lit(False))

    rows = rows.withColumn("left", F.filter("blocks", uncut))
    clean = F.filter("left", lambda b: b["marked"] == 0)
    best = F.array_max(F.transform(F.filter(clean, lambda b: b["level"] > INNER), lambda b: b["level"]))
    rows = rows.withColumns({"clean": clean, "best": best})
    inner = F.filter("left", lambda b: (b["level"] == INNER) & (b["marked"] < 2))
    chosen = F.when(F.col("best").isNotNull(), F.filter("clean", lambda b: b["level"] == F.col("best"))).when(F.size(inner) > 0, inner).otherwise(F.col("clean"))
    rows = rows.withColumn("chosen", chosen)
    text = F.array_join(F.transform("chosen", lambda b: b["text"]), "\n")
    return rows.select("page_id", "url", text.alias("text"), F.size("chosen").cast("long").alias("n_blocks"), (F.size("blocks") - F.size("left")).cast("long").alias("n_cut")).select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_blocks", "n_cut")
