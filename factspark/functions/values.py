"""Typed values, dates, addresses, identifiers and other claim fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab
from .names import alnum_words, literal_map
from .trust import whole_days

NUMBER_TYPES = ["int", "decimal", "money"]
OUT_OF_RANGE_RATIO = 5.0
NEWER_DAYS = 30


def typed_value(value: Column, unit: Column, datatype: Column) -> dict[str, Column]:
    """Route a raw value to one typed column; what fails to parse falls back to text."""
    number = value.try_cast("double")
    is_number = datatype.isin(NUMBER_TYPES) & value.isNotNull()
    # like the loader's date parser, only a real calendar date YYYY-M-D counts
    date = F.when(value.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), value.try_cast("date"))
    is_date = (datatype == "date") & date.isNotNull()
    is_bool = (datatype == "bool") & value.isNotNull()
    numeric = is_number & number.isNotNull()
    return {
        "value_num": F.when(numeric, number),
        "value_date": F.when(is_date, date),
        "value_bool": F.when(is_bool, ~F.lower(value).isin("", "false", "0")),
        "value_text": F.when(numeric | is_date | is_bool, None).otherwise(
            F.substring(F.coalesce(value, F.lit("")), 1, 500)
        ),
        "unit": F.when(numeric, F.substring(unit, 1, 20)),
    }


def flexible_date(text: Column) -> tuple[Column, Column]:
    """(date, precision) of YYYY, YYYY-MM or YYYY-MM-DD...; (null, 'year') otherwise."""
    s = F.trim(text)
    n = F.length(s)
    day_text = (
        F.when(n >= 10, F.substring(s, 1, 10))
        .when(n == 7, F.concat(s, F.lit("-01")))
        .when(n == 4, F.concat(s, F.lit("-01-01")))
    )
    date = F.when(day_text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), day_text.try_cast("date"))
    precision = F.when(n >= 10, "day").when(n == 7, "month").otherwise("year")
    return date, precision


def address_parts(address: Column) -> Column:
    """Struct of street, postalcode, city, country around the first postal-code chunk."""
    parts = F.filter(F.transform(F.split(address, ","), lambda p: F.trim(p)), lambda p: F.length(p) > 0)
    pattern = r"\b\d{4,6}\b"
    pivot = F.array_position(F.transform(parts, lambda p: p.rlike(pattern)), True)
    chunk = F.try_element_at(parts, pivot.cast("int"))
    code = F.regexp_extract(chunk, r"\b(\d{4,6})\b", 1)
    rest = F.trim(F.regexp_extract(chunk, r"^.*?\b\d{4,6}\b(.*)$", 1))
    second = F.try_element_at(parts, F.lit(2))
    first = F.try_element_at(parts, F.lit(1))
    street = F.when(pivot >= 2, F.when((pivot >= 3) & (F.length(second) <= 6), F.concat_ws(" ", first, second)).otherwise(first))
    return F.when(
        F.coalesce(pivot, F.lit(0)) > 0,
        F.struct(
            street.alias("street"),
            code.alias("postalcode"),
            F.when(F.length(rest) > 0, rest).alias("city"),
            F.when(F.size(parts) > 1, F.try_element_at(parts, F.lit(-1))).alias("country"),
        ),
    )


def website_domain(url: Column) -> Column:
    """Bare host of a website value; null unless it holds a dot."""
    full = F.when(url.contains("://"), url).otherwise(F.concat(F.lit("https://"), url))
    host = F.lower(F.regexp_extract(full, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r"^/+|/+$", "")
    return F.when(host.contains("."), host)


def normalize_qid(value: Column) -> Column:
    """Q-number of 'Q123', a spaced form or a full URI; null otherwise."""
    text = F.upper(F.trim(value))
    tail = F.when(text.startswith("HTTP"), F.element_at(F.split(text, "/"), -1)).otherwise(text)
    return F.when(tail.rlike(r"^Q\d+$"), tail)


def call_status(event_type: Column, date: Column, stored: Column, as_of_date: Column) -> Column:
    return F.when(
        event_type == "grant_call",
        F.when(date < as_of_date, "closed")
        .when(F.coalesce(stored, F.lit("")) != "", stored)
        .when(date.isNotNull(), "open")
        .otherwise("closed"),
    )


def tier_level(path: Column) -> Column:
    head = F.split_part(path, F.lit("."), F.lit(1))
    return F.when(head.isin(vocab.LEVELS), head).otherwise(literal_map(vocab.FLAT_TIER_LEVEL, head))


def clean_tiers(raw: Column) -> Column:
    """Array of valid tier paths from one raw answer string."""
    trimmed = F.transform(
        F.split(raw, "[;,]"), lambda p: F.regexp_replace(F.trim(p), r"""^['"\[\] ]+|['"\[\] ]+$""", "")
    )
    return F.filter(
        trimmed,
        lambda p: (F.length(p) > 0) & F.split_part(p, F.lit("."), F.lit(1)).isin(vocab.LEVELS),
    )


def quote_found(quote: Column, raw: Column, prose: Column) -> Column:
    """Verbatim in the page or its prose, else at least 80% of six or more tokens present."""
    tokens = alnum_words(quote)
    page = F.array_union(
        alnum_words(F.coalesce(raw, F.lit(""))), alnum_words(F.coalesce(prose, F.lit("")))
    )
    share = F.size(F.array_intersect(tokens, page)) / F.nullif(F.size(tokens), F.lit(0))
    verbatim = F.coalesce(raw.contains(quote), F.lit(False)) | F.coalesce(prose.contains(quote), F.lit(False))
    return F.when(verbatim, True).otherwise((F.size(tokens) >= 6) & (F.coalesce(share, F.lit(0.0)) >= 0.8))


def values_equal(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """The first typed column filled on both sides decides; none means different."""
    checks = [
        F.when(a[k].isNotNull() & b[k].isNotNull(), a[k] == b[k])
        for k in ("value_text", "value_num", "value_bool", "value_date")
    ]
    return F.coalesce(*checks, F.lit(False))


def out_of_range(new_num: Column, old_num: Column) -> Column:
    """More than five times up or down; never against a zero or missing value."""
    ratio = F.when(old_num != 0, new_num.cast("double") / old_num.cast("double"))
    return F.coalesce((ratio > OUT_OF_RANGE_RATIO) | (ratio < 1.0 / OUT_OF_RANGE_RATIO), F.lit(False))


def clearly_newer(new_published, old_published, new_observed, old_observed) -> Column:
    by_publication = whole_days(new_published, old_published)
    return F.coalesce(F.coalesce(by_publication, whole_days(new_observed, old_observed)) > NEWER_DAYS, F.lit(False))


def estimate_cost(tokens_in: Column, tokens_out: Column, rate_in: Column, rate_out: Column) -> Column:
    return F.bround(
        tokens_in / F.lit(1000.0) * F.coalesce(rate_in, F.lit(vocab.DEFAULT_RATE[0]))
        + tokens_out / F.lit(1000.0) * F.coalesce(rate_out, F.lit(vocab.DEFAULT_RATE[1])),
        6,
    )
