"""Name, country, slug and text-similarity expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vocab

_SUFFIX = "(?:" + "|".join(vocab.NAME_SUFFIXES) + ")"
_ASCII = r"^[\x00-\x7F]*$"


def literal_map(values: dict, key: Column) -> Column:
    """Look ``key`` up in a fixed dictionary held inside the expression."""
    flat = [F.lit(item) for pair in values.items() for item in pair]
    return F.try_element_at(F.create_map(*flat), key)


@F.pandas_udf(T.StringType())
def _fold_unicode(names: pd.Series) -> pd.Series:
    """Case-fold and strip marks from the names that are not plain ASCII."""

    def fold(name):
        if name is None:
            return None
        marks_off = "".join(
            c for c in unicodedata.normalize("NFKD", name.casefold()) if not unicodedata.combining(c)
        )
        return " ".join(re.sub(r"[^\w\s]", " ", marks_off).split())

    return names.map(fold, na_action="ignore")


def normalize_name(name: Column) -> Column:
    """Folded, unpunctuated, suffix-stripped form of a name.

    ASCII names stay in generated code; only the others visit the Arrow function,
    which receives nulls for the ASCII rows.
    """
    ascii_only = name.rlike(_ASCII)
    plain = F.trim(F.regexp_replace(F.lower(name), r"[^a-z0-9_]+", " "))
    folded = F.when(ascii_only, plain).otherwise(_fold_unicode(F.when(~ascii_only, name)))
    return F.when(folded.rlike(f"^{_SUFFIX}(?: {_SUFFIX})*$"), folded).otherwise(
        F.regexp_replace(folded, f"(?: {_SUFFIX})+$", "")
    )


def normalize_country(value: Column) -> Column:
    """ISO-2 code of a country name, alias or code; null when unknown."""
    text = F.trim(value)
    codes = sorted(set(vocab.COUNTRY_CODES.values()))
    key = F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), r"\.+$", ""))
    two_letters = text.rlike(r"^\p{L}{2}$")
    return F.when(two_letters, F.when(F.upper(text).isin(codes), F.upper(text))).otherwise(
        literal_map(vocab.COUNTRY_CODES, key)
    )


def slug_base(name: Column) -> Column:
    """URL form of a name, at most 200 characters, ``entity`` when nothing is left."""
    kept = F.regexp_replace(F.lower(F.trim(name)), r"[^a-z0-9_\s-]", "")
    base = F.substring(F.regexp_replace(F.regexp_replace(kept, r"[-\s]+", "-"), r"^[-_]+|[-_]+$", ""), 1, 200)
    return F.when(F.length(base) > 0, base).otherwise(F.lit("entity"))


def without_parentheses(name: Column) -> Column:
    return F.regexp_replace(name, r"\([^)]*\)", " ")


def words(text: Column) -> Column:
    """Distinct lower-case whitespace tokens."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: F.length(w) > 0))


def alnum_words(text: Column) -> Column:
    """Distinct lower-case ``[a-z0-9]+`` tokens."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: F.length(w) > 0))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Shared share of two sets (Jaccard); null when either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared / (F.size(a) + F.size(b) - shared))


def token_jaccard(a: Column, b: Column) -> Column:
    return overlap_ratio(words(a), words(b))


def trigrams(text: Column) -> Column:
    """Set of character trigrams, each word padded with two blanks before and one after."""
    parts = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0)

    def grams(word):
        padded = F.concat(F.lit("  "), word, F.lit(" "))
        return F.transform(
            F.sequence(F.lit(1), F.length(word) + 1), lambda i: F.substr(padded, i, F.lit(3))
        )

    return F.array_distinct(F.flatten(F.transform(parts, grams)))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Share of common trigrams as a 4-byte float."""
    return F.coalesce(overlap_ratio(trigrams(a), trigrams(b)), F.lit(0.0)).cast("float")


def lookup_eligible(mention: Column) -> Column:
    """Is a world-knowledge lookup worth asking for this mention?"""
    stripped = F.regexp_replace(mention, r"[ .]", "")
    last = F.regexp_replace(F.lower(F.element_at(F.split(F.trim(mention), r"\s+"), -1)), r"\.+$", "")
    return (F.length(stripped) <= 6) | ~stripped.rlike(_ASCII) | ~last.isin(vocab.LEGAL_SUFFIXES)


def keyword_relevance(name: Column, entity_type: Column) -> Column:
    """Cheap test whether an entity belongs to the field; true when unsure."""
    lowered = F.lower(name)
    any_of = lambda terms: lowered.rlike("|".join(re.escape(t) for t in terms))
    return (
        F.when(entity_type == "geography", False)
        .when(entity_type.isin(vocab.ALWAYS_RELEVANT_TYPES), True)
        .when(any_of(vocab.FIELD_WORDS), True)
        .when(any_of(vocab.OFF_FIELD_WORDS), False)
        .otherwise(True)
    )
